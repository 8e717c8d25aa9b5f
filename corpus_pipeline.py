"""The corpus pipeline: documents through five operators, each on all that its predecessor kept.

Toxic documents go; of equal texts one stays; of near-duplicates (shingles of five words) one stays; secrets are masked in
the texts; what is left is packed into training sequences.

A stage's result is written before the next stage is called; tables that a stage needed for itself are removed then.

Defined results: a null text counts as empty; empty texts are equal, so one of them stays; very long texts are scored, compared,
masked and packed whole; of repeated rows and of ties one stays; null ids come last when one is kept; empty tables go through all stages to an empty
result; columns besides those of documents are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm import exact_dedup, packing, secret_scan, simhash, toxicity
from newsflow.llm.common import discard, drop_tables, materialize, scratch

#: Tables of the stage before.
_tables: list[str] = []


def _stage(first: bool = False) -> Callable:
    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            global _tables
            if not first:
                drop_tables(spark, _tables)
            with scratch() as _tables:
                return f(spark, docs, sf_dir)

        return run

    return wrap


@_stage(first=True)
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage()
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


@_stage()
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


@_stage()
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_secrets(docs)


@_stage()
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.token_pieces(docs, str(public_tokenizers.path("byte_bpe_50k.json")))
    return packing.pack(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("simhash", near), ("secret_scan", secrets), ("packing", packed)]

#: Trained scores, similarity classes and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
