"""Search by parts of words over an inverted index of trigrams, kept up by batch.

Every stretch of three characters of a folded text is a gram, the last two with blanks behind; the index lists the keys of the texts that hold a gram, in folders by
batch and by the gram's hash, sorted by gram. A search reads the folders of its terms' grams alone, keeps the keys that have all of them,
and holds those rows, and no others, against the terms themselves. So the answer is that of a scan: a gram too many costs a comparison, and none is missing, as
a row that a batch changes is listed with its new grams by that batch. A term of one or two characters is looked up as the beginning of grams.

Defined results: accents and case don't count; null texts are empty; without terms all rows are found; an empty term is held by every text;
repeated batches replace themselves; keys that the table no longer has are not found; null keys are never found by terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.functions.matching import contains_all
from newsflow.functions.matching import folded as folded_term
from newsflow.functions.text import fold

GRAM = 3


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def grams(text: Column) -> Column:
    """The distinct grams of a folded text."""
    padded = F.concat(text, F.lit(" " * (GRAM - 1)))
    return F.array_distinct(F.regexp_extract_all(padded, F.lit(rf"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


class SearchIndex:
    """The index below a path of the texts of some columns."""

    def __init__(self, spark: SparkSession, path: str, texts: list[str], key: str = "url", buckets: int = 64):
        self.spark, self.path, self.texts, self.key, self.buckets = spark, path.rstrip("/"), texts, key, buckets

    def _text(self) -> Column:
        return fold(F.concat_ws(" ", *self.texts))

    def add(self, rows: DataFrame, number: int) -> None:
        """List the rows of a batch; a batch that is added again replaces itself."""
        text = F.col("__text")
        keyed = rows.select(F.col(self.key).alias("key"), self._text().alias("__text")).where(F.col("key").isNotNull() & (F.length(text) > 0))
        listed = keyed.select("key", F.explode(grams(text)).alias("gram")).withColumn("bucket", _bucket(F.col("gram"), self.buckets))
        # common grams have many keys: they are dealt by both and sorted by gram
        dealt = listed.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(4))).sortWithinPartitions("bucket", "gram")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={number}")

    def candidates(self, terms: list[str]) -> DataFrame | None:
        """The keys that hold all grams of the terms; None where terms ask for nothing."""
        wanted = sorted({folded_term(t) for t in terms} - {""})
        if not wanted:
            return None
        exact = sorted({t[i : i + GRAM] for t in wanted for i in range(len(t) - GRAM + 1)})
        begins = [t for t in wanted if len(t) < GRAM]
        rows = self.spark.read.schema("key string, gram string, batch int, bucket int").option("basePath", self.path).parquet(self.path)
        gram, met = F.col("gram"), F.lit(False)
        for b in begins:
            met = met | gram.startswith(b)
        if exact:
            hit = gram.isin(exact)
            if not begins:  # short terms may begin a gram of any folder
                folders = [r[0] for r in self.spark.createDataFrame([(g,) for g in exact], "gram string").select(_bucket(gram, self.buckets)).distinct().collect()]
                hit = hit & F.col("bucket").isin(folders)
            met = hit | met if begins else hit
        asked = F.array_compact(F.array(F.when(gram.isin(exact), gram) if exact else F.lit(None).cast("string"), *[F.when(gram.startswith(b), F.lit(b)) for b in begins]))
        found = rows.where(met).select("key", F.explode(asked).alias("asked")).groupBy("key").agg(F.count_distinct("asked").alias("n"))
        return found.where(F.col("n") == len({*exact, *begins})).select("key")

    def search(self, table: DataFrame, terms: list[str]) -> DataFrame:
        """The rows of the table whose texts hold every term."""
        keys = self.candidates(terms)
        if keys is None:
            return table
        return table.join(keys.withColumnRenamed("key", self.key), self.key, "left_semi").where(contains_all(terms, *[F.col(c) for c in self.texts]))
