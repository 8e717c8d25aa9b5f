"""Which code page bytes are in, where nothing that can be trusted says so: by frequencies of byte pairs.

A profile is learnt from texts of the kind that is expected: each code page counts the pairs of bytes that it makes of the texts which it can hold, of those pairs alone that
have a byte beyond ASCII, as the others are the same in all code pages. Spark adds the counts up; a profile has at most 65,536 numbers a code page,
whatever the texts. Bytes are then in the code page under whose profile their own pairs are likeliest, of those that decode them whole.

Defined results: null bytes give null; a byte order mark decides; then, an even number of bytes with zeros among them is UTF-16, by the positions where the
zeros lie, if they decode as such; other bytes that are valid UTF-8 are UTF-8, and so are plain ASCII and empty ones; a code page that no profile knows is never found; without any profile the
declared one counts if it decodes the bytes, or else Latin-1; of code pages that decode the bytes alike, and of equally likely ones, the first named counts. Whole bytes are read, however long.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Single-byte code pages that a profile tries unless told otherwise (fixed names), for Latin, Greek and Cyrillic scripts.
CODE_PAGES = ("cp1252", "cp1250", "cp1251", "cp1253", "cp850", "mac_roman", "koi8_r", "cp866")
#: Byte order marks (fixed values).
_MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def _pairs(raw: bytes) -> np.ndarray:
    """The pairs of neighbouring bytes that have one beyond ASCII, as numbers. A first and a last blank give single bytes neighbours."""
    b = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.int64)
    high = b > 127
    return (b[:-1] * 256 + b[1:])[high[:-1] | high[1:]]


def encoded(text: str, page: str) -> bytes | None:
    try:
        return text.encode(page)
    except UnicodeEncodeError:
        return None


def _decoded(raw: bytes, page: str) -> str | None:
    try:
        return raw.decode(page)
    except (UnicodeDecodeError, LookupError):
        return None


def profile(texts: DataFrame, column: str, pages: Sequence[str] = CODE_PAGES) -> DataFrame:
    """code_page, pair, n: how often each code page makes each pair of bytes of the texts."""
    pages = list(pages)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((len(pages), 65536), np.int64)
        for batch in batches:
            for text in batch["text"]:
                if text is not None and not text.isascii():
                    for i, page in enumerate(pages):
                        if (raw := encoded(text, page)) is not None:
                            pairs, n = np.unique(_pairs(raw), return_counts=True)
                            totals[i, pairs] += n
        i, pair = totals.nonzero()
        yield pd.DataFrame({"code_page": np.array(pages)[i], "pair": pair, "n": totals[i, pair]})

    counts = texts.select(F.col(column).alias("text")).mapInPandas(count, "code_page string, pair int, n long")
    return counts.groupBy("code_page", "pair").agg(F.sum("n").alias("n"))


def detector(known: DataFrame, pages: Sequence[str] = CODE_PAGES):
    """A function of (bytes, declared code page) to struct(code_page, text). known: a profile; its numbers, at most 65,536 a code page, go to the tasks."""
    counts = {page: np.zeros(65536) for page in pages}
    for r in known.where(F.col("code_page").isin(list(pages))).collect():  # bounded by the code pages, not by the texts
        counts[r["code_page"]][r["pair"]] = r["n"]
    likely = {page: np.log((n + 0.5) / (n.sum() + 0.5 * 65536)).astype(np.float32) for page, n in counts.items() if n.any()}

    def found(raw: bytes, declared: str | None) -> tuple[str, str]:
        for mark, page in _MARKS:
            if raw.startswith(mark) and (text := _decoded(raw[len(mark) :], page)) is not None:
                return page, text
        if b"\0" in raw and len(raw) % 2 == 0:
            page = "utf-16-le" if raw[1::2].count(0) >= raw[::2].count(0) else "utf-16-be"
            if (text := _decoded(raw, page)) is not None:
                return page, text
        if (text := _decoded(raw, "utf-8")) is not None:
            return "utf-8", text
        pairs, n = np.unique(_pairs(raw), return_counts=True)
        best = None
        for page, logs in likely.items():
            score = float(logs[pairs] @ n)
            if (best is None or score > best[0]) and (text := _decoded(raw, page)) is not None:
                best = (score, page, text)
        if best:
            return next(page for page in likely if _decoded(raw, page) == best[2]), best[2]
        text = _decoded(raw, declared) if declared else None
        return (declared, text) if text is not None else ("latin-1", raw.decode("latin-1"))

    @F.pandas_udf("code_page string, text string")
    def detect(raw: pd.Series, declared: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if r is None else found(bytes(r), d) for r, d in zip(raw, declared, strict=True)]
        return pd.DataFrame(rows, columns=["code_page", "text"])

    def of(raw: Column, declared: Column | None = None) -> Column:
        return detect(raw.cast("binary"), F.lit(None).cast("string") if declared is None else declared)

    return of
