"""Keyword lists as tables: words of the text joined to the keywords, however many they are.

`functions.matching.matched` makes one pattern of a list, which suits a few hundred words. Here a text is cut into runs of word characters and of others; every
stretch of runs that is as long as some keyword is looked up by a hash join, all lists at once, and of the hits of a text the
leftmost, and of those the longest, is taken, then the next one after its end. The result is that of the pattern; the plan does not
depend on the keywords, which are broadcast only if they are few.

Defined results: a null text has no words; of keywords that are equal but for accents and case the first spelling, by `pos`, is reported; empty keywords
count as none; keywords match from word to word, so one that begins with other characters needs a word before it; without keywords nothing matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.functions.text import bound, fold, fold_exact
from newsflow.operators.lookup import small

_RUNS = r"(?U)\w+|\W+"
_WORD = r"(?U)^\w"


def _runs(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(_RUNS), F.lit(0))


def keyword_table(keywords: DataFrame) -> DataFrame:
    """list, stretch (folded), name, runs and from_word of each keyword (list, keyword, pos) that can match."""
    folded = keywords.withColumn("stretch", fold_exact("keyword")).where(F.coalesce("stretch", F.lit("")) != "")
    first = folded.groupBy("list", "stretch").agg(F.min_by("keyword", F.struct("pos", "keyword")).alias("name"))
    return first.select("list", "stretch", "name", F.size(_runs(F.col("stretch"))).alias("runs"), F.regexp_like("stretch", F.lit(_WORD)).alias("from_word"))


def _stretches(runs: Column, kinds: list[tuple[int, bool]]) -> Column:
    """(at, runs, stretch) of all stretches of the lengths that keywords have, from words or from what stands between them."""
    first_is_word = F.regexp_like(F.get(runs, F.lit(0)), F.lit(_WORD))
    return F.concat(*[_of_length(runs, first_is_word, *kind) for kind in kinds])


def _of_length(runs: Column, first_is_word: Column, n: int, from_word: bool) -> Column:
    """The stretches of n runs that begin at words, or that begin between words. One that begins or ends between words does so at a word's edge, not at the text's."""
    begin = F.when(first_is_word, 0 if from_word else 1).otherwise(1 if from_word else 2)
    to_word = from_word == (n % 2 == 1)
    last = F.size(runs) - n - (0 if to_word else 1)
    at = F.when(last >= begin, F.sequence(begin, last, F.lit(2)))
    found = F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(n).alias("runs"), F.array_join(F.slice(runs, i + 1, F.lit(n)), "").alias("stretch")))
    return F.coalesce(found, F.expr("cast(array() as array<struct<at:int,runs:int,stretch:string>>)"))


def match_keywords(texts: DataFrame, keywords: DataFrame, key: list[str]) -> DataFrame:
    """The columns key, and the keywords (array<string>, by first occurrence) of each text in which its list has any. texts: key (unique), list, text;
    keywords: list, keyword, pos."""
    table = small(keyword_table(keywords))
    kinds = [(r["runs"], r["from_word"]) for r in table.select("runs", "from_word").distinct().collect()]
    if not kinds:
        return texts.select(*key, F.array().cast("array<string>").alias("keywords")).limit(0)
    # bound, so that a text is cut once and not once for each of its stretches
    cut = bound(_runs(fold(F.coalesce("text", F.lit("")))), lambda runs: _stretches(runs, sorted(kinds)))
    stretches = texts.select(*key, "list", F.inline(cut))
    hits = stretches.join(table.select("list", "stretch", "name"), ["list", "stretch"])
    of_text = hits.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("runs")).alias("less"), "name"))).alias("hits"))
    begin = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("names"))
    taken = lambda done, hit: F.when(hit["at"] < done["end"], done).otherwise(F.struct((hit["at"] - hit["less"]).alias("end"), F.array_append(done["names"], hit["name"]).alias("names")))
    return of_text.select(*key, F.array_distinct(F.aggregate("hits", begin, taken)["names"]).alias("keywords"))
