"""Secrets, judged by how widely the corpus shares them. DataFrame functions only.

Three fixed kinds (assign, access, hex) are found in every text. Long mixed tokens (generic) are candidates besides. All
candidate values are hashed and counted over the corpus: in how many repositories and by how many owners each occurs
(a repository is named within its owner). A value of few owners that looks live is owner-specific; one of many owners
is a widely copied example. A generic candidate becomes a span of kind `owner` if it is owner-specific, looks live and
overlaps no span of a fixed kind; spans of the fixed kinds always stay.

Defined results: a null text counts as empty; null owners or repositories count as one owner or repository; repeated rows
are scanned one by one; an empty table gives an empty result; extra columns are ignored (scan) or kept (redact).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.llm.common import join_hot, materialize, with_columns

# The patterns of the kinds. Java's case folding without (?u) is ASCII only.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
GENERIC = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owner")


def _matches(text: Column, kind: int, pattern: str, value_group: int, least: int) -> Column:
    """Array of (kind, at, gap, width, value, ok): `gap` code points lie between the match before and this one."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    gaps = F.split(text, pattern, -1)
    each = F.transform(F.arrays_zip(found.alias("m"), values.alias("v"), F.sequence(F.lit(0), F.size(found) - 1).alias("i")), lambda x: F.struct(F.lit(kind).alias("kind"), x["i"].alias("at"), F.length(F.get(gaps, x["i"])).alias("gap"), F.length(x["m"]).alias("width"), x["v"].alias("value"), (F.length(x["v"]) >= least).alias("ok")))
    return F.when(F.regexp_like(text, F.lit(pattern)), each)


def candidates(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """The columns `keep` of every row and, as `found`, its raw matches of all kinds."""
    text = F.col("__nf_text")
    none = F.expr("cast(array() as array<struct<kind:int,at:int,gap:int,width:int,value:string,ok:boolean>>)")
    kinds = [(0, ASSIGN, 2, 8), (1, ACCESS, 0, 16), (2, HEX, 0, 32), (3, GENERIC, 0, 20)]
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__nf_text"))
    return rows.select(*[c for c in rows.columns if c != "__nf_text"], F.concat(*[F.coalesce(_matches(text, *k), none) for k in kinds]).alias("found"))


def _entropy(value: Column) -> Column:
    """Bits a character."""
    n = F.length(value)
    share = F.transform(F.array_distinct(F.split(value, "")), lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n)
    return F.aggregate(share, F.lit(0.0), lambda a, p: F.when(p > 0, a - p * F.log2(p)).otherwise(a))


def hits_of(found: DataFrame, min_entropy: float) -> DataFrame:
    """From rows (rid, repo, owner, found): a row for each match that is long enough, with its place, the hash of its value and
    whether it looks live. A match ends where the lengths before it and its own sum up to, so places need no search."""
    hits = found.select("rid", "repo", "owner", F.inline("found"))
    before = Window.partitionBy("rid", "kind").orderBy("at")
    hits = hits.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("width")).over(before)).where("ok")
    live = F.regexp_like("value", F.lit("[0-9]")) & (_entropy(F.col("value")) >= min_entropy)
    start = (F.col("end") - F.col("width")).alias("start")
    return hits.select("rid", "repo", "owner", "kind", start, "end", F.sha2("value", 256).alias("hash"), live.alias("live"))


def span_rows(found: DataFrame, max_owners: int = 2, min_entropy: float = 3.0) -> DataFrame:
    """A row (rid, start, kind, end, live, owners, repos) for each span that stays. Uses are counted by repository, then by
    owner, then by hash, so that a value that everyone copies is summed up before each shuffle."""
    hits = materialize(hits_of(found, min_entropy))
    by_repo = hits.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    uses = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("n"))
    judged = join_hot(hits, materialize(uses), "hash", "n", hits.count())
    judged = judged.withColumn("live", F.col("live") & (F.col("owners") <= max_owners)).where("kind < 3 or live")
    # a generic span goes if a fixed one that begins no later reaches into it, or one that begins later begins in it
    fixed = F.col("kind") < 3
    up_to_here = Window.unboundedPreceding, Window.currentRow
    from_left = Window.partitionBy("rid").orderBy("start", "kind").rowsBetween(*up_to_here)
    from_right = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(*up_to_here)
    reach = F.coalesce(F.max(F.when(fixed, F.col("end"))).over(from_left), F.lit(0))
    next_begin = F.min(F.when(fixed, F.col("start"))).over(from_right)
    judged = judged.withColumn("reach", reach).withColumn("next_begin", next_begin)
    alone = (F.col("reach") <= F.col("start")) & (F.col("next_begin").isNull() | (F.col("next_begin") >= F.col("end")))
    return judged.where(fixed | alone).select("rid", "start", "kind", "end", "live", "owners", "repos")


def spans(found: DataFrame, **limits) -> DataFrame:
    """rid and `spans`, an array of (start, kind, end, live, owners, repos) by start, then kind; only rows that have a span."""
    span = F.struct("start", "kind", "end", "live", "owners", "repos")
    return span_rows(found, **limits).groupBy("rid").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", **limits) -> DataFrame:
    """A row for each document: id_col and `spans` (null where there is none)."""
    keep = [F.col(id_col).alias("id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), F.monotonically_increasing_id().alias("rid")]
    found = materialize(candidates(docs, text_col, keep))
    got = spans(found.where("size(found) > 0"), **limits)
    return found.select("id", "rid").join(got, "rid", "left").select(F.col("id").alias(id_col), "spans")


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", mask: str = "[SECRET]", **limits) -> DataFrame:
    """docs with every span of a text replaced by `mask`; touching or overlapping spans get one mask. n_chars, where there is
    such a column, follows. Texts without a match pass through as they are, neither written nor shuffled."""
    cols = docs.columns
    whole = F.col(f"`{text_col}`")
    matched = F.coalesce(F.regexp_like(whole, F.lit(ASSIGN)) | F.regexp_like(whole, F.lit(ACCESS)) | F.regexp_like(whole, F.lit(HEX)) | F.regexp_like(whole, F.lit(GENERIC)), F.lit(False))
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)]).alias("row")
    keep = [row, F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), F.monotonically_increasing_id().alias("rid")]
    some = materialize(candidates(docs.where(matched), text_col, keep))
    # overlapping and touching spans are one island: a new one begins where no span before reaches
    parts = span_rows(some.select("rid", "repo", "owner", "found"), **limits)
    by_start = Window.partitionBy("rid").orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("new", F.when(reach >= F.col("start"), 0).otherwise(1)).withColumn("island", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    islands = parts.groupBy("rid", "island").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    masks = islands.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("m"))
    got = some.select("rid", "row").join(masks, "rid", "left").withColumn("m", F.coalesce("m", F.expr("cast(array() as array<struct<a:long,b:long>>)")))
    text, zero = F.col(f"row.c{cols.index(text_col)}"), F.lit(0).cast("long")
    begin = lambda i: F.coalesce(F.get(F.col("m"), i - 1)["b"], zero)
    end = lambda i: F.coalesce(F.get(F.col("m"), i)["a"], F.length(text).cast("long"))
    between = F.transform(F.sequence(F.lit(0), F.size("m")), lambda i: F.substring(text, (begin(i) + 1).cast("int"), (end(i) - begin(i)).cast("int")))
    got = got.withColumn("new", F.when(F.size("m") > 0, F.array_join(between, mask)).otherwise(text))

    def value(c: str, i: int) -> Column:
        old = F.col(f"row.c{i}")
        if c == text_col:
            return F.col("new")
        if c == "n_chars":
            return F.when(F.col("new").eqNullSafe(text), old).otherwise(F.length("new")).cast(docs.schema[c].dataType)
        return old

    return docs.where(~matched).unionByName(got.select(*[value(c, i).alias(c) for i, c in enumerate(cols)]))
