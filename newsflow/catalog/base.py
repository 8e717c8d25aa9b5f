"""Registration of queries: a name, a function of (spark, sf_dir), and the SQL that DuckDB answers alike.

The driver's tables stand in for what the library reads: pages for stored web pages, documents for articles and summaries, events for the
history of writes, the small star tables for dimensions. All times are relative to AS_OF."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.functions import html as H
from newsflow.functions import text as X
from newsflow.functions import urls as U

AS_OF = "2024-01-31 00:00:00"
KEYWORDS = ["the", "der", "der die", "los", "that", "une"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def now() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(at: str | Column) -> Column:
    return F.unix_timestamp(F.col(at) if isinstance(at, str) else at)


def joined(words: str | Column, by: str = ",") -> Column:
    return F.array_join(F.array_sort(words), by)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as writes to an article table: a user is a URL."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select(F.concat(F.lit("u"), F.col("user_id")).alias("url"), (F.col("event_id") + 1).alias("seq"), F.col("event_type").alias("domain"), F.concat(F.lit("name "), F.col("event_type")).alias("source_name"), F.concat(F.lit("t"), F.col("event_id")).alias("title"), F.concat(F.lit("s"), F.col("event_id")).alias("snippet"), F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("published_at"), F.col("ts").alias("found_at"), F.array("event_type").alias("matched_keywords"), F.repeat(F.lit("x"), (F.col("event_id") % 37).cast("int")).alias("body"))


HISTORY = """
    h AS (SELECT 'u' || user_id AS url, event_id + 1 AS seq, event_type AS domain, 'name ' || event_type AS source_name,
                 't' || event_id AS title, 's' || event_id AS snippet, CASE WHEN event_id % 3 <> 0 THEN ts END AS published_at,
                 ts AS found_at, event_type AS kw, repeat('x', CAST(event_id % 37 AS INT)) AS body FROM events)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as raw items of feeds."""
    d = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    return d.select(F.col("doc_id").alias("seq"), F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("lang"), F.lit("/"), F.col("doc_id") % 800).alias("url"), F.when(F.col("doc_id") % 5 != 0, F.get(lines, F.lit(0))).otherwise("").alias("title"), F.when(F.col("doc_id") % 10 != 0, F.col("text")).otherwise("").alias("summary"), F.when(F.col("doc_id") % 7 != 0, now() - F.make_dt_interval(hours=(F.col("doc_id") % 120).cast("int"))).alias("published_at"), F.concat("source", F.lit(".example.com")).alias("source_domain"), F.concat("lang", F.lit(".feed.example.com")).alias("feed_domain"))


ITEMS = """
    i AS (SELECT doc_id AS seq, 'https://' || source || '.example.com/' || lang || '/' || (doc_id % 800) AS url,
                 CASE WHEN doc_id % 5 <> 0 THEN string_split(text, chr(10))[1] ELSE '' END AS title,
                 CASE WHEN doc_id % 10 <> 0 THEN text ELSE '' END AS summary,
                 CASE WHEN doc_id % 7 <> 0 THEN TIMESTAMP '2024-01-31 00:00:00' - to_hours(CAST(doc_id % 120 AS INT)) END AS published_at,
                 source || '.example.com' AS source_domain, lang || '.feed.example.com' AS feed_domain FROM documents)"""


def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as raw items, dated by their number."""
    p = X.computed(table(spark, sf_dir, "pages"), {"url": U.canonical(F.col("url")), "title": H.page_title(F.col("html"))})
    url = F.col("url")
    return p.select(F.col("page_id").alias("seq"), "url", "title", F.lit("").alias("summary"), F.when(F.col("page_id") % 4 != 0, now() - F.make_dt_interval(hours=(F.col("page_id") % 100).cast("int"))).alias("published_at"), U.host(url).alias("source_domain"), F.regexp_extract(U.host(url), r"([^.]+\.[^.]+)$", 1).alias("feed_domain"))


def fold_sql(x: str) -> str:
    """Letters beyond ASCII that have no base letter count as letters."""
    return f"regexp_replace(lower(strip_accents({x})), '[^\\x00-\\x7F]', 'x', 'g')"


def matched_sql(x: str, words: list[str] = KEYWORDS) -> str:
    either = "|".join(sorted(words, key=len, reverse=True))
    return f"array_to_string(list_sort(list_distinct(regexp_extract_all({fold_sql(x)}, '\\b(?:{either})\\b'))), ',')"


def host_sql(u: str) -> str:
    return f"lower(regexp_extract({u}, '^[^:]+://([^/?#]*)', 1))"


def site_sql(u: str) -> str:
    return f"regexp_replace({host_sql(u)}, '^www\\.', '')"


def canonical_sql(u: str) -> str:
    path = f"regexp_extract({u}, '^[^:]+://[^/?#]*([^?#]*)', 1)"
    pairs = f"list_filter(string_split(regexp_extract({u}, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND lower(string_split(x, '=')[1]) NOT IN ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','fbclid','gclid','mc_cid','mc_eid','ref','ref_src','__twitter_impression'))"
    return f"(lower(regexp_extract({u}, '^([^:]+):', 1)) || '://' || {site_sql(u)} || CASE WHEN rtrim({path}, '/') = '' THEN {path} ELSE rtrim({path}, '/') END || CASE WHEN len({pairs}) > 0 THEN '?' || array_to_string({pairs}, '&') ELSE '' END)"


_NAMES_SQL = "MAP {" + ", ".join(f"'&{n}': '{html5[n].replace(chr(39), chr(39) * 2)}'" for n in sorted(html5)) + "}"
_OLD_SQL = "[" + ", ".join(str(ord(bytes([c]).decode("cp1252", "ignore") or chr(c))) for c in range(128, 160)) + "]"
_REFERENCE_SQL = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{1,31};?)"


def unescape_sql(x: str) -> str:
    """By the table of names that HTML fixes: a name as it is written, or else its longest beginning that is a name without semicolon."""
    code = "coalesce(CASE WHEN r LIKE '&#x%' OR r LIKE '&#X%' THEN try_cast('0x' || regexp_extract(r, '([0-9a-fA-F]+);?$', 1) AS UBIGINT) ELSE try_cast(regexp_extract(r, '[0-9]+') AS UBIGINT) END, 1114112)"
    number = f"list_transform([{code}], lambda c: CASE WHEN c = 0 OR c > 1114111 OR c BETWEEN 55296 AND 57343 THEN chr(65533) WHEN c BETWEEN 128 AND 159 THEN chr(list_extract({_OLD_SQL}, (c - 127)::INT)) WHEN c < 9 OR c = 11 OR c BETWEEN 14 AND 31 OR c = 127 OR c BETWEEN 64976 AND 65007 OR c % 65536 >= 65534 THEN '' ELSE chr(c::INT) END)[1]"
    prefix = "list_filter(list_transform(range(length(r) - 1, 1, -1), lambda n: r[1:n]), lambda p: len(map_extract(names, p)) > 0 AND NOT contains(p, ';'))[1]"
    name = f"list_transform([{_NAMES_SQL}], lambda names: coalesce(map_extract(names, r)[1], list_transform([{prefix}], lambda p: map_extract(names, p)[1] || r[length(p) + 1:])[1], r))[1]"
    resolved = f"list_transform(regexp_extract_all(t, '{_REFERENCE_SQL}'), lambda r: CASE WHEN r LIKE '&#%' THEN {number} ELSE {name} END)"
    pieces = f"string_split_regex(t, '{_REFERENCE_SQL}')"
    return f"list_transform([{x}], lambda t: CASE WHEN contains(t, '&') THEN array_to_string(list_transform(list_zip({pieces}, {resolved}), lambda z: z[1] || coalesce(z[2], '')), '') ELSE t END)[1]"


def text_sql(x: str) -> str:
    return f"trim(regexp_replace(replace(replace({unescape_sql(f'regexp_replace({x}, ' + repr('<[^>]+>') + ', ' + repr(' ') + ', ' + repr('g') + ')')}, '�', ''), ' ', ' '), '\\s+', ' ', 'g'))"


def escape_sql(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


TITLE_SQL = f"trim({unescape_sql(chr(114) + 'egexp_extract(html, ' + repr('(?is)<title[^>]*>([^<]*)</title>') + ', 1)')})"
