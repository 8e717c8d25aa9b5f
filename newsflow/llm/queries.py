"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.catalog.base import unescape_sql
from newsflow.llm import ann, exact_dedup, lexical, lm_score, packing, page_text, phrases, pieces, secret_scan, sharding, simhash, tool_calls, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op3_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op4_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lm_score.score_documents(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_tokens", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = tool_calls.dialogue_as_calls(_table(spark, sf_dir, "conversations"))
    return tool_calls.link_tool_calls(messages, tool_calls.REPLY)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.token_pieces(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    digested = cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(digested)


def op8_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pieces.encode_documents(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))
    # the spans' digest: their begins and ends in the original bytes, each list joined by commas
    spans = F.concat_ws(";", F.array_join("begins", ","), F.array_join("ends", ","))
    digests = [F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.sha2(spans, 256).alias("spans_sha256")]
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), *digests)


def _joined(spans, kinds=secret_scan.KINDS):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(F.array(*map(F.lit, kinds)), x["kind"]), x["start"], x["end"])), ",")


def _count(test) -> Column:
    return F.size(F.filter("s", test)).cast("long")


def _count_of(kind: int) -> Column:
    # a lambda of one argument: a second one would be the element's place
    return _count(lambda x: x["kind"] == kind)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))
    none = F.expr("cast(array() as array<struct<start:long,kind:int,end:long,live:boolean,owners:long,repos:long>>)")
    got = got.select("doc_id", F.coalesce("spans", none).alias("s"))
    counts = [_count_of(kind).alias(f"n_{name}") for kind, name in enumerate(secret_scan.KINDS[:3])]
    base = F.sha2(_joined(F.filter("s", lambda x: x["kind"] < 3)), 256).alias("base_sha256")
    judged = [_count(lambda x: x["live"]).alias("n_live"), _count(lambda x: ~x["live"]).alias("n_example")]
    return got.select("doc_id", *counts, base, _joined(F.col("s")).alias("spans"), *judged)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = page_text.extract_pages(_table(spark, sf_dir, "pages"))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_exact_dedup,
        op3_kd_tree_sharding,
        op4_stupid_backoff,
        op5_tool_calls,
        op6_simhash,
        op7_packing,
        op8_collision_counting,
        op9_secret_scan,
        op10_piece_encoding,
        op11_phrase_collocations,
        op12_ranked_search,
        op13_page_text,
    )
}

ORACLE_SQL = {
    "op5_tool_calls": r"""
        WITH m AS (
          SELECT *, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
                 'turn' || CASE role WHEN 'user' THEN turn WHEN 'assistant' THEN turn - 1 END AS call_id
          FROM conversations),
        u AS (
          SELECT conv_id, call_id, bool_or(kind = 'call') AS has_call, bool_or(kind = 'result') AS has_result
          FROM m WHERE kind <> 'message' GROUP BY ALL),
        j AS (
          SELECT m.*, CASE kind WHEN 'call' THEN has_result WHEN 'result' THEN has_call END AS linked
          FROM m LEFT JOIN u USING (conv_id, call_id))
        SELECT conv_id, turn, role, kind, call_id, linked,
               concat_ws('; ', CASE WHEN kind = 'call' AND text IS NULL THEN 'text: missing' END,
                         CASE WHEN kind = 'call' AND NOT linked THEN 'no result' WHEN kind = 'result' AND NOT linked THEN 'no call' END) AS errors,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position,
               CASE kind WHEN 'call' THEN '{"arguments":{' || CASE WHEN text IS NULL THEN '' ELSE '"text":' || to_json(text) END || '},"call_id":' || to_json(call_id) || ',"name":"reply","role":' || to_json(role) || '}'
                    WHEN 'result' THEN '{"call_id":' || to_json(call_id) || ',"content":' || coalesce(to_json(text), 'null') || ',"role":' || to_json(role) || '}'
                    ELSE '{"content":' || coalesce(to_json(text), 'null') || ',"role":' || to_json(role) || '}' END AS json
        FROM j""",
    "op4_stupid_backoff": r"""
        WITH t AS (
          SELECT row_number() OVER () AS r, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
          FROM documents),
        w AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM t),
        g AS (
          SELECT r, i, w, lag(w) OVER d AS v, lag(w, 2) OVER d AS u
          FROM w WINDOW d AS (PARTITION BY r ORDER BY i)),
        c AS (
          -- occurrences in other documents of the word, the pair and the triple that end here
          SELECT r, i, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY r, w) AS n1,
                 count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY r, v, w) AS n2,
                 count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY r, u, v, w) AS n3,
                 (SELECT count(*) FROM w) - count(*) OVER (PARTITION BY r) AS others
          FROM g),
        b AS (SELECT *, lag(n1) OVER d AS k1, lag(n2) OVER d AS k2 FROM c WINDOW d AS (PARTITION BY r ORDER BY i)),
        s AS (
          SELECT r, i,
                 CASE WHEN i >= 2 AND n3 >= 1 THEN ln(n3 / k2)
                      WHEN i >= 1 AND n2 >= 1 THEN ln(n2 / k1) + CASE WHEN i >= 2 THEN ln(0.4) ELSE 0 END
                      ELSE ln(greatest(n1, 1) / greatest(others, 1)) + least(i, 2) * ln(0.4) END AS l
          FROM b)
        SELECT t.doc_id, count(s.i) AS n_tokens, round(coalesce(sum(s.l), 0), 3) AS log_score,
               round(sum(s.l) / count(s.i), 6) AS mean_log_score
        FROM t LEFT JOIN s ON t.r = s.r GROUP BY t.r, t.doc_id""",
    "op2_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
                 length(coalesce(text, '')) AS n
          FROM documents),
        w AS (
          SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                 first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w""",
    "op11_phrase_collocations": r"""
        WITH p AS (
          SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
          FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
        g AS (
          SELECT lang, ws[i:i + k - 1] AS g
          FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k))),
        f AS (SELECT lang, g, count(*) AS f FROM g GROUP BY lang, g),
        c AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1 AND f >= 30),
        k AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM c),
        s AS (
          SELECT k.lang, k.g, k.a, k.k, x.f AS l, y.f AS r, (2000000::HUGEINT * k.a // (x.f + y.f))::BIGINT AS score
          FROM k JOIN f x ON x.lang = k.lang AND x.g = k.g[1:k.k] JOIN f y ON y.lang = k.lang AND y.g = k.g[k.k + 1:]),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
        i AS (
          SELECT lang, g[j:j + n - 1] AS g, max(a) AS around
          FROM (SELECT lang, g, a, n, unnest(range(1, len(g) - n + 2)) AS j FROM c, (SELECT unnest([2, 3]) AS n) WHERE n < len(g))
          GROUP BY ALL),
        r AS (
          SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(b.g, ' ')) AS rank,
                 array_to_string(b.g, ' ') AS phrase, a, l, r, score
          FROM b LEFT JOIN i USING (lang, g) WHERE around IS NULL OR 100 * around < 80 * a)
        SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score
        FROM r JOIN (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang) USING (lang) WHERE rank <= 2000""",
    "op12_ranked_search": r"""
        WITH d AS (
          SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
          FROM documents),
        t AS (SELECT d, doc_id, len(ts) AS n, unnest(ts) AS term FROM d),
        c AS (SELECT d, doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
        s AS (SELECT count(*) AS docs, sum(len(ts))::BIGINT AS total FROM d WHERE len(ts) > 0),
        f AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM c, s GROUP BY term, docs),
        q AS (
          SELECT item_id, text, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
          FROM (SELECT DISTINCT item_id, text FROM benchmark)),
        x AS (
          SELECT item_id, text, d, doc_id,
                 sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total))))::BIGINT AS score
          FROM q JOIN f USING (term) JOIN c USING (term), s GROUP BY ALL)
        SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
        FROM x WHERE score > 0 QUALIFY rank <= 50""",
    # the pages of the tables hold their article in one element, made of a heading and paragraphs
    "op13_page_text": r"""
        WITH a AS (
          SELECT row_number() OVER () AS r, page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:h1|p)>') AS parts
          FROM pages),
        b AS (SELECT r, unnest(parts) AS html, unnest(range(len(parts))) AS i FROM a),
        c AS (SELECT r, i, trim(regexp_replace(UNESCAPED, '\s+', ' ', 'g')) AS text FROM b),
        d AS (SELECT r, string_agg(text, chr(10) ORDER BY i) AS text FROM c WHERE text <> '' GROUP BY r)
        SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM a LEFT JOIN d USING (r)""".replace("UNESCAPED", unescape_sql("regexp_replace(html, '<[^>]+>', ' ', 'g')")),
}
