import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsflow.llm import lm_score, packing, sharding, tool_calls, toxicity

TOKENIZER = str(public_tokenizers.path("byte_bpe_50k.json"))


# ---- toxicity ---------------------------------------------------------------


def kernel(s, t):
    """The subsequence kernel by its definition: all pairs of equal subsequences of three characters within five."""

    def weights(w):
        out = Counter()
        for a, b in toxicity.STEPS:
            for i in range(len(w) - a - b):
                out[w[i], w[i + a], w[i + a + b]] += toxicity.DECAY ** (a + b - 2)
        return out

    a, b = weights(s), weights(t)
    return sum(v * b[k] for k, v in a.items())


def sharpened(s, t):
    return (kernel(s, t) / math.sqrt(kernel(s, s) * kernel(t, t))) ** toxicity.SHARP if kernel(s, s) and kernel(t, t) else 0.0


def test_kernel_by_its_definition():
    marks = ["idiot", "réeux", "worthles", "дурак", "fdp"]
    words = [*marks, "idi.ot", "i-d-i-o-t", "xxidiotxx", "id", "", "réeuxment", "worthless", "other", "привет", "слово", "书书书书书", "ab" * 100, "idiot" * 3000]
    got = toxicity.Landmarks.of(marks).kernel(words)
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            assert math.isclose(got[i, j], sharpened(w, m), rel_tol=1e-9, abs_tol=1e-12)
    assert np.allclose(got[:5], got[:5].T) and np.allclose(np.diag(got[:5]), 1)
    assert got[13:16].max() < 0.05  # scripts have letters of their own


def test_features_and_machine_by_brute_force():
    rows = sentences(200, 3)
    texts, toxic = [t for _, t, _ in rows], np.array([y for *_, y in rows])
    model = toxicity.fit(texts, toxic)
    marks = model.landmarks.words
    gram = np.array([[sharpened(a, b) for b in marks] for a in marks])
    value, vector = np.linalg.eigh(gram)
    half = vector / np.sqrt(np.maximum(value, toxicity.RIDGE)) @ vector.T
    known = {}

    def values(w):
        if w not in known:
            known[w] = np.array([sharpened(w, m) for m in marks])
        return known[w]

    features = np.array([sum(map(values, toxicity.words_of(t)), np.zeros(len(marks))) @ half for t in texts])
    x, y = (features - features.mean(axis=0)) / (features.std(axis=0) + 1e-3), 2 * toxic - 1
    margins = model.margins(toxicity.WordCache(model.landmarks).pooled(texts))
    assert np.allclose(margins, x @ model.weights[:-1] + model.weights[-1], atol=1e-6)
    # the machine's objective lies at the least value that plain subgradient steps find
    cost = 0.02
    x1 = np.hstack([x, np.ones((len(x), 1))])
    goal = lambda w: 0.5 * w @ w + cost * np.maximum(0, 1 - y * (x1 @ w)).sum()
    w, least = np.zeros(x1.shape[1]), np.inf
    for step in range(1, 4000):
        bad = y * (x1 @ w) < 1
        w = w - (w - cost * (y[bad, None] * x1[bad]).sum(axis=0)) / (step + 10)
        least = min(least, goal(w))
    assert goal(model.weights) <= least * 1.01


def test_clean_texts_of_other_scripts_stay(spark):
    rng = random.Random(2)
    rows = sentences(600, 5)
    cyrillic = [" ".join("".join(rng.choice("абвгдежзиклмнопрст") for _ in range(rng.randrange(3, 9))) for _ in range(40)) for _ in range(150)]
    chinese = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(80)) for _ in range(100)]
    rows += [(1000 + i, t + (" дурачина болван" if i % 2 else ""), i % 2) for i, t in enumerate(cyrillic)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(3000 + i, t) for i, t in enumerate(chinese)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    assert not any(got[3000 + i]["predicted"] for i in range(len(chinese)))
    held = [i for i in range(1000, 1150) if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == i % 2 for i in held]) > 0.95


def sentences(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["an", "er", "th", "ti", "on", "he", "wh"]) for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        if toxic := i % 3 == 0:
            for _ in range(4):
                insult = rng.choice(["blorgface", "snizzle"])
                if rng.random() < 0.3:
                    at = rng.randrange(1, len(insult))
                    insult = insult[:at] + rng.choice("-._") + insult[at:]
                text.insert(rng.randrange(len(text)), insult)
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_training_holds_the_words_of_a_few_texts_at_once():
    texts = [" ".join(f"w{i}x{j}" for j in range(100)) for i in range(2500)]
    toxicity.WordCache(marks := toxicity.Landmarks.of(["idiot"])).pooled(texts[:10])
    tracemalloc.start()
    try:
        got = toxicity.WordCache(marks, 5000).pooled([*texts, "idiot"])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.shape == (2501, 1) and got[-1, 0] > 0.99 and not got[:-1].any()
    assert peak < 30e6  # all words at once take 55 MB


def test_held_out_accuracy_and_edges(spark):
    rows = sentences(900, 7)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (5002, "a" * 2000 + " b l o r g f a c e snizz_le blorgface s n i z z l e"), (None, "x"), (1, rows[1][1])], "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, 1), (2, None), (None, 1), (1, 0)], "doc_id bigint, toxic int")
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert np.mean([truth[r["doc_id"]] == r["predicted"] for r in held]) > 0.97
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[5000] == by_id[5001] < 0.5 < by_id[5002]
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id = 5002").count() == 0


def test_labels_of_one_kind(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")
    only = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id bigint, toxic int")
    assert [r["score"] for r in toxicity.score_documents(docs, only).collect()] == [1.0, 1.0]
    assert [r["score"] for r in toxicity.score_documents(docs, only.limit(0)).collect()] == [0.0, 0.0]
    assert toxicity.score_documents(docs.limit(0), only).count() == 0


# ---- sharding ---------------------------------------------------------------


def test_shards_are_near_equal_and_slots_gapless(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.choice([10, 200, 3000]), rng.choice(["s0", "s0", "s1", None]), rng.choice(["en", "de"])) for i in range(3000)]
    rows += [(9000 + i, "the same text " * 20, "s0", "en") for i in range(1500)] + [(1, "y" * 50, "s1", "de")] * 40 + [(None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").withColumn("shard", F.lit("clash"))
    got = sharding.shard_documents(docs).toPandas()
    assert len(got) == len(rows) and set(got.shard) == set(range(40)) and got.grown_shard.isna().all()
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 2.5 * 3016
    assert all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard").slot)
    truth = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows if i is not None)
    seen = Counter(zip(got["doc_id"].fillna(-1).astype(int), got["size"], got["text_crc32"], strict=True))
    assert {k: v for k, v in seen.items() if k[0] >= 0} == dict(truth)
    few = sharding.shard_documents(docs.limit(3)).toPandas()
    assert len(few) == 3 and few["shard"].between(0, 39).all()
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def brute_tree(rows, shards, first=0):
    """Shard of each row (place along each dimension, tie, size) by sorting at every node."""
    if shards == 1 or not rows:
        return {r: first for r in rows}
    dim = max(range(len(rows[0][0])), key=lambda d: (max(r[0][d] for r in rows) - min(r[0][d] for r in rows), -d))
    ordered = sorted(rows, key=lambda r: (r[0][dim], r[1]))
    want, total, left = sum(r[2] for r in rows) * (shards // 2) / shards, 0, []
    for r in ordered:
        if total + r[2] > want and total + r[2] - want >= want - total:
            break
        total += r[2]
        left.append(r)
    return brute_tree(left, shards // 2, first) | brute_tree(ordered[len(left) :], shards - shards // 2, first + shards // 2)


def test_tree_by_brute_force(spark):
    rng = random.Random(11)
    rows = [((rng.randrange(1, 50), rng.randrange(1, 1000)), rng.randrange(1 << 30), rng.randrange(16, 400)) for _ in range(3000)]
    table = spark.createDataFrame([(x[0], x[1], t, s) for x, t, s in rows], "x0 long, x1 long, tie long, size long")
    root = sharding.build_tree(table, 2, 13, tolerance=0)
    placed = table.select("*", sharding._place(root).alias("shard")).collect()
    want = brute_tree(rows, 13)
    assert all(want[((r["x0"], r["x1"]), r["tie"], r["size"])] == r["shard"] for r in placed)


def test_shards_reach_target_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 300), "s", "en") for i in range(2000)], "doc_id bigint, text string, source string, lang string")
    got = sharding.shard_documents(docs, target_bytes=20_000).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == -(-sizes.sum() // 20_000) and sizes.max() <= 20_000 + 316


# ---- packing ----------------------------------------------------------------


def test_plan_places_every_length():
    rng = random.Random(4)
    for width in (8, 64, 2048):
        for _ in range(20):
            histogram = {rng.randrange(1, width + 1): rng.randrange(1, 500) for _ in range(rng.randrange(1, 60))}
            plan = packing.plan_packs(histogram, width)
            placed = Counter()
            for pattern, n in plan:
                assert sum(pattern) <= width and n > 0
                for length in pattern:
                    placed[length] += n
            assert placed == Counter(histogram)
    assert packing.plan_packs({}) == []


def test_fast_encoder_equals_the_tokenizer():
    exact = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(5)
    letters = "ab cdé ñ\n\t\r 12'sßŒ-–…€\"$%ſ¿ " + "".join(map(chr, range(0xA1, 0x180)))
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(500)]
    texts += ["a<|endoftext|>b", "日本語 text", "", " \x1c\x85 ", "x" * 5000, "don't  we'll   ", "😀é́"]
    assert list(packing.encode_ids(texts, TOKENIZER)) == [exact.encode(t, add_special_tokens=False).ids for t in texts]


def test_packs_by_brute_force(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([1, 5, 400, 2500]))) for _ in range(120)] + [None, "", "", "same words"] + ["same words"] * 100
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3]), (None, "no id")], "doc_id bigint, text string").withColumn("offset", F.lit("clash"))
    pieces = packing.token_pieces(docs, TOKENIZER)
    got = packing.pack(pieces.withColumn("first", F.lit(1)).withColumn("Offset", F.lit("clash")))
    assert [c.lower() for c in got.columns].count("offset") == 1
    got = got.collect()
    exact = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for i, t in [*enumerate(texts), (3, texts[3]), (None, "no id")]:
        ids = [*exact.encode(t or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), 2048):
            want[(i, s, len(ids[s : s + 2048]), len(ids), np.array(ids[s : s + 2048], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["doc_tokens"], bytes(r["ids"])) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(pieces.limit(0)).count() == 0


# ---- language model ---------------------------------------------------------


def brute_scores(texts, order, least):
    """Every document under the counts of all others."""
    docs = [(t or "").encode().translate(lm_score._LOWER).split() for t in texts]
    grams = lambda d, k: Counter(tuple(d[i : i + k]) for i in range(len(d) - k + 1))
    counts = [sum((grams(d, k) for d in docs), Counter()) for k in range(1, order + 1)]
    total = sum(map(len, docs))
    out = []
    for d in docs:
        own = [grams(d, k) for k in range(1, order + 1)]
        c = lambda g: counts[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: B023, E731
        s = 0.0
        for i in range(len(d)):
            longest = min(order, i + 1)
            for k in range(longest, 0, -1):
                g = tuple(d[i - k + 1 : i + 1])
                if k == 1 or c(g) >= least:
                    s += math.log(max(c(g), k == 1) / (c(g[:-1]) if k > 1 else max(total - len(d), 1))) + (longest - k) * math.log(0.4)
                    break
        out.append((len(d), s))
    return out


def test_scores_by_brute_force(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("a A b c d e f É".split()) for _ in range(rng.randrange(0, 40))) for _ in range(150)] + [None, "", "one", "x y", "hot words again " * 400] + ["hot words again"] * 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("block", F.lit("clash")).repartition(3)
    for order, least, group in ((3, 1, 4096), (3, 2, 2), (2, 1, 1), (1, 1, 3), (4, 3, 4096)):
        got = {r["doc_id"]: r for r in lm_score.score_documents(docs, order=order, min_count=least, block_words=300, group_blocks=group).collect()}
        for i, (n, s) in enumerate(brute_scores(texts, order, least)):
            assert got[i]["n_tokens"] == n and math.isclose(got[i]["log_score"], s, rel_tol=1e-9, abs_tol=1e-9)
            assert got[i]["mean_log_score"] is None if n == 0 else math.isclose(got[i]["mean_log_score"], s / n, rel_tol=1e-9)
    assert lm_score.score_documents(docs.limit(0)).count() == 0
    alone = lm_score.score_documents(docs.where("doc_id = 153")).first()
    assert alone["n_tokens"] == 2 and math.isclose(alone["log_score"], math.log(0.4))


def test_counts_of_one_group_are_keyed_by_bucket_alone(spark):
    """One exchange for both sides of the join, and the same answers with and without parts."""
    entries = spark.createDataFrame([(b, n, [1, 2 + n % 3, 9], [1, 1 + n, 2]) for b in range(3) for n in range(20)], "bucket long, block long, keys array<long>, counts array<int>")
    one = lm_score._counted(entries, 1)
    several = lm_score._counted(entries.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(3))), 3)
    plain = lambda df: sorted((r.bucket, r.block, sorted(zip(r["at"], r["count"], strict=True))) for r in df.collect())
    assert plain(one) == plain(several) and len(plain(one)) == 60
    assert "part#" not in one._jdf.queryExecution().optimizedPlan().toString()


def test_ngrams_of_one_group_are_no_rows(spark):
    """A bucket's n-grams are counted as arrays, not laid out as a row for each block and n-gram."""
    entries = spark.createDataFrame([(5, 1, [7, 8, 9], [1, 2, 3]), (5, 2, [9, 6], [4, 1]), (6, 1, [9], [2]), (6, 3, [8, 9], [1, 1 << 30]), (6, 4, [9], [1 << 30])], "bucket long, block long, keys array<long>, counts array<int>")
    got = lm_score._counted(entries, 1)
    assert sorted((r.bucket, r.block, r["at"], r["count"]) for r in got.collect()) == [(5, 1, [2], [7]), (5, 2, [0], [7]), (6, 1, [0], [2 + (1 << 31)]), (6, 3, [1], [2 + (1 << 31)]), (6, 4, [0], [2 + (1 << 31)])]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_words_keep_apart():
    """Every word has a hash of its own, whatever its length, its zero bytes and what stands around it."""
    rng = random.Random(3)
    words = {"".join(rng.choice("a\0é\u3042z") for _ in range(rng.randrange(1, 20))).encode() for _ in range(5000)} | {b"x" * n for n in range(1, 40)} | {b"x" + b"\0" * n for n in range(40)}
    words = sorted(words)
    text = b"".join(w + rng.choice([b" ", b"\t\n", b"\x0b\x0c\r "]) for w in [*words, *words[::-1]])
    begins, ends = lm_score._words(np.frombuffer(text, np.uint8))
    assert [text[i:j] for i, j in zip(begins, ends, strict=True)] == text.split() == [*words, *words[::-1]]
    for half in lm_score._hashes(text, begins, ends):
        assert len(set(half.tolist())) == len(words) and (half[: len(words)] == half[len(words) :][::-1]).all()


def test_equal_keys_lie_together_in_order():
    for keys in ([], [5], [3, 3], [1 << 63, 0, 1, 0, 1, 2, 1 << 63, 1], [rng_key % 7 << 60 | rng_key % 3 for rng_key in range(500)]):
        keys = np.array(keys, np.uint64)
        assert lm_score._sorted(keys).tolist() == np.argsort(keys, kind="stable").tolist()


def test_odd_words_by_brute_force(spark):
    rng = random.Random(5)
    odd = ["a", "A", "a\0", "a\0\0", "\0", "é", "É", "x" * 15, "x" * 16, "X" * 16, "x" * 17, "\u3042" * 5, "\u3042" * 6, "\xa0", "\x1c", "\x85"]
    texts = [rng.choice(" \t\n\x0b\x0c\r").join(rng.choice(odd) for _ in range(rng.randrange(0, 30))) for _ in range(120)] + [" ", " a", "a ", "\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in lm_score.score_documents(docs, block_words=200).collect()}
    for i, (n, s) in enumerate(brute_scores(texts, 3, 1)):
        assert got[i]["n_tokens"] == n and math.isclose(got[i]["log_score"], s, rel_tol=1e-9, abs_tol=1e-9)


def test_a_document_that_occurs_twice_is_told_apart(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(WORDS) for _ in range(80)) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (100, texts[7])], "doc_id bigint, text string")
    got = {r["doc_id"]: r["mean_log_score"] for r in lm_score.score_documents(docs).collect()}
    assert got[7] == got[100] > max(v for i, v in got.items() if i not in (7, 100))


WORDS = [f"w{i}" for i in range(400)]


# ---- tool calls -------------------------------------------------------------

SCHEMA = {"find": {"type": "object", "required": ["q"], "properties": {"q": {"type": "string"}, "n": {"type": "integer"}, "u": {"enum": ["km", "mi"]}}, "additionalProperties": False}}
MESSAGES = "conv_id bigint, turn bigint, role string, kind string, call_id string, name string, content string"


def test_tool_calls(spark):
    rows = [
        (1, 0, "system", "message", None, None, 'say "hi"\n'),
        (1, 1, "assistant", "call", "a", "find", '{ "q": "x", "n": 2.0, "u":"km" }'),
        (1, 3, "tool", "result", "a", None, "found"),
        (1, 4, "tool", "result", "b", None, "early"),
        (1, 5, "assistant", "call", "b", "find", '{"n": "two", "z": 1, "u": "ft"}'),
        (1, 6, "assistant", "call", "c", "none", "{}"),
        (1, 7, "tool", "result", "zz", None, None),
        (1, 8, "user", None, "a", None, "no kind"),
        (1, 9, "user", "shout", None, None, "other kind"),
        (2, 1, "tool", "result", "a", None, "other conversation"),
        (2, 2, "assistant", "call", None, "find", "broken"),
        (None, 1, "assistant", "call", "a", "find", '{"q":"x","q":"x"}'),
        (3, 1, "assistant", "call", "d", "find", '{"q":"x"}'),
        (3, 2, "assistant", "call", "d", "find", '{"q":"y"}'),
        (4, None, "user", "message", None, None, "y" * 300_000),
    ] + [(3, i, "tool", "result", "d", None, "r") for i in range(3, 200)]
    got = {(r["conv_id"], r["turn"]): r for r in tool_calls.link_tool_calls(spark.createDataFrame(rows, MESSAGES).withColumn("key", F.lit(1)), SCHEMA).collect()}
    assert len(got) == len(rows)
    assert got[1, 0]["json"] == '{"content":"say \\"hi\\"\\n","role":"system"}'
    assert got[1, 1]["json"] == '{"arguments":{"n":2,"q":"x","u":"km"},"call_id":"a","name":"find","role":"assistant"}'
    assert got[1, 1]["errors"] == "" and got[1, 1]["linked"] and got[1, 3]["linked"]
    assert got[1, 5]["errors"] == "q: missing; n: not integer; u: not in enum; z: unknown property"
    assert got[1, 6]["errors"] == "unknown tool; no result" and got[1, 7]["errors"] == "no call" and got[1, 7]["json"] == '{"call_id":"zz","content":null,"role":"tool"}'
    assert got[1, 8]["errors"] == got[1, 9]["errors"] == "unknown kind" and got[1, 8]["linked"] is None
    assert got[2, 1]["errors"] == "no call" and got[2, 2]["errors"] == "malformed arguments; no result" and got[None, 1]["errors"] == "q: named twice; no result"
    order = sorted((r["position"], r["turn"]) for k, r in got.items() if k[0] == 1)
    assert order == list(enumerate([0, 1, 3, 5, 4, 6, 7, 8, 9]))
    assert all(got[3, i]["linked"] for i in range(1, 200)) and sorted(r["position"] for k, r in got.items() if k[0] == 3) == list(range(199))
    assert tool_calls.link_tool_calls(spark.createDataFrame([], MESSAGES), SCHEMA).count() == 0


def test_calls_that_need_results_are_ordered(spark):
    rng = random.Random(12)
    rows, needs_of = [], {}
    for conv in range(30):
        ids = [f"c{i}" for i in range(rng.randrange(2, 9))]
        for i, c in enumerate(ids):
            needs = sorted(rng.sample(ids, rng.randrange(0, min(3, len(ids)))) if conv % 3 == 0 else rng.sample(ids[:i], rng.randrange(0, min(3, i + 1))))
            needs_of[conv, c] = needs + (["none"] if rng.random() < 0.1 else [])
            rows.append((conv, rng.randrange(20), "assistant", "call", c, "find", '{"q":"x"}', needs_of[conv, c]))
            rows += [(conv, rng.randrange(20), "tool", "result", c, None, "r", None) for _ in range(rng.randrange(0 if conv % 4 == 1 else 1, 3))]
    got = tool_calls.link_tool_calls(spark.createDataFrame(rows, MESSAGES + ", needs array<string>"), SCHEMA).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault((r["conv_id"], r["call_id"], r["kind"]), []).append(r)
    for conv in range(30):
        assert sorted(r["position"] for r in got if r["conv_id"] == conv) == list(range(sum(x[0] == conv for x in rows)))
        # circles by brute force: what can't be peeled off
        calls = [c for k, c in needs_of if k == conv]
        waits = {c: {n for n in needs_of[conv, c] if n in calls and (conv, n, "result") in by} for c in calls}
        done = set()
        while new := {c for c in calls if c not in done and waits[c] <= done}:
            done |= new
        for c in calls:
            call = by[conv, c, "call"][0]
            assert ("circle of needs" in call["errors"]) == (c not in done)
            assert call["errors"].count("needs a result") == sum(1 for n in set(needs_of[conv, c]) if n not in calls or (conv, n, "result") not in by)
            for r in by.get((conv, c, "result"), []):
                assert r["position"] > call["position"]
            for n in waits[c] if c in done else ():
                assert call["position"] > min(r["position"] for r in by[conv, n, "result"])


def test_canonical_json_and_schemas():
    same = lambda t: tool_calls.canonical(tool_calls.parse_json(t)[0])
    assert [same(x) for x in ("1e2", "100", "100.0", "1.50", "-0.0", "1e21", "1e20", "123e-8", "0.000001", "100000000000000000000000000000.0", "1E400")] == ["100", "100", "100", "1.5", "0", "1e+21", "100000000000000000000", "0.00000123", "0.000001", "1e+29", "1e+400"]
    assert same('{"b": [1, {"z": null, "a": true}], "a": "\\u00e9\\ud800"}') == '{"a":"é\\ud800","b":[1,{"a":true,"z":null}]}'
    for broken in ("", "{", "NaN", "[" * 100_000, "1 2"):
        try:
            tool_calls.parse_json(broken)
            raise AssertionError(broken[:9])
        except ValueError:
            pass
    schema = {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 1}}}, "maxItems": 2}, "s": {"type": ["string", "null"], "pattern": "^x"}, "o": {"anyOf": [{"const": 1.0}, {"type": "string", "minLength": 2}]}}, "additionalProperties": {"type": "boolean"}}
    found = lambda t: list(tool_calls.violations(tool_calls.parse_json(t)[0], schema))
    assert found('{"a": [{"k": 1e29}, {"k": 2.0}], "s": null, "o": 1, "z": true}') == []
    assert found('{"a": [{"k": 0}, {}, 3], "s": "y", "o": "q", "z": 1}') == ["a: more than maxItems", "a[0].k: beyond minimum", "a[1].k: missing", "a[2]: not object", "o: none of anyOf", "s: no match of pattern", "z: not boolean"]
    try:
        tool_calls.check_schema({"properties": {"a": {"dependencies": {}}}})
        raise AssertionError
    except ValueError as e:
        assert "dependencies" in str(e)
