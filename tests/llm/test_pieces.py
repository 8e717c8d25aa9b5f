import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from newsflow.llm import pieces

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))
OWN = sentencepiece.SentencePieceProcessor(model_file=PATH)


@given(st.text())
@settings(max_examples=300, deadline=None)
def test_ids_and_spans_are_the_librarys(text):
    text = text.encode("utf-8", "ignore").decode()
    (ids, begins, ends), = pieces.model(PATH).encode([text])
    assert ids == OWN.encode(text)
    raw = text.encode()
    assert b"".join(raw[b:e] for b, e in zip(begins, ends)) == raw


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@given(text=st.one_of(st.text(), st.text(alphabet=" \t 　ﬁⅣ①ａＡÅｶﾞé́ẛ​﻿xyz")))
@settings(max_examples=300, deadline=None)
def test_compiled_map_normalises_as_the_library(rule, text):
    text = text.encode("utf-8", "ignore").decode().replace("\0", "")
    normaliser = sentencepiece.SentencePieceNormalizer(rule_name=rule, remove_extra_whitespaces=True)
    own = pieces.Model.__new__(pieces.Model)
    spec = next(v for n, _, v, _ in pieces._fields(normaliser.serialized_model_proto()) if n == 3)
    own.map = pieces.CharacterMap({n: v for n, _, v, _ in pieces._fields(spec)}[2])
    own.prefix = own.squeeze = own.escape = True
    shown, places = own.normalise(text)
    assert shown == normaliser.normalize(text)
    assert len(places) == len(shown.encode()) + 1 and all(a <= b for a, b in zip(places, places[1:]))


def test_documents_and_edges(spark):
    rows = [(1, "Hello  wörld\n"), (1, "Hello  wörld\n"), (2, None), (3, ""), (None, "x" * 20000), (4, "😀 ▁ \t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'clash' AS ids")
    got = pieces.encode_documents(docs, PATH, rows_at_once=2).collect()
    assert sorted((r["doc_id"] or 0, tuple(r["ids"]), r["decoded"]) for r in got) == sorted((i or 0, tuple(OWN.encode(t or "")), OWN.decode(OWN.encode(t or ""))) for i, t in rows)
    assert pieces.encode_documents(docs.limit(0), PATH).count() == 0
