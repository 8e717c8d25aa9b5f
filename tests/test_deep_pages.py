"""Pages whose elements nest deeper than Python's calls may: tags that are never closed do that to any long page."""

import hashlib

import pyarrow as pa
import pytest

from newsflow import catalog
from newsflow.functions import html as H

DEPTH = 1500
WORDS = " ".join(["word"] * DEPTH)
CHAIN = [f"word{i}" for i in range(DEPTH // 2)]
BODIES = [f"<p><strong>{WORDS}</strong></p>", f"<p>{CHAIN[0]}<strong>{' '.join(CHAIN[1:])}</strong></p>", "<p>inside all of these</p>"]


@pytest.fixture(scope="module")
def deep(spark, tmp_path_factory):
    """A paragraph of nested phrases, paragraphs that each hold the next one, and a paragraph in nested sections."""
    bodies = ["<p>" + "<b>word " * DEPTH, "".join(f"<p>{w}<b>" for w in CHAIN), "<div>" * DEPTH + "<p>inside all of these</p>"]
    pages = [(n, "https://a.example.net/x", f"<html><head><title>Deep</title></head><body><article>{b}</article></body></html>") for n, b in enumerate(bodies)]
    folder = str(tmp_path_factory.mktemp("deep"))
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


def run(spark, folder, name):
    return sorted(tuple(r) for r in catalog.QUERIES[name](spark, folder).collect())


def test_paragraphs_of_deep_pages(spark, deep):
    want = [(0, 0, WORDS), *[(1, n, " ".join(CHAIN[n:])) for n in range(len(CHAIN))], (2, 0, "inside all of these")]
    assert run(spark, deep, "h11_container_paragraphs") == want


def test_an_end_tag_costs_no_walk_up_the_page():
    tree = H._Tree()
    tree.feed("<p>text<b>" * 3)
    tree.open = type("Open", (list,), {"__iter__": lambda self: pytest.fail("walks all open elements")})(tree.open)
    tree.feed("</p></i>")
    assert [e.name for e in list.__iter__(tree.open)] == ["root", "p", "b", "p", "b"]


def test_extract_and_clean_deep_pages(spark, deep):
    assert run(spark, deep, "h12_extract_and_clean") == [(0, "Deep", 1), (1, "Deep", len(CHAIN)), (2, "Deep", 1)]


def test_live_body_of_deep_pages(spark, deep):
    assert run(spark, deep, "h15_live_body") == [(n, len(b)) for n, b in enumerate(BODIES)]


def test_dom_walk_of_deep_pages(spark, deep):
    assert run(spark, deep, "h17_dom_walk") == [(0, 0, "p", WORDS), (1, 0, "p", " ".join(CHAIN)), (2, 0, "p", "inside all of these")]


def test_sanitize_deep_pages(spark, deep):
    assert run(spark, deep, "h1_sanitize") == list(enumerate(BODIES))


def test_container_of_deep_pages(spark, deep):
    assert run(spark, deep, "h3_container") == list(enumerate(BODIES))


def test_blocks_of_deep_pages(spark, deep):
    assert run(spark, deep, "h8_blocks") == [(n, 0, "text", text, False, None) for n, text in enumerate([WORDS, " ".join(CHAIN), "inside all of these"])]


def test_blocks_below_nested_phrases():
    (found,) = H.blocks.func(iter([pa.array(["<span>" * DEPTH + "some text"])]))
    assert found.to_pylist() == [[{"type": "text", "text": "some text", "bold": False, "src": None}]]


def test_detail_pages_that_are_deep(spark, deep):
    assert run(spark, deep, "r24_detail_pages") == [(n, hashlib.md5(b.encode()).hexdigest()) for n, b in enumerate(BODIES)]


def test_extractor_registry_on_deep_pages(spark, deep):
    assert run(spark, deep, "u1_extractor_registry") == [(n, "Deep", 1) for n in range(3)]
