"""Main text of web pages by the paths that the pages of a host agree on.

A page is read as a sequence of blocks (paragraphs, headings, list items, table rows, quotes, bare text between them), each with the chain of containers it
lies in. A container's path is generalised: its tags from the root on with their classes, digits as `#`. Menus, headers, footers, sidebars, forms, notices,
adverts and reader comments, known by tag, role, class or id, are left out, and so are lists of links alone.

1. Each page scores its paths: a block gives its unlinked characters to the container it lies in, and REACH of that to each one further out. An article or
   main element around the best one takes its place. The page votes for the best path.
2. Votes are summed by host and path in Spark; a host keeps its `most` paths with two votes or more. A host that holds a third of all pages is summed before the shuffle,
   and its one row of paths is broadcast.
3. Each page is read again: among its host's winning paths that it has, the one with most votes times its share of the page's best score is extracted, all
   containers with that path in page order. A page that has none of them is extracted by its own best path.

Defined results: a null or empty page gives an empty text, and so does one without text; plain text without tags is one block; null URLs
are one host; pages are read whole, however long, cut-off ones up to their end (an unfinished tag or comment holds no text); repeated rows are extracted one by one; among equal
scores the outer path, then the smaller one, wins; an empty table gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.llm.common import discard, join_hot, materialize

#: What a container further out gets of what the one inside it got.
REACH = 0.6
#: Text that an article around the best container may have besides, as a multiple of that container's.
AROUND = 2.0
#: Paths that a host keeps.
MOST_PATHS = 32

#: Containers below this depth count as the one at it.
DEPTH = 256

# Elements whose content is no text of the page, up to the page's end or only if they are closed; elements left out
# wherever they are; parts of class, id and role names of what is no article; whole names of what only looks like an article;
# elements that begin a block; those that can hold an article; those that have no content; and what closes an open element of the same kind.
RAW = "script|style"
CLOSED = "noscript|template|textarea|title|iframe|svg|math|select|button|object|canvas|audio|video"
LEFT_OUT = frozenset("nav footer aside form menu dialog datalist".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle adsense alert alerts banner banners billboard breadcrumb breadcrumbs "
    "comment comments commentlist complementary consent contentinfo cookie cookies disqus footer gdpr login masthead menu menubar "
    "menus modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup promo "
    "promos promoted promotion recommended related reply replies respond responses search share sharing shares sidebar sidebars signup "
    "social sponsor sponsored subscribe subscription taboola teaser teasers toolbar topbar widget widgets".split()
)
NO_ARTICLE = frozenset("ad advert card comment promo related reply sponsored teaser".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CONTAINERS = frozenset("html body article main section div td center details blockquote figure table tbody tr ul ol dl header".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: An open element of these kinds stops the search for what a tag closes.
BARS = frozenset("table ul ol dl body html".split())
BARS_OF_P = BARS | CONTAINERS

# A tag ends at the first > outside quotes; a quote that is never closed is a character like others.
_REST = r"(?:\"[^\"]*\"|'[^']*'|[^>])*?"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>]){_REST}(?:>.*?(?:</(?P=raw)[^>]*>|\Z)|\Z)|<(?P<closed>{CLOSED})(?=[\s/>]){_REST}>.*?</(?P=closed)\s*>"
    rf"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>{_REST})(?P<close>>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"']|$)""", re.I)
_WORD = re.compile(r"[a-z]+")
_NUMBERED = re.compile(r"[a-z]*[0-9][a-z0-9]*")
#: Names that say what an element goes with, not what it is.
_ABOUT = frozenset("has is no not with without".split())


class _Element:
    __slots__ = ("tag", "path", "out", "inside", "listed")

    def __init__(self, tag: str, path: int, out: str, inside: bool, listed: bool):
        self.tag, self.path, self.out, self.inside, self.listed = tag, path, out, inside, listed


def _described(tag: str, rest: str, inside: bool) -> tuple[str, bool]:
    """An element's step in a path, and whether its names mark it as no part of an article. inside: whether it lies in one."""
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(rest)} if rest.strip() else {}
    classes = found.get("class", "").lower().split()
    if tag == "article":
        out = not NO_ARTICLE.isdisjoint(classes)
    elif tag in ("html", "body", "main"):
        out = False
    else:
        parts = [_WORD.findall(name) for name in (*classes, found.get("id", "").lower(), found.get("role", "").lower())]
        names = {w for words in parts if words and words[0] not in _ABOUT for w in words}
        out = not NOISE.isdisjoint(names) or ("header" in names and not inside)
    return ".".join([tag, *sorted({_NUMBERED.sub("#", c) for c in classes})]), out or "hidden" in found


@dataclass
class Block:
    """A block's text, the characters of it outside links, the path it lies at, and whether it is part of a list."""

    text: str
    unlinked: int
    path: int
    listed: bool


class Page:
    """The blocks of a page that may belong to an article, in page order, and its container paths: path 0 is the page, any other
    a step below its parent, which has a smaller number."""

    def __init__(self, page: str, by_names: bool = True):
        self.parents, self.steps, self.depths = [-1], [""], [0]
        self._known: dict[tuple[int, str], int] = {}
        self.blocks: list[Block] = []
        self._read(page, by_names)

    def _path(self, above: int, step: str) -> int:
        if self.depths[above] >= DEPTH:
            return above
        if (above, step) not in self._known:
            self._known[above, step] = len(self.parents)
            self.parents.append(above)
            self.steps.append(step)
            self.depths.append(self.depths[above] + 1)
        return self._known[above, step]

    def name(self, path: int) -> str:
        steps = []
        while path:
            steps.append(self.steps[path])
            path = self.parents[path]
        return ">".join(reversed(steps))

    def _read(self, page: str, by_names: bool) -> None:
        stack = [_Element("", 0, "", False, False)]
        text: list[str] = []
        linked, in_link, at = 0, False, 0

        def add(piece: str) -> None:
            nonlocal linked
            text.append(piece)
            if in_link:
                linked += len(piece.strip())

        def flush() -> None:
            nonlocal linked
            words = " ".join(entities.unescape("".join(text)).split()) if text else ""
            if words and not stack[-1].out:
                self.blocks.append(Block(words, max(0, len(words) - linked), stack[-1].path, stack[-1].listed))
            text.clear()
            linked = 0

        def close(tags: tuple[str, ...], bars: frozenset) -> None:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in tags:
                    del stack[i:]
                    return
                if stack[i].tag in bars:
                    return

        for m in _TOKEN.finditer(page):
            if m.start() > at:
                add(page[at : m.start()])
            at = m.end()
            tag = (m["tag"] or "").lower()
            if tag == "a":
                in_link = not m["end"]
            elif tag in ("br", "td", "th"):
                text.append(" ")
            elif tag in BLOCKS:
                flush()
                in_link = False
            if tag in VOID or not m["close"] or (tag not in BLOCKS and tag not in ("td", "th")):
                continue
            if m["end"]:
                if tag in BARS:
                    close((tag,), frozenset())
                else:
                    close((tag,), BARS_OF_P if tag == "p" else BARS)
                continue
            if tag in CLOSES:
                close(CLOSES[tag], BARS)
            elif tag in BLOCKS:
                close(("p",), BARS_OF_P)
            above = stack[-1]
            step, noise = _described(tag, m["rest"], above.inside)
            out = above.out
            if out == "form" and tag in ("article", "main"):
                out = ""  # a page that is one form
            if not out and (tag in LEFT_OUT or (by_names and noise) or (tag == "header" and not above.inside)):
                out = tag
            path = self._path(above.path, step) if tag in CONTAINERS else above.path
            stack.append(_Element(tag, path, out, above.inside or tag in ("article", "main"), above.listed or tag in ("ul", "ol")))
        if at < len(page):
            add(page[at:])
        flush()
        self._drop_menus()

    def _drop_menus(self) -> None:
        """Lists of three items or more that hold links alone go."""
        kept: list[Block] = []
        for (listed, _), run in groupby(self.blocks, lambda b: (b.listed, b.path)):
            run = list(run)
            if not (listed and len(run) >= 3 and not any(b.unlinked for b in run)):
                kept += run
        self.blocks = kept

    def below(self, path: int) -> list[bool]:
        """Whether each path is the given one or lies below it."""
        out = [False] * len(self.parents)
        out[path] = True
        for i in range(path + 1, len(out)):
            out[i] = out[self.parents[i]]
        return out

    def scores(self) -> dict[int, float]:
        """The scores of the paths that hold blocks."""
        worth = [0.0] * len(self.parents)
        for b in self.blocks:
            worth[b.path] += b.unlinked
        found = dict.fromkeys((b.path for b in self.blocks), 0.0)
        for i in range(len(worth) - 1, -1, -1):
            if worth[i] or i in found:
                found[i] = worth[i]
                if i:
                    worth[self.parents[i]] += REACH * worth[i]
                    found.setdefault(self.parents[i], 0.0)
        return found

    def best(self) -> int:
        """The path with the highest score, or that of the outermost article or main element around it that has not much more text."""
        scores = self.scores()
        best = min(scores, key=lambda p: (-scores[p], self.depths[p], self.name(p)))

        def size(path: int) -> int:
            below = self.below(path)
            return sum(b.unlinked for b in self.blocks if below[b.path])

        around, own, found = self.parents[best], size(best), best
        while around > 0:
            if self.steps[around].split(".")[0] in ("article", "main") and size(around) <= AROUND * own:
                found = around
            around = self.parents[around]
        return found

    def text(self, votes: dict[str, int]) -> str:
        """The text below the winning path that suits the page best; without one, below its own best path."""
        if not self.blocks:
            return ""
        scores = self.scores()
        there = {p: votes[name] for p in scores if (name := self.name(p)) in votes}
        path = min(there, key=lambda p: (-there[p] * scores[p], self.depths[p], self.name(p))) if there else self.best()
        below = self.below(path)
        return "\n".join(b.text for b in self.blocks if below[b.path])


def read_page(page: str | None) -> Page:
    """A page, read by its elements' names too, unless these mark all of its text as no article."""
    named = Page(page or "")
    return named if named.blocks else Page(page or "", by_names=False)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths = [], []
        for name, html in zip(*batch.columns, strict=True):
            page = read_page(html.as_py())
            if page.blocks:
                hosts.append(name.as_py())
                paths.append(page.name(page.best()))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string())], ["host", "path"])


def winning_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html", most: int = MOST_PATHS) -> DataFrame:
    """host, paths (array of path and votes) and n, the host's pages; a row for each host."""
    rows = pages.select(host(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").cast("string").alias("html"))
    votes = rows.mapInArrow(_vote, "host string, path string").groupBy("host", "path").agg(F.count("*").alias("votes"))
    best = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    won = votes.where(F.col("votes") >= 2).withColumn("n", F.row_number().over(best)).where(F.col("n") <= most)
    paths = won.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("path", "votes"))).alias("paths"))
    return rows.groupBy("host").agg(F.count("*").alias("n")).join(paths, "host", "left").select("host", "paths", "n")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most: int = MOST_PATHS) -> DataFrame:
    """id_col, url_col and text of every page."""
    paths = materialize(winning_paths(pages, url_col, html_col, most))
    kept = [F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html")]
    rows = pages.select(*kept, host(F.col(f"`{url_col}`")).alias("host"))
    total = paths.agg(F.sum("n")).first()[0] or 0
    joined = join_hot(rows, paths, "host", "n", total).select("id", "url", "html", F.transform("paths", lambda p: p["path"]).alias("paths"), F.transform("paths", lambda p: p["votes"]).alias("votes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, paths, votes in zip(*[batch.column(c) for c in ("html", "paths", "votes")], strict=True):
                texts.append(read_page(page.as_py()).text(dict(zip(paths.as_py() or [], votes.as_py() or [], strict=True))))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], [id_col, url_col, "text"])

    texts = materialize(joined.mapInArrow(run, f"`{id_col}` long, `{url_col}` string, text string"))
    discard(paths)
    return texts
