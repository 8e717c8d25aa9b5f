"""The scan: from raw items to articles as one lazy plan, with an explicit time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.functions import html as H
from newsflow.functions import text as X
from newsflow.functions import urls as U
from newsflow.functions.matching import matched
from newsflow.operators import dedupe, lookup, store
from newsflow.operators.keywords import match_keywords
from newsflow.sources import feeds

#: Bits of `seq` below the number of a side collector.
SIDE_BITS = 48


@dataclass
class Settings:
    """What a scan is told: time, window, keywords, and which domains are special."""

    as_of: str = "2024-01-31 00:00:00"
    hours: int = 72
    keywords: list[str] = field(default_factory=list)
    topical: tuple[str, ...] = ()
    paywalled: tuple[str, ...] = ()
    wrapper_prefix: str = "https://news.example.org/"
    boilerplate: str = "comprehensive up-to-date coverage"
    fast: bool = False
    resolve_budget: int = 80

    @property
    def now(self) -> Column:
        return F.lit(self.as_of).cast("timestamp")


def within_window(at: Column, as_of: Column, hours: int) -> Column:
    """False for null, true for the future."""
    return F.coalesce(at >= as_of - F.make_dt_interval(hours=F.lit(hours)), F.lit(False))


def listed_in_window(published: Column, found: Column, as_of: Column, hours: int) -> Column:
    return F.coalesce(published, found) >= as_of - F.make_dt_interval(hours=F.lit(hours))


def recent_or_undated(at: Column, as_of: Column, hours: int) -> Column:
    return at.isNull() | (at >= as_of - F.make_dt_interval(hours=F.lit(hours)))


def _by_list(text: Column, lists: dict[tuple[str, ...], Column], settings: Settings) -> Column:
    """matched() with the keyword list that applies; each list is one pattern, so the plan stays built-in."""
    out = matched(text, settings.keywords)
    for words, applies in lists.items():
        out = F.when(applies, matched(text, list(words))).otherwise(out)
    return out


def candidates(items: DataFrame, settings: Settings, specific: dict[str, list[str]] | None = None) -> DataFrame:
    """items that may become articles, with matched_keywords: in the window (or undated, or wrapped), and either from a source that takes everything,
    a topical site, or with a keyword in slug or path (no title, no summary), title, or summary. specific: a source's own keywords, ["*"] for all."""
    specific = specific or {}
    wrapped = F.col("url").startswith(settings.wrapper_prefix)
    in_time = F.col("published_at").isNull() | within_window(F.col("published_at"), settings.now, settings.hours) | wrapped
    own = F.coalesce(*[F.when(F.col(c).isin([d for d, k in specific.items() if k]), F.col(c)) for c in ("source_domain", "feed_domain")]) if specific else F.lit(None).cast("string")
    by_words: dict[tuple[str, ...], list[str]] = {}
    for domain, words in specific.items():
        if words and words != ["*"]:
            by_words.setdefault(tuple(words), []).append(domain)
    lists = {w: F.coalesce(F.col("own").isin(d), F.lit(False)) for w, d in by_words.items()}
    takes_all = F.coalesce(F.col("own").isin([d for d, k in specific.items() if k == ["*"]]), F.lit(False))
    topical = F.col("own").isNull() & F.coalesce(F.col("feed_domain").isin(*settings.topical), F.lit(False))
    bare = (F.coalesce("title", F.lit("")) == "") & (F.coalesce("summary", F.lit("")) == "")
    place = F.when(F.col("published_at").isNull(), U.path_words(F.col("url"))).otherwise(U.slug_words(F.col("url")))
    by_title = _by_list(F.when(bare, place).otherwise(F.col("title")), lists, settings)
    by_summary = _by_list(X.cut_related(X.strip_footer(F.col("summary"))), lists, settings)
    rows = X.computed(items.where(in_time).withColumn("own", own), {"__by_title": by_title})
    found = F.when(F.size("__by_title") > 0, F.col("__by_title")).when(~bare, by_summary).otherwise(F.array().cast("array<string>"))
    rows = X.computed(rows, {"matched_keywords": F.when(takes_all, F.array(F.lit("#source"))).when(topical, F.array(F.lit("#topic"))).otherwise(found)})
    return rows.where(F.size("matched_keywords") > 0).drop("own", "__by_title")


def candidates_by_table(items: DataFrame, settings: Settings, keywords: DataFrame) -> DataFrame:
    """What `candidates` gives, for keyword lists that are tables (domain, keyword, pos; no domain for the global list) of any size: each
    text is folded and cut once, whatever list applies. `seq` must be unique."""
    wrapped = F.col("url").startswith(settings.wrapper_prefix)
    in_time = F.col("published_at").isNull() | within_window(F.col("published_at"), settings.now, settings.hours) | wrapped
    lists = keywords.where("domain is not null").groupBy("domain").agg(((F.count("*") == 1) & (F.min("keyword") == "*")).alias("all"))
    lists = lookup.small(lists)
    rows = items.where(in_time)
    for side in ("source_domain", "feed_domain"):
        rows = rows.join(lists.select(F.col("domain").alias(side), F.struct(side, F.col("all").alias("all")).alias(f"__{side}")), side, "left")
    own = F.coalesce("__source_domain", F.struct(F.col("__feed_domain.feed_domain").alias("source_domain"), F.col("__feed_domain.all").alias("all")))
    rows = rows.withColumn("__own", own).select(*items.columns, F.col("__own.source_domain").alias("__list"), F.coalesce("__own.all", F.lit(False)).alias("__all"))
    topical = F.col("__list").isNull() & F.coalesce(F.col("feed_domain").isin(*settings.topical), F.lit(False))
    bare = (F.coalesce("title", F.lit("")) == "") & (F.coalesce("summary", F.lit("")) == "")
    place = F.when(F.col("published_at").isNull(), U.path_words(F.col("url"))).otherwise(U.slug_words(F.col("url")))
    fields = F.array(F.when(bare, place).otherwise(F.col("title")), F.when(~bare, X.cut_related(X.strip_footer(F.col("summary")))))
    of_list = F.coalesce("__list", F.lit("")).alias("list")
    texts = rows.where(~F.col("__all") & ~topical).select("seq", of_list, F.posexplode(fields).alias("field", "text"))
    words = keywords.select(F.coalesce("domain", F.lit("")).alias("list"), "keyword", "pos")
    found = match_keywords(texts, words, ["seq", "field"]).groupBy("seq").agg(F.min_by("keywords", "field").alias("__found"))
    rows = rows.join(found, "seq", "left")
    rows = rows.withColumn("matched_keywords", F.when(F.col("__all"), F.array(F.lit("#source"))).when(topical, F.array(F.lit("#topic"))).otherwise(F.col("__found")))
    return rows.where(F.col("matched_keywords").isNotNull()).select(*items.columns, "matched_keywords")


def with_cache(items: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose stored snippet can be used, and the rest, to be enriched: split here, so that no page is parsed for a hit."""
    known = stored.select(F.col("url"), F.col("snippet").alias("cached_snippet"), F.col("published_at").alias("cached_published"), F.col("title").alias("cached_title"))
    joined = items.join(known, "url", "left")
    hit = F.coalesce(F.col("cached_snippet") != "", F.lit(False))
    hits = joined.where(hit).withColumn("snippet", F.col("cached_snippet")).withColumn("published_at", F.coalesce("cached_published", "published_at")).withColumn("page_title", F.col("cached_title"))
    drop = ("cached_snippet", "cached_published", "cached_title")
    return hits.drop(*drop), joined.where(~hit).drop(*drop)


def enrich(items: DataFrame, pages: DataFrame, settings: Settings) -> DataFrame:
    """items with snippet, page_title and missing dates from their stored pages (url, html): the summary if it will do, else the page's first
    paragraphs by container, its description, or its first three long paragraphs."""
    fit = lambda c: X.bound(c, lambda x: F.when((x != "") & ~F.regexp_like(x, F.lit("(?i)" + settings.boilerplate)), X.truncate(x)))
    joined = items.join(pages.select("url", "html"), "url", "left")
    rows = X.computed(joined, {"__own": X.bound(X.snippet(F.coalesce("summary", F.lit("")), settings.boilerplate), lambda x: F.when(x != "", x))})
    untitled, undated = F.coalesce("title", F.lit("")) == "", F.col("published_at").isNull()
    early = ~undated & ~untitled & (F.lit(settings.fast) | F.col("__own").isNotNull())
    from_page = ~early & ~F.col("url").startswith(settings.wrapper_prefix)
    # a page is parsed once, and only for rows that need something of it
    facts = F.when(F.col("html").isNotNull() & (from_page | untitled | undated), H.page_facts(F.col("html")))
    rows = X.computed(rows.withColumn("__from_page", from_page), {"__page": facts}).drop("html")
    first = F.array_join(F.slice(F.filter("__page.paragraphs", lambda p: F.length(p) > 40), 1, 3), " ")
    snippet = F.coalesce("__own", F.when(F.col("__from_page"), F.coalesce(fit(F.col("__page.description")), fit(first))), F.lit(""))
    found = {"snippet": snippet, "page_title": F.when(untitled, F.coalesce("__page.title", F.lit(""))).otherwise(""), "published_at": F.coalesce("published_at", "__page.published")}
    return X.computed(rows, found).drop("__own", "__from_page", "__page")


def finish(items: DataFrame, settings: Settings) -> DataFrame:
    """Articles from enriched items (resolved url in `url`): dated or paywalled, in the window, unwrapped, with a snippet where one is due; a title from item, page or
    slug; no future dates; keywords matched again on title and snippet."""
    now = settings.now
    topical, paid = F.col("feed_domain").isin(*settings.topical), F.col("source_domain").isin(*settings.paywalled)
    in_time = within_window(F.col("published_at"), now, settings.hours)
    rows = items.where((in_time | paid) & ~F.col("url").startswith(settings.wrapper_prefix))
    rows = rows.withColumn("published_at", F.when(in_time, F.col("published_at")).otherwise(now))
    rows = rows.where((F.col("snippet") != "") | topical | paid | F.lit(settings.fast))
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif("page_title", F.lit("")), U.slug_title(F.col("url")))
    rows = rows.withColumn("title", title).withColumn("published_at", clamp_future(F.col("published_at"), now, 5))
    again = matched(F.concat_ws(" \n ", "title", "snippet"), settings.keywords)
    final = F.when(F.size(again) > 0, again).when(topical, F.array(F.lit("#topic"))).when(paid | F.lit(settings.fast), F.col("matched_keywords"))
    rows = rows.withColumn("matched_keywords", final).where(F.coalesce(F.size("matched_keywords"), F.lit(0)) > 0)
    return rows.select("seq", U.canonical(F.col("url")).alias("url"), F.col("source_domain").alias("domain"), "title", "snippet", "published_at", now.alias("found_at"), "matched_keywords", F.lit("").alias("body"))


def clamp_future(at: Column, as_of: Column, minutes: int) -> Column:
    return F.when(at > as_of + F.make_dt_interval(mins=F.lit(minutes)), as_of).otherwise(at)


def to_enrich(items: DataFrame, settings: Settings, targets: DataFrame | None = None) -> DataFrame:
    """The items whose pages are read. Direct ones are admitted by the caps of their domains. Of wrapped ones the first `resolve_budget` of each
    domain are looked up in targets (wrapped, target); those found go on under the target's URL and domain, after all
    direct items of that domain, the others go."""
    wrapped = F.col("url").startswith(settings.wrapper_prefix)
    direct = items.where(~wrapped).withColumn("__late", F.lit(False))
    if targets is None:
        return dedupe.admit(direct, "source_domain").drop("__late")
    looked_up = feeds.resolved(dedupe.first_rows(items.where(wrapped), "source_domain", "seq", settings.resolve_budget), targets).where(~wrapped)
    late = looked_up.withColumn("url", U.canonical(F.col("url"))).withColumn("__late", F.lit(True))
    return dedupe.admit(direct.unionByName(late.select(direct.columns)), "source_domain", late=F.col("__late")).drop("__late")


def run_scan(items: DataFrame, pages: DataFrame, stored: DataFrame, names: DataFrame, settings: Settings, specific: dict[str, list[str]] | None = None, targets: DataFrame | None = None, collected: Sequence[DataFrame] = ()) -> DataFrame:
    """The whole scan: first-seen items, candidates, cache, wrapped links, caps for what must be enriched, enrichment, final rules, and, after
    these articles, those of the side collectors (`collected`, from `collector`); display names. `seq` orders the writes: a side collector's rows come
    after all before it. targets: what wrapped links lead to; without it they are dropped."""
    fresh = dedupe.first_seen(items.withColumn("url", U.canonical(F.col("url"))), "url")
    hits, rest = with_cache(candidates(fresh, settings, specific), stored)
    enriched = enrich(to_enrich(rest, settings, targets), pages, settings)
    articles = dedupe.first_seen(finish(hits.unionByName(enriched.select(hits.columns)), settings), "url")
    for number, side in enumerate(collected, 1):
        articles = articles.unionByName(side.withColumn("seq", F.col("seq") + F.shiftleft(F.lit(number).cast("long"), SIDE_BITS)).select(articles.columns))
    return lookup.named(articles, names)


def write_scan(table: DataFrame, articles: DataFrame) -> DataFrame:
    """The article table after the scan's articles have been written in their order, with is_new."""
    return store.upsert(table, articles.withColumn("seq", F.col("seq") + 1))


def collect(feeds: list[DataFrame], settings: Settings) -> DataFrame:
    """All feeds' items, of each URL the first that is dated."""
    from functools import reduce

    every = reduce(lambda a, b: a.unionByName(b), feeds)
    return dedupe.first_dated(every.withColumn("url", U.canonical(F.col("url"))), "url")


def statistics(items: DataFrame, kept: DataFrame, stored: DataFrame) -> DataFrame:
    """n_raw, n_cand, n_cache in one row."""
    joined = kept.join(stored.where("snippet <> ''").select("url", F.lit(1).alias("hit")), "url", "left")
    zero = F.lit(0).cast("long")
    parts = items.agg(F.count("*").alias("n_raw"), zero.alias("n_cand"), zero.alias("n_cache")).unionByName(joined.agg(zero.alias("n_raw"), F.count("*").alias("n_cand"), F.count("hit").alias("n_cache")))
    return parts.agg(*[F.sum(c).alias(c) for c in parts.columns])


def collector(items: DataFrame, bodies: DataFrame, settings: Settings, most: int, need_body: bool = False) -> DataFrame:
    """A side collector: its own source's items, matched on their titles, the newest `most`, with their bodies; missing dates become now, a missing
    snippet the title's start."""
    hits = items.withColumn("matched_keywords", matched(F.col("title"), settings.keywords)).where(F.size("matched_keywords") > 0)
    chosen = dedupe.top(hits, [F.desc_nulls_last("published_at"), F.col("seq")], most)
    rows = chosen.join(bodies.select("url", F.col("body").alias("__b")), "url", "left").withColumn("body", F.coalesce("__b", F.lit("")))
    if need_body:
        rows = rows.where((F.col("body") != "") | (F.col("title") != ""))
    return rows.select("seq", "url", F.col("source_domain").alias("domain"), "title", F.coalesce(F.nullif("summary", F.lit("")), F.left("title", F.lit(360))).alias("snippet"), F.least(F.coalesce("published_at", settings.now), settings.now).alias("published_at"), settings.now.alias("found_at"), "matched_keywords", "body")
