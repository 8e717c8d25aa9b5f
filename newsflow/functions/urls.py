"""URL expressions, all built-in: no parser that throws, so any string has a result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "__twitter_impression")
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; empty where absent."""
    return F.regexp_extract(url, _PARTS, n)


def host(url: Column) -> Column:
    return F.lower(part(url, 2))


def site(url: Column) -> Column:
    """The host without one leading www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def _decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))


def _encode(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical(url: Column, keep_fragment_hosts: tuple[str, ...] = (), id_only: dict[str, str] | None = None) -> Column:
    """The key of an article: lower-case host without www., no tracking parameters, no trailing slash, no fragment.

    keep_fragment_hosts: hosts whose fragment is the route. id_only: host to a pattern whose group 1 is all of the path that counts."""
    domain = site(url)
    path = F.regexp_replace(part(url, 3), r"/+$", "")
    path = F.when(path == "", part(url, 3)).otherwise(path)
    for name, pattern in (id_only or {}).items():
        path = F.when((domain == name) & path.rlike(pattern), F.regexp_extract(path, pattern, 1)).otherwise(path)
    pairs = F.transform(F.filter(F.split(part(url, 4), "&"), lambda p: p != ""), lambda p: F.struct(_decode(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), _decode(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("v")))
    kept = F.filter(pairs, lambda x: ~F.lower(x["k"]).isin(*TRACKING))
    query = F.array_join(F.transform(kept, lambda x: F.concat(_encode(x["k"]), F.lit("="), _encode(x["v"]))), "&")
    fragment = F.when(domain.isin(*keep_fragment_hosts), part(url, 5)).otherwise("") if keep_fragment_hosts else F.lit("")
    prefixed = lambda sign, text: F.when(text == "", "").otherwise(F.concat(F.lit(sign), text))
    return F.concat(F.when(part(url, 1) == "", "").otherwise(F.concat(F.lower(part(url, 1)), F.lit(":"))), prefixed("//", domain), path, prefixed("?", query), prefixed("#", fragment))


def unwrap_redirect(url: Column, wrapper_hosts: tuple[str, ...]) -> Column:
    """What a redirecting URL of these hosts points to: after "*", or the parameter url."""
    after = F.regexp_extract(url, r"^[^*]*\*(https?://.*)$", 1)
    parameter = _decode(F.regexp_extract(part(url, 4), r"(?:^|&)url=([^&]+)", 1))
    return F.when(host(url).isin(*wrapper_hosts), F.when(after != "", after).when(parameter != "", parameter).otherwise(url)).otherwise(url)


def last_segment(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(part(url, 3), r"/+$", ""), r"([^/]*)$", 1)


def slug_title(url: Column) -> Column:
    """A title from the last path segment: escapes resolved, hyphens to spaces, first letter upper-case."""
    raw = F.trim(F.replace(F.coalesce(F.try_url_decode(F.replace(last_segment(url), F.lit("+"), F.lit("%2B"))), last_segment(url)), F.lit("-"), F.lit(" ")))
    return F.when(raw == "", url).otherwise(F.concat(F.upper(F.left(raw, F.lit(1))), F.substring(raw, 2, 1 << 30)))


def path_words(url: Column) -> Column:
    return F.translate(part(url, 3), "-/", "  ")


def slug_words(url: Column, ending: str = "") -> Column:
    """The words of the last path segment, without an ending (a pattern) that carries no words."""
    slug = F.regexp_replace(last_segment(url), f"(?:{ending})$", "") if ending else last_segment(url)
    return F.trim(F.replace(slug, F.lit("-"), F.lit(" ")))


def numbered_base(url: Column) -> Column:
    """The URL without a -N ending (one or two digits), where what is left is a slug of three or more hyphens; else null."""
    base = F.regexp_extract(url, r"^(.*)-\d{1,2}$", 1)
    hyphens = F.length(F.regexp_replace(F.regexp_extract(base, r"([^/]*)$", 1), "[^-]", ""))
    return F.when((base != "") & (hyphens >= 3), base)


def absolute(href: Column, page_url: Column) -> Column:
    """An absolute http URL, or null."""
    root = F.concat(part(page_url, 1), F.lit("://"), part(page_url, 2))
    return F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(root, href)).when(href.startswith("http"), href)


def search_url(base: str, terms: Column, sites: Column, hours: Column) -> Column:
    """A search-feed URL: terms joined by OR, sites, and a time span in hours up to 48, else in days."""
    quoted = F.array_join(F.transform(terms, lambda t: F.when(F.contains(t, F.lit(" ")), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t)), " OR ")
    span = F.when(hours <= 48, F.concat(hours.cast("string"), F.lit("h"))).otherwise(F.concat(F.ceil(hours / 24).cast("string"), F.lit("d")))
    place = F.array_join(F.transform(sites, lambda s: F.concat(F.lit("site:"), s)), " OR ")
    return F.concat(F.lit(base), F.lit("?q="), F.url_encode(F.concat_ws(" ", F.concat(F.lit("("), quoted, F.lit(")")), F.when(F.size(sites) > 0, F.concat(F.lit("("), place, F.lit(")"))), F.concat(F.lit("when:"), span))))
