"""Accent-insensitive keyword lists as one regular expression."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsflow.functions.text import fold


def folded(word: str) -> str:
    """A keyword or term as it is looked for: lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).lower()


def matched(text: Column, keywords: list[str]) -> Column:
    """The keywords found, in their first spelling, by first occurrence. Longer ones win over those they contain, and a part of the text
    counts once."""
    spelling: dict[str, str] = {}
    for word in keywords:
        spelling.setdefault(folded(word), word)
    spelling.pop("", None)
    if not spelling:
        return F.array().cast("array<string>")
    either = "|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in sorted(spelling, key=len, reverse=True))
    found = F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(rf"(?U)\b(?:{either})\b"), F.lit(0))
    names = F.create_map(*[F.lit(x) for pair in spelling.items() for x in pair])
    return F.array_distinct(F.transform(found, lambda m: F.coalesce(names[m], m)))


def contains_all(terms: list[str], *texts: Column) -> Column:
    """Whether every term occurs in the texts, accents and case aside."""
    hay = fold(F.concat_ws(" ", *texts))
    out = F.lit(True)
    for term in terms:
        out = out & F.contains(hay, F.lit(folded(term)))
    return out


def sector_scores(title: Column, matched_keywords: Column, sectors: dict[str, list[str]]) -> dict[str, Column]:
    """For each sector the matched keywords among its terms plus its terms inside the title."""
    hay = F.lower(title)
    out = {}
    for name, terms in sectors.items():
        own = F.array(*[F.lit(t.lower()) for t in terms])
        shared = F.size(F.array_intersect(F.transform(matched_keywords, F.lower), own))
        out[name] = shared + F.size(F.filter(own, lambda t: F.contains(hay, t)))
    return out


def best_sector(scores: dict[str, Column], default: str, domain: Column | None = None, of_domain: dict[str, str] | None = None) -> Column:
    """The sector of the domain, if of_domain has one; else that with the highest score; earlier ones win ties; the default where all are zero."""
    top = F.greatest(*scores.values())
    out = F.when(F.lit(False), F.lit(default))
    for site, name in (of_domain or {}).items():
        out = out.when(F.regexp_replace(domain, r"^www\.", "") == site, F.lit(name))
    out = out.when(top == 0, F.lit(default))
    for name, score in scores.items():
        out = out.when(score == top, F.lit(name))
    return out
