"""Scalar text expressions. All are built-in functions, but for those that say they are Arrow UDFs."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _latin_fold() -> tuple[str, str]:
    """Letters that decompose to one base character, and what they fold to; combining marks fold to nothing."""
    source, target = [], []
    for point in range(0xC0, 0x2000):
        base = [c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != chr(point):
            source.append(chr(point))
            target.append(base[0])
    return "".join(source) + "".join(map(chr, range(0x300, 0x370))), "".join(target)


_FROM, _TO = _latin_fold()


def fold(text: Column) -> Column:
    """Lower case without accents, for letters below U+2000."""
    return F.lower(F.translate(text, _FROM, _TO))


@F.pandas_udf(T.StringType())
def fold_exact(text: pd.Series) -> pd.Series:
    """Lower case without accents for every script: compatibility decomposition, marks dropped. An Arrow UDF."""
    return text.map(lambda s: s if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower())


@F.pandas_udf(T.StringType())
def decompose(text: pd.Series) -> pd.Series:
    """Lower-case compatibility decomposition that keeps the marks. An Arrow UDF."""
    return text.map(lambda s: s if s is None else unicodedata.normalize("NFKD", s).lower())


@F.pandas_udf(T.StringType())
def unescape_exact(text: pd.Series) -> pd.Series:
    """All character references of HTML resolved. An Arrow UDF."""
    import html

    return text.map(lambda s: s if s is None else html.unescape(s))


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{1,31};?)"
#: Names that count without a semicolon too, longest first.
_BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))


def _names() -> Column:
    """What the names stand for, in a map for each first letter, as a look-up goes through a map from its beginning."""
    by_letter: dict[str, list[str]] = {}
    for name in sorted(html5):
        by_letter.setdefault(name[0], []).append(f"{name}\x02{html5[name]}")
    maps = [(F.lit(letter), F.str_to_map(F.lit("\x01".join(pairs)), F.lit("\x01"), F.lit("\x02"))) for letter, pairs in by_letter.items()]
    return F.create_map(*[c for pair in maps for c in pair])


def _reference(ref: Column, names: Column) -> Column:
    """What one character reference stands for; itself, if it is none."""
    digits = lambda pattern: F.ltrim(F.regexp_extract(ref, pattern, 1), F.lit("0"))
    decimal, sixteen = digits("^&#([0-9]+)"), digits("^&#[xX]([0-9a-fA-F]+)")
    beyond = F.lit(0x110000)
    code = F.when(F.regexp_like(ref, F.lit("^&#[xX]")), F.when(F.length(sixteen) > 6, beyond).otherwise(F.conv(F.concat(F.lit("0"), sixteen), 16, 10).cast("int")))
    code = code.otherwise(F.when(F.length(decimal) > 7, beyond).otherwise(F.concat(F.lit("0"), decimal).cast("int")))
    # numbers 128 to 159 mean the characters of an old code page
    old = "".join(bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(128, 160))
    none = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    # the byte order mark before it keeps a character U+FEFF from being taken for one
    char = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(code), 8, "0"))), "UTF-32")
    numbered = F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "\ufffd").when(code.between(128, 159), F.substring(F.lit(old), code - 127, F.lit(1))).when(none, "").otherwise(char)
    known = lambda name: F.try_element_at(F.try_element_at(names, F.left(name, F.lit(1))), name)
    begin = F.regexp_extract(ref, "^&(" + "|".join(_BARE) + ")", 1)
    shorter = F.when(begin != "", F.concat(known(begin), F.substring(ref, F.length(begin) + 2, F.length(ref))))
    named = F.coalesce(known(F.substring(ref, F.lit(2), F.length(ref))), shorter, ref)
    return F.when(F.regexp_like(ref, F.lit("^&#")), numbered).otherwise(named)


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value once in the plan and computed once, however often `of` uses it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _unescaped(text: Column) -> Column:
    pieces = F.split(text, _REFERENCE, -1)
    found = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    resolved = bound(_names(), lambda names: F.transform(found, lambda ref: _reference(ref, names)))
    whole = F.array_join(F.zip_with(pieces, resolved, lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def unescape(text: Column) -> Column:
    """All character references of HTML resolved, each once: by name, with or without semicolon as HTML has it, and by number."""
    return bound(text, _unescaped)


def unescape_all(texts: Column) -> Column:
    """The references of an array of texts resolved: one table of names in the plan for all of them."""
    return F.transform(texts, _unescaped)


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once a row, however often and wherever later steps use them: a generator of one row, into
    which the optimizer neither copies nor pushes what comes after it."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def escape(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def tagless(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]+>", " ")


def html_to_text(html: Column) -> Column:
    """Tags to spaces, references resolved, white space squashed, replacement characters dropped."""
    return tidied(unescape(tagless(html)))


def tidied(text: Column) -> Column:
    """White space squashed, replacement characters dropped."""
    bare = F.replace(text, F.lit("�"), F.lit(""))
    return F.trim(F.regexp_replace(F.replace(bare, F.lit(" "), F.lit(" ")), r"\s+", " "))


#: Words after which a text only points to other articles.
RELATED = ("leia\\s+tamb[eé]m", "veja\\s+tamb[eé]m", "saiba\\s+mais", "leia\\s+mais", "veja\\s+mais", "confira\\s+tamb[eé]m", "mais\\s+not[ií]cias", "not[ií]cias\\s+relacionadas", "mat[eé]rias\\s+relacionadas")


def cut_related(text: Column, markers: tuple[str, ...] = RELATED) -> Column:
    """The text up to the first marker."""
    return F.regexp_replace(text, r"(?is)\b(?:" + "|".join(markers) + r")\b.*", "")


#: Fixed value: the footer that a blog platform puts under cross-posted items.
_FOOTER = r"O\s+post\s+{any}apareceu\s+primeiro\s+em\s+"


def strip_footer(text: Column) -> Column:
    """The cross-post footer goes: in its HTML form, or else, tags stripped, in its plain form."""
    as_html = F.regexp_replace(text, "(?i)" + _FOOTER.format(any=r"[\s\S]+?") + r"[\s\S]+?</a>\s*\.", " ")
    plain = F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), "(?is)" + _FOOTER.format(any=r".+?\s+") + r"[^.<]+\.", " ")
    return F.trim(F.when(as_html != text, as_html).otherwise(plain))


def truncate(text: Column, size: int = 360) -> Column:
    """At most `size` characters, cut at the last space if that keeps over three fifths, without trailing punctuation, then "..."."""
    head = F.left(text, F.lit(size))
    last = F.lit(size) - F.locate(" ", F.reverse(head))  # place of the last space from 0; size if there is none
    cut = F.when((F.locate(" ", F.reverse(head)) > 0) & (last > size * 0.6), F.left(head, last)).otherwise(head)
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.regexp_replace(cut, r"[ ,;:.\-]+$", ""), F.lit("...")))


def snippet(summary: Column, boilerplate: str, least: int = 150) -> Column:
    """A summary as snippet: text only, without footer; empty if short or boilerplate."""
    text = strip_footer(html_to_text(summary))
    return bound(text, lambda t: F.when((F.length(t) < least) | F.regexp_like(t, F.lit("(?i)" + boilerplate)), "").otherwise(truncate(t)))


def clean_title(title: Column, names: list[str]) -> Column:
    """Trailing " | Name" parts go, all of them, but never the whole title."""
    import re

    either = "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True))
    return F.trim(F.regexp_replace(squash(title), rf"(?is)^(.*?\S)(?:\s*[|–-]\s*(?:{either})\s*)+$", "$1"))


def distinct_from_previous(items: Column) -> Column:
    """Array without elements that repeat the one before. The array is bound, as a lambda would compute it anew for each element."""
    return bound(items, lambda own: F.filter(own, lambda x, i: (i == 0) | (x != F.get(own, i - 1))))


def clean_paragraphs(paragraphs: Column, noise: list[str]) -> Column:
    """White space squashed, no space before punctuation, paragraphs that match a noise pattern and repeats dropped."""
    tidy = F.transform(paragraphs, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"\s+", " "), r"\s+([,.;:!?])", "$1")))
    kept = F.filter(tidy, lambda p: (p != "") & (~p.rlike("(?i)" + "|".join(f"(?:{n})" for n in noise)) if noise else F.lit(True)))
    return distinct_from_previous(kept)


def looks_paywalled(paragraphs: Column, marker: str, least_paragraphs: int = 3, least_chars: int = 400) -> Column:
    joined = F.array_join(paragraphs, " ")
    return (F.size(paragraphs) < least_paragraphs) | (F.length(joined) < least_chars) | F.regexp_like(joined, F.lit("(?i)" + marker))


def split_body(body: Column) -> Column:
    """Paragraphs of a pasted body: at blank lines, or at line ends where there is none."""
    parts = lambda at: F.filter(F.transform(F.split(F.trim(body), at), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts(r"\n\s*\n")) > 1, parts(r"\n\s*\n")).otherwise(parts(r"\n"))


def split_glued_sentences(text: Column) -> Column:
    """A line break between sentences glued together; texts that have line breaks stay."""
    # fixed value: the end of a sentence and the beginning of the next
    glued = F.regexp_replace(text, r"(?<=[a-z0-9\"'»)\]%])\.\s*(?=[A-Z][a-z][a-z])", ".\n")
    return F.when(F.contains(text, F.lit("\n")), text).otherwise(glued)


def age_label(at: Column, as_of: Column) -> Column:
    """The age as it is shown: under a minute or in the future, minutes, hours, days; a label of its own without a date."""
    s = F.unix_timestamp(as_of) - F.unix_timestamp(at)
    part = lambda n, unit: F.concat(F.lit("há "), F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(at.isNull(), "sem data").when(s < 60, "agora").when(s < 3600, part(60, " min")).when(s < 86400, part(3600, " h")).otherwise(part(86400, " d"))


def window_label(hours: Column) -> Column:
    """24h (1d); a week is 7d; under a day hours alone."""
    h = F.concat(hours.cast("string"), F.lit("h"))
    return F.when(hours < 24, h).when(hours == 168, "7d").otherwise(F.concat(h, F.lit(" ("), F.floor(hours / 24).cast("string"), F.lit("d)")))


def parse_time(text: Column) -> Column:
    """ISO, mail and plain dates as UTC time; null for what is none and for year 1."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")  # the weekday of mail dates says nothing
    bare = F.regexp_replace(bare, r"(?<=:[0-9]{2})\s+(?:GMT|UTC?|Z)$", " +0000")
    forms = ["yyyy-MM-dd'T'HH:mm:ssXXX", "d MMM yyyy HH:mm:ss Z", "yyyy/MM/dd HH:mm", "dd/MM/yyyy HH:mm", "dd/MM/yyyy"]
    got = F.coalesce(F.try_to_timestamp(bare), *[F.try_to_timestamp(bare, F.lit(f)) for f in forms])
    return F.when(F.year(got) > 1, got)


#: Month names of date headers.
MONTHS = {"pt": ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"), "en": ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")}


def date_header(day: Column, language: str = "en") -> Column:
    month = F.element_at(F.array(*map(F.lit, MONTHS[language])), F.month(day))
    if language == "pt":
        return F.concat(F.dayofmonth(day).cast("string"), F.lit(" de "), month, F.lit(" de "), F.year(day).cast("string"))
    return F.concat(month, F.lit(" "), F.dayofmonth(day).cast("string"), F.lit(", "), F.year(day).cast("string"))
