"""The digest: requested articles in sectors, as an ordered table of blocks, as HTML, text or mail."""

from __future__ import annotations

from email.message import EmailMessage

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.functions import html as H
from newsflow.functions import text as X
from newsflow.functions.matching import best_sector, sector_scores
from newsflow.functions.urls import host
from newsflow.operators.dedupe import running_sum
from newsflow.operators.lookup import requested

#: How a take is shown.
TAKES = {"+": "positive", "=": "neutral", "-": "negative"}


def digest_items(request: DataFrame, articles: DataFrame, sectors: dict[str, list[str]], default: str, translate=None, of_domain: dict[str, str] | None = None) -> DataFrame:
    """The request's articles with sector (the requested one, or the best by score) and section order: sectors by first appearance, items by position. Unknown
    URLs stay, with an error. of_domain: domains that always go to one sector. translate: a column function for titles, identity by default."""
    rows = requested(request, articles)
    chosen = F.coalesce(F.nullif("sector", F.lit("")), best_sector(sector_scores(F.coalesce("title", F.lit("")), F.coalesce("matched_keywords", F.array().cast("array<string>")), sectors), default, host(F.col("url")), of_domain))
    take = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in TAKES.items() for x in p]), F.col("take")), F.lit(TAKES["="]))
    rows = rows.withColumn("sector", F.when(F.col("found"), chosen)).withColumn("take", take).withColumn("error", F.when(~F.col("found"), F.lit("unknown article")))
    if translate is not None:
        rows = rows.withColumn("title", translate(F.col("title")))
    # sectors are few: their first positions go to the rows, which stay where they lie
    first = rows.where("found").groupBy(F.col("sector").alias("__sector")).agg(F.min("pos").alias("section"))
    return rows.join(F.broadcast(first), F.col("found") & F.col("sector").eqNullSafe(F.col("__sector")), "left").drop("__sector")


def digest_blocks(items: DataFrame) -> DataFrame:
    """section, sector, pos, n, type, text, bold, src: the bodies' blocks in reading order. A body is read once, however many items have it, and known by its digest."""
    rows = items.where("found").select("section", "sector", "pos", F.coalesce("body", F.lit("")).alias("body")).withColumn("key", F.sha2("body", 256))
    body = F.col("body")
    html = F.when(F.regexp_like(body, F.lit("<(?:p|h[1-6]|ul|ol|img|blockquote)\\b")), body).otherwise(H.text_to_html(body))
    read = rows.select("key", "body").dropDuplicates(["key"]).select("key", H.blocks(html).alias("blocks")).where(F.size("blocks") > 0)
    joined = rows.drop("body").join(read, "key")
    return joined.select("section", "sector", "pos", F.posexplode("blocks").alias("n", "b")).select("section", "sector", "pos", "n", "b.*")


def section_lines(items: DataFrame) -> DataFrame:
    """section, sector, pos, line: titles and takes as HTML."""
    line = F.concat(F.lit("<li>"), X.escape(F.coalesce("title", F.lit(""))), F.lit(" ("), F.col("take"), F.lit(")</li>"))
    return items.where("found").select("section", "sector", "pos", line.alias("line"))


def sections(items: DataFrame) -> DataFrame:
    """section, sector, html of each section: titles and takes in order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return section_lines(items).groupBy("section", "sector").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "").alias("html"), F.count("*").alias("items"))


def documents_for_mail(items: DataFrame, marker: str, noise: list[str], names: list[str]) -> DataFrame:
    """url, title, paragraphs, status, error of single documents (url, html, body): a pasted body wins over the page; too little text is an error."""
    pasted = X.split_body(F.col("body"))
    paragraphs = X.clean_paragraphs(F.when(F.trim(F.coalesce("body", F.lit(""))) != "", pasted).otherwise(H.paragraph_texts(F.col("html"))), noise)
    rows = items.select("url", X.clean_title(H.page_title(F.coalesce("html", F.lit(""))), names).alias("title"), F.coalesce(paragraphs, F.array().cast("array<string>")).alias("paragraphs"))
    error = F.when(F.col("title") == "", "no title").when(F.size("paragraphs") == 0, "no text").when(X.looks_paywalled(F.col("paragraphs"), marker), "paywalled")
    return rows.withColumn("error", error).withColumn("status", F.when(error.isNull(), "ok").otherwise("error"))


#: Characters of HTML up to which sections are one message, and after which one of several ends.
MAIL_CHARS, MESSAGE_CHARS = 20_000_000, 2_000_000


def _message(parts: list[tuple[str, str]], subject: str, sender: str, to: list[str], header: str) -> bytes:
    """The multipart message of sections (sector, html)."""
    message = EmailMessage()
    message["Subject"], message["From"], message["To"] = subject, sender, ", ".join(to)
    plain = [header] + [f"{sector}\n{html.replace('<li>', '- ').replace('</li>', chr(10))}" for sector, html in parts]
    message.set_content("\n".join(plain))
    message.add_alternative("".join([f"<h1>{header}</h1>", *[f"<h2>{sector}</h2><ul>{html}</ul>" for sector, html in parts]]), subtype="html")
    return message.as_bytes()


def mail(sections_: DataFrame, subject: str, sender: str, to: list[str], header: str = "") -> bytes:
    """A multipart message of the sections, rendered on the driver. Sections of more than MAIL_CHARS characters are no single mail: an error; see `mails`."""
    size = sections_.agg(F.coalesce(F.sum(F.length("html")), F.lit(0))).first()[0]
    if size > MAIL_CHARS:
        raise ValueError(f"sections of {size} characters are too long for a mail")
    rows = sorted(sections_.collect(), key=lambda r: r["section"])
    return _message([(r["sector"], r["html"]) for r in rows], subject, sender, to, header)


def mails(items: DataFrame, subject: str, sender: str, to: list[str], header: str = "", chars: int = MESSAGE_CHARS) -> DataFrame:
    """number (from 0), sectors (array of sector and items), message: a digest of any length as messages, rendered where their lines lie. A message ends with the line
    that reaches `chars` characters of HTML, and the next one goes on from there, with the sector's name again."""
    placed = running_sum(section_lines(items).withColumn("chars", F.length("line")), ["section", "sector", "pos", "line"], "chars", "before")
    lines = F.array_sort(F.collect_list(F.struct("pos", "before", "line")))
    html = F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("html")
    parts = placed.groupBy(F.floor(F.col("before") / chars).alias("number"), "section", "sector").agg(html, F.count("*").alias("items"))
    whole = parts.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("section", "sector", "items", "html"))).alias("parts"))

    @F.pandas_udf(T.BinaryType())
    def rendered(sectors: pd.Series, htmls: pd.Series) -> pd.Series:
        return pd.Series([_message(list(zip(s, h, strict=True)), subject, sender, to, header) for s, h in zip(sectors, htmls, strict=True)], dtype="object")

    shown = F.transform("parts", lambda p: F.struct(p["sector"].alias("sector"), p["items"].alias("items")))
    return whole.select("number", shown.alias("sectors"), rendered(F.col("parts")["sector"], F.col("parts")["html"]).alias("message"))
