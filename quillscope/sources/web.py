"""Structure of raw web pages by pattern, as columns: a static subset of what a
page audit looks at (language, title, headings, links, paragraphs, list items)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def web_features(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) to (page_id, url, lang, title, headings, links)."""
    html = F.coalesce("html", F.lit(""))
    tagless = lambda c: strip(F.regexp_replace(c, "<[^>]*>", ""))
    levels = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<h([1-6])[\s>]"), F.lit(1)), lambda x: x.cast("int"))
    texts = F.regexp_extract_all(html, F.lit(r"(?is)<a[\s>][^>]*>?(.*?)</a>"), F.lit(1))
    return pages.select(
        "page_id",
        "url",
        F.nullif(F.regexp_extract(html, r"""(?i)<html[^>]*\slang=["']?([A-Za-z-]+)""", 1), F.lit("")).alias("lang"),
        F.nullif(tagless(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")).alias("title"),
        levels.alias("headings"),
        F.transform(texts, tagless).alias("links"),
    )
