"""Article text and metadata out of page markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def title(html: Column) -> Column:
    return F.regexp_extract(html, "<title>([^<]*)</title>", 1)


def meta(html: Column, name: str) -> Column:
    """Content of the first meta element of that property or name; empty where there is none."""
    return F.regexp_extract(html, rf"""(?i)<meta[^>]+(?:property|name)=["']{name}["'][^>]*content=["']([^"']*)""", 1)


def paragraphs(html: Column, least: int = 30) -> Column:
    """Texts of the paragraph elements longer than ``least`` characters, their inner markup taken out."""
    found = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), 1), lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", "")))
    return F.filter(found, lambda x: F.length(x) > least)


def linked_data(html: Column, name: str) -> Column:
    """A text property of the page's linked-data block, or the name of an object there; null where there is none."""
    block = F.regexp_extract(html, r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>", 1)
    value = F.get_json_object(block, f"$.{name}")
    return F.nullif(F.coalesce(F.get_json_object(block, f"$.{name}.name"), F.get_json_object(block, f"$.{name}[0].name"), value), F.lit(""))


def structured(pages: DataFrame, key: str = "captura_id", html: str = "html", least_words: int = 40) -> DataFrame:
    """(key, title, author, date, section, body, method): linked data first, then meta elements, then the markup itself.

    The body comes from the article element if its paragraphs hold enough words, else from all paragraphs.
    """
    page = F.col(html)
    first = lambda *xs: F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in xs])
    inner = F.array_join(paragraphs(F.regexp_extract(page, r"(?is)<article[^>]*>(.*?)</article>", 1)), "\n")
    whole = F.array_join(paragraphs(page), "\n")
    enough = F.size(F.split(F.trim(inner), r"\s+")) >= least_words
    return pages.where(page.isNotNull()).select(
        key,
        first(linked_data(page, "headline"), meta(page, "og:title"), title(page)).alias("title"),
        first(linked_data(page, "author"), meta(page, "author")).alias("author"),
        first(linked_data(page, "datePublished"), meta(page, "article:published_time")).alias("date"),
        first(linked_data(page, "articleSection"), meta(page, "article:section")).alias("section"),
        F.when(enough, inner).otherwise(whole).alias("body"),
        F.when(linked_data(page, "headline").isNotNull(), "datos").when(enough, "articulo").otherwise("parrafos").alias("method"),
    )


def articles(pages: DataFrame, key: str = "captura_id", html: str = "html") -> DataFrame:
    """(key, title, body) of each page with markup."""
    return pages.where(F.col(html).isNotNull()).select(key, title(F.col(html)).alias("title"), F.array_join(paragraphs(F.col(html)), "\n").alias("body"))
