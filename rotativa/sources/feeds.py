"""Search feeds, address lists and stored criteria as DataFrames."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rotativa.functions import text as T


@dataclass
class Criteria:
    """What a search looks for: typed terms, the range of days, outlets."""

    terms: list[str] = field(default_factory=list)
    first: str = ""
    last: str = ""
    outlets: list[str] = field(default_factory=list)
    most: int = 50

    def __post_init__(self) -> None:
        if self.first and self.last and self.first > self.last:
            raise ValueError("the range of days ends before it begins")
        # the first spelling of each term stays
        self.terms = list({t.strip().lower(): t.strip() for t in reversed(self.terms) if t.strip()}.values())[::-1]

    def as_dict(self) -> dict:
        return asdict(self)

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.as_dict(), ensure_ascii=False), encoding="utf-8")

    @classmethod
    def load(cls, path: str) -> Criteria:
        return cls(**json.loads(Path(path).read_text(encoding="utf-8")))


def rss_items(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """(link, headline, outlet, date) of each item: the outlet is the source element, else what follows the title's last dash."""
    item = "struct<link:string,title:string,pubDate:string,source:string>"
    parsed = F.from_xml(F.col(xml), f"struct<channel:struct<item:array<{item}>>>")
    rows = feeds.select(F.explode(parsed["channel"]["item"]).alias("i")).select("i.*")
    outlet = F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.nullif(F.regexp_extract("title", r"^.* - ([^-]+)$", 1), F.lit("")))
    headline = F.when(F.col("title").rlike(r"^.* - [^-]+$"), F.regexp_extract("title", r"^(.*) - [^-]+$", 1)).otherwise(F.col("title"))
    return rows.select("link", headline.alias("headline"), outlet.alias("outlet"), feed_date(F.col("pubDate")).alias("date"))


def feed_date(value: Column) -> Column:
    """Day of an RFC 822 date, with a zone name or an offset; null where it is neither."""
    bare = F.regexp_replace(value, r"^[A-Za-z]+, *", "")
    return F.to_date(F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z"))))


def loose_day(value: Column) -> Column:
    """Day of ``2026-01-31``, ``31/01/2026`` or ``31-01-2026``; null where it is none of them."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(value, F.lit(p))) for p in ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy")])


def addresses(spark: SparkSession, path: str) -> DataFrame:
    """(url) one for each line of a text file, without blank lines and those that begin with #."""
    lines = spark.read.text(path).select(F.trim("value").alias("url"))
    return lines.where((F.col("url") != "") & ~F.col("url").startswith("#"))


def text_blocks(pages: DataFrame, key: str, text: str, least: int = 40) -> DataFrame:
    """(key, ord, block): parts between blank lines of at least ``least`` characters, the first of each spelling."""
    parts = pages.select(key, F.posexplode(F.split(F.col(text), r"\n{2,}")).alias("ord", "block")).select(key, "ord", F.trim("block").alias("block")).where(F.length("block") >= least)
    return parts.groupBy(key, F.lower("block").alias("_l")).agg(F.min(F.struct("ord", "block")).alias("b")).select(key, "b.ord", "b.block")


def hits_from_posts(posts: DataFrame) -> DataFrame:
    """(url, headline, body): posts as notes."""
    return posts.select(F.coalesce(F.nullif("url", F.lit("")), F.concat("plataforma", F.lit(":"), "id")).alias("url"), F.substring("texto", 1, 120).alias("headline"), F.col("texto").alias("body"))


def redirect_target(url: Column) -> Column:
    """The address wrapped in a search engine's link: its url parameter, else one inside its url-safe base64 part."""
    token = F.regexp_extract(url, r"/articles/([A-Za-z0-9_-]+)", 1)
    padded = F.rpad(F.translate(token, "-_", "+/"), F.length(token) + (F.lit(4) - F.length(token) % 4) % 4, F.lit("="))
    inner = F.regexp_extract(F.decode(F.try_to_binary(padded, F.lit("base64")), "ISO-8859-1"), r"(https?://[\x21-\x7e]+\.[\x21-\x7e]+)", 1)
    return F.coalesce(T.query_value(url, "url"), F.when(token != "", F.nullif(inner, F.lit(""))), url)
