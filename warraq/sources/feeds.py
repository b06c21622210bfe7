"""Feeds and pages: entries from stored XML, dates, redirects, block lists, bodies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.functions import text as t
from warraq.functions.html import main_text_column

ITEM = "struct<link:string,guid:string,title:string,description:string,summary:string,pubDate:string,published:string,updated:string,created:string,source:string>"


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """(feed, xml) of stored feed files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("feed"), F.decode("content", F.lit("UTF-8")).alias("xml"))


def entries(feeds: DataFrame) -> DataFrame:
    """(feed, pos, link, guid, title, summary, description, published, updated, created, source_title); a feed that cannot be read has none."""
    items = F.regexp_extract_all("xml", F.lit(r"(?s)<(?:item|entry)\b.*?</(?:item|entry)>"), F.lit(0))
    e = feeds.select("feed", F.posexplode(items).alias("pos", "item"))

    def of(tag: str) -> Column:
        x = F.regexp_extract("item", rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
        quoted = r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$"
        # escaped markup becomes markup here, as an XML reader hands it over; what a CDATA section holds stays
        return F.nullif(t.strip(F.when(x.rlike(quoted), F.regexp_replace(x, quoted, "$1")).otherwise(t.unescaped(x))), F.lit(""))

    href = F.nullif(F.regexp_extract("item", r'<link\b[^>]*href="([^"]*)"', 1), F.lit(""))
    return e.select("feed", "pos", F.coalesce(of("link"), href).alias("link"), F.coalesce(of("guid"), of("id")).alias("guid"), of("title").alias("title"), of("summary").alias("summary"), of("description").alias("description"), F.coalesce(of("pubDate"), of("published")).alias("published"), of("updated").alias("updated"), of("created").alias("created"), of("source").alias("source_title"))


def articles_of(e: DataFrame, most: int = 50, as_of: Column | None = None, arabic_only: bool = True) -> DataFrame:
    """The first `most` entries of each feed as raw articles: url = link else id; content = summary else description, without markup."""
    body = F.coalesce(F.nullif("summary", F.lit("")), "description", F.lit(""))
    body = t.strip(F.regexp_replace(F.when(body.contains("<"), t.remove_html(body)).otherwise(body), f"{t.SPACE}+", " "))
    when = t.parse_time(F.coalesce("published", "updated", "created"), as_of)
    d = e.filter(F.col("pos") < most).select(F.coalesce(F.nullif("link", F.lit("")), "guid").alias("url"), t.strip(F.coalesce("title", F.lit(""))).alias("title"), body.alias("content"), "feed", "source_title", when.alias("published_at"))
    d = d.filter("url is not null and url <> ''")
    return d.filter(t.is_script(F.concat_ws(" ", "title", "content"), blocks=t.ARABIC_BLOCK)) if arabic_only else d


def search_url(query: str, window: str = "7d") -> str:
    from urllib.parse import quote

    return f"/rss/search?q={quote(query)}when:{window}&hl=ar&gl=SA"


def resolved(d: DataFrame, redirects: DataFrame, url: str = "url") -> DataFrame:
    """`url` replaced where a redirect (url, target) is known."""
    return d.join(redirects.select(F.col("url").alias(url), F.col("target").alias("_to")), url, "left").withColumn(url, F.coalesce("_to", url)).drop("_to")


def not_blocked(d: DataFrame, hosts: Sequence[str], url: str = "url") -> DataFrame:
    return d.filter(~F.exists(t.lit_array(list(hosts)), lambda h: F.contains(F.coalesce(F.col(url), F.lit("")), h)))


def with_bodies(d: DataFrame, pages: DataFrame, short: int = 300) -> DataFrame:
    """Contents under `short` characters replaced by the page's main text (pages: url, html) where that is longer than `short`."""
    body = pages.select("url", main_text_column(F.col("html")).alias("_body"))
    swap = (F.length(F.coalesce("content", F.lit(""))) < short) & (F.length("_body") > short)
    return d.join(body, "url", "left").withColumn("content", F.when(swap, F.col("_body")).otherwise(F.col("content"))).drop("_body")


def search_entries(d: DataFrame) -> DataFrame:
    """Entries with a text that is not just their title; titles lose their last ' - suffix'."""
    e = d.withColumn("title", t.without_suffix(F.col("title")))
    return e.filter(F.col("content").isNotNull() & (t.strip(F.col("content")) != t.strip(F.col("title"))))


def content_or_title(title: Column, content: Column, keywords: Sequence[str]) -> Column:
    return F.when(t.is_boilerplate(content, keywords) | (F.length(t.strip(content)) < 40), title).otherwise(content)
