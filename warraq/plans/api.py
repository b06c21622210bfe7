"""The read endpoints of a news service as functions from tables to tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warraq import lexicons, schemas
from warraq.functions import text as t


def article(articles: DataFrame, article_id: int | DataFrame, cols: Sequence[str] = schemas.DETAILS) -> DataFrame:
    """No row: not found. The id may be a table of one row."""
    one = articles.filter(F.col("id") == article_id) if isinstance(article_id, int) else articles.join(F.broadcast(article_id), "id", "left_semi")
    return one.select(*cols)


def listing(articles: DataFrame, source: str | None = None, skip: int = 0, limit: int = 20) -> DataFrame:
    d = articles.filter(F.col("source_name") == source) if source else articles
    return d.select(*schemas.CARD).orderBy(F.desc("id")).offset(skip).limit(limit)


def feed(articles: DataFrame, page: int = 1, size: int = 20, source: str | None = None) -> DataFrame:
    """A page by date, newest first and undated before all, with the total and whether more follow."""
    if not 1 <= size <= 50 or page < 1:
        raise ValueError("page from 1, size from 1 to 50")
    d = articles.filter(F.col("source_name") == source) if source else articles
    rows = d.select(*schemas.FEED).orderBy(F.desc_nulls_first("published_at"), F.desc("id")).offset((page - 1) * size).limit(size)
    total = d.agg(F.count("*").alias("total"))
    return rows.join(F.broadcast(total)).withColumn("has_next", F.lit(page * size) < F.col("total"))


def feed_details(articles: DataFrame, neutrality: str | None = None, statement: str | None = None) -> DataFrame:
    if neutrality not in (None, "neutral", "propaganda") or statement not in (None, "reporting", "opinion"):
        raise ValueError("unknown label")
    d = articles.filter(F.col("propaganda_label") == neutrality) if neutrality else articles
    d = d.filter(F.col("statement_type") == statement) if statement else d
    return d.select(*schemas.FEED)


def keyword_filter(d: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """The first five tokens, each in title or content."""
    has = [F.coalesce(F.contains("title", F.lit(x)), F.lit(False)) | F.coalesce(F.contains("content", F.lit(x)), F.lit(False)) for x in tokens[:5]]
    return d.filter(reduce(lambda a, b: a & b, has)) if has else d


def search_local(articles: DataFrame, tokens: Sequence[str], cutoff: Column, limit: int = 10) -> DataFrame:
    """Recent rows with all tokens, newest first."""
    d = keyword_filter(articles.filter(F.col("published_at") >= cutoff), tokens)
    return d.select(*schemas.CARD, "cluster_id").orderBy(F.desc("published_at"), F.desc("id")).limit(min(limit, 10))


def search(articles: DataFrame, query: str, cutoff: Column, limit: int = 10, stop: Sequence[str] = tuple(lexicons.STOPWORDS)) -> DataFrame:
    """`search_local` from what a reader types; at most 50 rows may be asked for, and 10 come."""
    if not 1 <= limit <= 50:
        raise ValueError("limit from 1 to 50")
    has = lambda x: F.coalesce(F.contains("title", x), F.lit(False)) | F.coalesce(F.contains("content", x), F.lit(False))
    d = articles.filter(F.col("published_at") >= cutoff).filter(F.forall(F.slice(t.query_tokens(query, stop), 1, 5), has))
    return d.select(*schemas.CARD, "cluster_id").orderBy(F.desc("published_at"), F.desc("id")).limit(min(limit, 10))


def related(articles: DataFrame, article_id: int | DataFrame, page: int = 1, size: int = 20) -> DataFrame:
    """Other articles of the article's cluster: verified first, then reliable, then new. Total counts all of them. The id may be a table of one row."""
    mine = articles.filter(F.col("id") == article_id) if isinstance(article_id, int) else articles.join(F.broadcast(article_id), "id", "left_semi")
    mine = mine.select(F.col("cluster_id"), F.col("id").alias("_mine"))
    d = articles.join(F.broadcast(mine), "cluster_id").filter("id <> _mine")  # one row
    order = [F.desc_nulls_first(c) for c in ("verified", "reliability_score", "published_at")]
    rows = d.select(*schemas.CARD, "cluster_id").orderBy(*order, F.desc("id")).offset((page - 1) * size).limit(size)
    return rows.join(F.broadcast(d.groupBy("cluster_id").agg(F.count("*").alias("total"))), "cluster_id")


def stats(articles: DataFrame) -> DataFrame:
    return articles.agg(F.count("*").alias("total"), F.count(F.when(F.col("is_processed"), 1)).alias("processed")).withColumn("unprocessed", F.col("total") - F.col("processed"))


def by_source(articles: DataFrame) -> DataFrame:
    """Articles per source, most first, then by name."""
    return articles.groupBy("source_name").agg(F.count("*").alias("articles")).orderBy(F.desc("articles"), "source_name")


def cluster_sources(articles: DataFrame) -> DataFrame:
    """Per cluster its sources, most articles first, then by name, and how many sources it has."""
    g = articles.filter("cluster_id is not null").groupBy("cluster_id", "source_name").agg(F.count("*").alias("articles"))
    total = g.groupBy("cluster_id").agg(F.count("*").alias("total"))
    return g.join(total, "cluster_id").orderBy("cluster_id", F.desc("articles"), "source_name")


def cluster_members(clusters: DataFrame, articles: DataFrame) -> DataFrame:
    """Each cluster with its articles, in id order; without articles an empty list."""
    members = articles.filter("cluster_id is not null").groupBy(F.col("cluster_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("id", "title", "source_name"))).alias("articles"))
    empty = F.array().cast("array<struct<id:bigint,title:string,source_name:string>>")
    return clusters.join(members, "id", "left").withColumn("articles", F.coalesce("articles", empty))


def pending_feedback(feedback: DataFrame, articles: DataFrame) -> DataFrame:
    a = articles.select(F.col("id").alias("article_id"), "title", "source_name")
    """Pending feedback with its article, newest first."""
    return feedback.filter("lower(status) = 'pending'").join(a, "article_id").orderBy(F.desc("id")).select("id", "article_id", "title", "source_name", "propaganda_prediction", "propaganda_correct", "corrected_propaganda")


def feedback_details(feedback: DataFrame, articles: DataFrame) -> DataFrame:
    a = articles.select(F.col("id").alias("article_id"), F.struct("id", "title", "url", "source_name").alias("article"))
    return feedback.join(a, "article_id").select("id", "article", F.struct("status", "notes", *[f"{x}_{y}" for x in ("propaganda", "statement", "attribution") for y in ("prediction", "correct")]).alias("feedback"))


def sources(registry: DataFrame) -> DataFrame:
    return registry.select("name", "name_ar", "reliability_score", "political_lean", "region", F.size("rss_urls").alias("rss_count"))


def warm_up(articles: DataFrame, as_of: Column | None = None, hours: int = 48, rows: int = 100) -> DataFrame:
    """What the deduplicator knows at its start: the newest rows of the last hours before `as_of`, or else before the newest row."""
    last = articles.agg(F.max("scraped_at").alias("_last"))
    d = articles.join(F.broadcast(last)) if as_of is None else articles.withColumn("_last", as_of)  # one row
    d = d.filter(F.col("scraped_at") >= F.col("_last") - F.expr(f"INTERVAL {hours} HOURS"))
    return d.orderBy(F.desc("id")).limit(rows).select("id", t.truthy(F.col("content"), F.col("title")).alias("text"))
