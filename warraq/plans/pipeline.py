"""From raw articles to scored, grouped stories: one lazy plan, cut where an iteration needs it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warraq import lexicons
from warraq.functions import text as t
from warraq.operators import clustering, dedup, scoring
from warraq.runtime import cut
from warraq.sources import feeds


def prepared(raw: DataFrame) -> DataFrame:
    """Language and boilerplate gates, cleaning, normal spelling, tokens."""
    d = raw.withColumn("content", feeds.content_or_title(F.col("title"), F.coalesce("content", F.lit("")), lexicons.BOILERPLATE))
    d = d.filter(t.is_script(F.concat_ws(" ", "title", "content")))
    d = d.withColumns({"title_clean": t.normalize(t.clean(F.col("title"))), "content_clean": t.normalize(t.clean(F.col("content")))})
    d = d.withColumn("tokens", t.tokenize(F.concat_ws(" ", "title_clean", "content_clean")))
    return d.withColumn("word_count", t.word_count(F.col("content")))


def scored(d: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of `prepared` with ratio, scores and labels."""
    kept = t.without_stopwords(F.col("tokens"), lexicons.STOPWORDS)
    d = d.withColumns({"ratio": t.loaded_ratio(F.col("tokens"), lexicons.LOADED), "neutrality_score": scoring.neutrality(t.loaded_ratio(kept, lexicons.LOADED))})
    d = scoring.authority(d, sources).withColumn("attribution_score", scoring.attribution(F.col("title"), F.col("content"), lexicons.ATTRIBUTION_MARKERS))
    d = d.withColumn("statement_type", scoring.statement_type(F.col("title"), F.col("content"), F.col("neutrality_score"), lexicons.OPINION_MARKERS))
    d = d.withColumns({"attribution_label": scoring.attribution_label(F.col("attribution_score")), "reliability_score": scoring.reliability(F.col("authority"), F.col("neutrality_score"), F.col("attribution_score")), "propaganda_label": scoring.bias_override(scoring.rule_classifier(F.col("ratio")), F.col("neutrality_score"))})
    return d.withColumn("verified", scoring.is_verified(*[F.col(c) for c in ("reliability_score", "neutrality_score", "statement_type", "attribution_label", "propaganda_label")]))


def hashed_vector(tokens: Column, size: int = 64) -> Column:
    """The default stand-in for an embedding model: token counts in `size` hashed places. Deterministic, and no model."""
    at = F.transform(tokens, lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(at, lambda a: a == i)).cast("double"))


def traits(d: DataFrame, *keep: str) -> DataFrame:
    """What stories are told apart by: vector, places' domains, title words and stems, entities; of rows with title, title_clean, content_clean and entity lists."""
    text = F.concat_ws(" ", "title_clean", F.substring(F.coalesce("content_clean", F.lit("")), 1, 250))
    words = t.title_words(F.col("title"), lexicons.IGNORED_TITLE_WORDS)
    return d.select(*keep, hashed_vector(t.tokenize(text)).alias("vector"), t.domains(F.col("locations"), F.col("title"), lexicons.GAZETTEER).alias("domains"), words.alias("words"), F.transform(F.filter(words, lambda w: F.length(w) > 3), lambda w: t.light_stem(w)).alias("stems"), "persons", "organizations", "locations")


def stories(d: DataFrame, batch: str, seq: str) -> DataFrame:
    """Rows with title, title_clean, content_clean and entity lists, clustered within their batch."""
    return clustering.incremental(traits(d, batch, seq), batch, seq)


def ingest_stories(raw: DataFrame, known: DataFrame, sources: DataFrame, batch: Column, seq: str = "id") -> DataFrame:
    """`ingest`, and the story of each article among those of its poll (`batch`): with columns batch and cluster."""
    d = cut(ingest(raw, known, sources, seq).withColumn("batch", batch), "ingested")
    return d.join(stories(d, "batch", seq).select(seq, "cluster"), seq)


def ingest(raw: DataFrame, known: DataFrame, sources: DataFrame, seq: str = "id") -> DataFrame:
    """New urls, prepared, without duplicates of each other or of a known article (same columns as `raw`), scored."""
    d = prepared(dedup.new_urls(raw, known, seq))
    dup = dedup.deduplicated(d, seq, F.col("content_clean"), known=prepared(known))
    return scored(d.join(dup.filter("not is_duplicate").select(F.col("id").alias(seq)), seq), sources)
