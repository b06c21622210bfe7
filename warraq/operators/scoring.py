"""Reliability, neutrality and attribution scores with the labels derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warraq.functions import text as t


def two_places(c: Column) -> Column:
    return F.floor(c * 100 + 0.5) / 100


def authority(df: DataFrame, sources: DataFrame, name: str = "source_name", default: float = 0.40, position: Column | None = None) -> DataFrame:
    """`df` with `authority`: the score of the source's last listing, else the default. The registry is a fixed small table;
    `position` tells the order of its listings, by default that of the table as it is read."""
    place = position if position is not None else F.monotonically_increasing_id()
    listed = sources.select(F.col("name").alias(name), "reliability_score", place.alias("_place"))
    last = listed.groupBy(name).agg(F.max_by("reliability_score", "_place").alias("authority"))
    return df.join(last, name, "left").withColumn("authority", F.coalesce("authority", F.lit(default)))


def neutrality(ratio: Column) -> Column:
    return two_places(F.greatest(F.lit(0.0), 1 - 20 * ratio))


def attribution(title: Column, text: Column, markers: Sequence[str]) -> Column:
    """Quotes, a 'name: statement' title, and markers; not capped."""
    whole = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(F.coalesce(text, F.lit("")), 1, 600))
    quotes = F.when(F.regexp_count(whole, F.lit('["«»“”]')) >= 2, 0.40).otherwise(0.0)
    colon = F.when(F.coalesce(title, F.lit("")).rlike(rf"[{t.WORD}]+\s*:\s*[{t.WORD}]+"), 0.35).otherwise(0.0)
    return two_places(quotes + colon + F.least(F.lit(0.60), t.marker_count(whole, markers) * 0.15))


def attribution_label(score: Column) -> Column:
    return F.when(score >= 0.30, "supported_claim").otherwise("unsupported_claim")


def statement_type(title: Column, text: Column, neutral: Column, markers: Sequence[str]) -> Column:
    whole = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))
    return F.when(t.has_marker(whole, markers) | (neutral < 0.50), "opinion").otherwise("reporting")


def reliability(auth: Column, neutral: Column, attr: Column, consensus: Column | None = None) -> Column:
    return two_places(0.35 * auth + 0.35 * neutral + 0.15 * attr + 0.15 * (consensus if consensus is not None else F.lit(1.0)))


def bias_override(label: Column, neutral: Column) -> Column:
    return F.when(((1 - neutral) * 100 > 50) & label.isin("neutral", "no_propaganda"), "propaganda").otherwise(label)


def is_verified(rel: Column, neutral: Column, statement: Column, attr_label: Column, label: Column) -> Column:
    return F.coalesce((rel >= 0.70) & (neutral >= 0.60) & (statement == "reporting") & (attr_label == "supported_claim") & label.isin("neutral", "no_propaganda"), F.lit(False))


def rule_classifier(ratio: Column, least: float = 0.02) -> Column:
    """The default stand-in for a propaganda model: a rule on the share of loaded words."""
    return F.when(ratio >= least, "propaganda").otherwise("neutral")
