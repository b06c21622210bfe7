"""Capping the rows of dominant contributors, stratum by stratum.

Each contributor may keep `cap` rows. The cap is split over its strata (topics, periods) by largest remainder; slots a
stratum cannot fill go to the others; within a stratum rows are ranked by quality. With no strata a contributor is one
stratum and keeps its best rows.

The ranks are exact and no contributor passes through one task: the rows, reduced to their keys, are range-partitioned by
(contributor, stratum, quality order); each partition counts in order, and a small table of counts per partition gives
every partition its offset. Nothing is dropped to escape skew.

Defined results: a null contributor is one contributor; a null stratum is one stratum; quality that is null, NaN or
outside its bounds counts as equal and last; ties end with the id, repeated rows rank one
after the other; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from warraq.operators.prefix import running_sum
from warraq.runtime import bounded_broadcast, cut

def bounded_quality(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Quality with null, NaN and values outside the bounds as null."""
    return F.when(F.isnan(c) | (c < low) | (c > high), None).otherwise(c)


def apportion(cap: int, sizes: list[int]) -> list[int]:
    """Split `cap` in proportion to `sizes` by largest remainder (ties: the earlier), no part above its size, spare slots redistributed."""
    total = sum(sizes)
    if cap >= total:
        return list(sizes)
    exact = [cap * s / total for s in sizes]
    out = [min(s, math.floor(x)) for s, x in zip(sizes, exact, strict=True)]
    left = cap - sum(out)
    for i in sorted(range(len(sizes)), key=lambda i: (-(exact[i] - math.floor(exact[i])), i)):
        if left and out[i] < sizes[i]:
            out[i] += 1
            left -= 1
    while left:  # only where rounding filled a small stratum
        room = [i for i in range(len(sizes)) if out[i] < sizes[i]]
        for i in sorted(room, key=lambda i: (out[i] - exact[i], i))[:left]:
            out[i] += 1
            left -= 1
    return out


def ranked(df: DataFrame, id_col: str, contributor: Column, order: list[Column], stratum: Column | None = None) -> DataFrame:
    """(id, contributor, stratum, rank): each row's exact place, from 1, in its contributor's stratum under `order`. Names hold no line break."""
    # both names in one key: a contributor's strata lie side by side
    whole = F.concat(F.coalesce(contributor, F.lit("")), F.lit("\n"), F.coalesce(stratum, F.lit("")) if stratum is not None else F.lit(""))
    part = F.split("group", "\n", 2)
    return running_sum(df, id_col, whole, order).select("id", part[0].alias("contributor"), part[1].alias("stratum"), (F.col("before") + 1).alias("rank"))


def _shares(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("stratum")
    return pdf[["contributor", "stratum"]].assign(slots=apportion(int(pdf["cap"].iloc[0]), pdf["n"].astype(int).tolist()))


def capped(ranks: DataFrame, cap: DataFrame) -> DataFrame:
    """`ranks` with `slots` of the row's stratum and `kept`. cap: one row (cap bigint), the most rows a contributor keeps."""
    sizes = ranks.groupBy("contributor", "stratum").agg(F.count("*").alias("n")).join(F.broadcast(cap.limit(1)))  # one row
    slots = sizes.groupBy("contributor").applyInPandas(_shares, T.StructType([T.StructField("contributor", T.StringType()), T.StructField("stratum", T.StringType()), T.StructField("slots", T.LongType())]))
    return ranks.join(bounded_broadcast(cut(slots, "slots")), ["contributor", "stratum"]).withColumn("kept", F.col("rank") <= F.col("slots"))
