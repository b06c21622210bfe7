"""Samples and balances for training sets; orders are by a seeded hash, so a run can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warraq.operators.prefix import running_sum


def shuffled_key(c: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", c.cast("string"), F.lit(str(seed))))


def places(df: DataFrame, id_col: str, seed: int, group: Column | None = None) -> DataFrame:
    """(id, place from 0) in a seeded shuffle, within `group` if given; exact, and no group passes through one task."""
    return running_sum(df, id_col, group if group is not None else F.lit(""), [shuffled_key(F.col(id_col), seed)]).select("id", F.col("before").alias("place"))


def oversampled(df: DataFrame, id_col: str, minority: Column, ratio: float = 0.50) -> DataFrame:
    """Rows with `copies`: the minority repeated whole, its first rows (by id) once more, until it has its share."""
    d = df.withColumn("_m", F.coalesce(minority, F.lit(False)))
    n = d.agg(F.count(F.when(F.col("_m"), 1)).alias("pos"), F.count(F.when(~F.col("_m"), 1)).alias("neg"))
    n = n.select(F.greatest("pos", F.floor(ratio * F.col("neg") / (1 - ratio) + 1e-9)).alias("target"), "pos")
    rank = running_sum(d.filter("_m"), id_col, F.lit(""), []).select(F.col("id").alias(id_col), F.col("before").alias("_r"))
    j = d.join(rank, id_col, "left").join(F.broadcast(n))  # one row
    copies = F.when(F.col("_m"), F.floor(F.col("target") / F.col("pos")) + (F.col("_r") < F.col("target") % F.col("pos")).cast("int")).otherwise(1)
    return j.withColumn("copies", copies.cast("int")).drop("_m", "_r", "target", "pos")


def blocks(df: DataFrame, id_col: str, n_blocks: int = 24, size: int = 250, seed: int = 11) -> DataFrame:
    """(block, id): `n_blocks` runs of `size` rows at even steps of a seeded shuffle; blocks of a small table overlap."""
    n = df.agg(F.greatest(F.lit(0), F.floor((F.count("*") - size) / max(1, n_blocks - 1))).alias("step"))
    p = places(df, id_col, seed).join(F.broadcast(n))  # one row
    starts = F.array(*[F.struct(F.lit(b).alias("block"), (F.lit(b) * F.col("step")).alias("start")) for b in range(n_blocks)])
    hit = F.filter(starts, lambda s: (F.col("place") >= s["start"]) & (F.col("place") < s["start"] + size))
    return p.select("id", F.explode(hit).alias("s")).select(F.col("s.block").alias("block"), "id")


def stratified(df: DataFrame, id_col: str, stratum: Column, per: int, seed: int = 42) -> DataFrame:
    """The ids of `per` rows of each stratum, first in a seeded shuffle."""
    return places(df, id_col, seed, stratum).filter(F.col("place") < per).select("id")


def split(df: DataFrame, id_col: str, seed: int = 11, held_out: float = 0.1) -> DataFrame:
    """`df` with `held_out`: the last part of a seeded shuffle, floor(rows * share) rows exactly. Ids are unique."""
    n = df.agg((F.count("*") - F.floor(F.count("*") * held_out + 1e-9)).alias("_n"))
    p = places(df, id_col, seed).select(F.col("id").alias(id_col), F.col("place").alias("_p"))
    return df.join(p, id_col).join(F.broadcast(n)).withColumn("held_out", F.col("_p") >= F.col("_n")).drop("_p", "_n")


def shuffled(df: DataFrame, id_col: str, most: int, seed: int = 42) -> DataFrame:
    """The first `most` rows of a seeded shuffle."""
    return df.withColumn("_k", shuffled_key(F.col(id_col), seed)).orderBy("_k", id_col).limit(most).drop("_k")


def right_and_wrong(df: DataFrame, id_col: str, right: Column, per: int = 5, seed: int = 123) -> DataFrame:
    """(id, right): `per` rows that are right and `per` that are not, first in a seeded shuffle; rows of unknown outcome are left out."""
    d = df.select(F.col(id_col).alias("id"), right.alias("right")).filter("right is not null")
    rows = [d.filter(c).orderBy(shuffled_key(F.col("id"), seed), "id").limit(per) for c in ("right", "not right")]
    return rows[0].unionByName(rows[1])


def numbered(df: DataFrame, id_col: str, group: Column) -> DataFrame:
    """(id, place): every row's place from 1 within its group, by id; exact, and no group passes through one task."""
    return running_sum(df, id_col, group, []).select("id", (F.col("before") + 1).alias("place"))
