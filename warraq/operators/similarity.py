"""Vectors as arrays: norms, cosines, centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def normalized(v: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centroid, n): the mean vector brought to length 1. Sums per dimension combine before the shuffle."""
    d = df.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    g = d.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("s"), F.max("n").alias("n"))
    return g.select(group, normalized(F.transform("s", lambda e: e["m"])).alias("centroid"), "n")


#: Vectors of one block, of queries and of rows: a pair of blocks is one matrix product.
QUERY_BLOCK, ROW_BLOCK = 512, 4096


def _blocks(df: DataFrame, id_col: str, vector: str, size: int, name: str) -> DataFrame:
    """(<name>): arrays of about `size` (id, vector) each."""
    n = max(1, -(-df.count() // size))
    d = df.filter(F.col(vector).isNotNull()).select(F.pmod(F.xxhash64(id_col), F.lit(n)).alias("block"), F.struct(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).alias("s"))
    return d.groupBy("block").agg(F.collect_list("s").alias(name)).select(name)


def _unit(block: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    s = block.values
    v = np.stack(s.field("v").to_numpy(zero_copy_only=False)).astype(np.float64)
    return s.field("id").to_numpy(), v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _nearest_batches(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q, r in zip(b["queries"], b["rows"], strict=True):
                (qi, qv), (ri, rv) = _unit(q), _unit(r)
                sim = qv @ rv.T
                sim[qi[:, None] == ri[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ri, sim.shape), -sim), axis=1)[:, :top]
                found = np.take_along_axis(sim, order, axis=1)
                ok = np.isfinite(found).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, order.shape[1])[ok]), pa.array(ri[order].ravel()[ok]), pa.array(found.ravel()[ok])], ["query_id", "id", "sim"])

    return run


def nearest(queries: DataFrame, rows: DataFrame, id_col: str, vector: str, top: int) -> DataFrame:
    """(query_id, <id_col>, place) of the `top` other rows of greatest cosine, ties by id: exact. Blocks of the stated query set
    meet blocks of all rows, and of each pair of blocks only `top` rows a query move on. Rows without a vector are left out."""
    met = _blocks(rows, id_col, vector, ROW_BLOCK, "rows").crossJoin(_blocks(queries, id_col, vector, QUERY_BLOCK, "queries"))
    best = met.mapInArrow(_nearest_batches(top), "query_id bigint, id bigint, sim double")
    ranked = best.withColumn("place", F.expr("row_number() over (partition by query_id order by sim desc, id)")).filter(F.col("place") <= top)
    return ranked.select("query_id", F.col("id").alias(id_col), F.col("place").cast("bigint").alias("place"))
