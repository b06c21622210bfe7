"""Exact running sums over ordered groups without one task per group.

A window function sorts a whole group in one task. Here the rows are range-partitioned by (group, order), every partition
sums in order, and a small table of sums per (group, partition) gives each partition its offset: a group of any size is
spread over as many tasks as its rows need.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warraq.runtime import bounded_broadcast, cut, partitions


def _sum_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, total = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        g = b["group"].dictionary_encode()
        code = g.indices.to_numpy(zero_copy_only=False)
        value = b["value"].to_numpy(zero_copy_only=False)
        new = np.ones(len(code), dtype=bool)
        new[1:] = code[1:] != code[:-1]
        first = b["group"][0].as_py()
        carry = total if last == first else 0
        sums = np.cumsum(value)
        at = np.flatnonzero(new)
        base = np.repeat(sums[at] - value[at], np.diff(np.append(at, len(code))))
        base[: at[1] if len(at) > 1 else len(code)] -= carry
        upto = sums - base
        last, total = b["group"][-1].as_py(), int(upto[-1])
        cols = [b[c] for c in b.schema.names if c != "value"]
        names = [c for c in b.schema.names if c != "value"]
        yield pa.RecordBatch.from_arrays([*cols, b["value"], pa.array(upto - value), pa.array(upto)], [*names, "value", "here", "upto"])


def running_sum(df: DataFrame, id_col: str, group: Column, order: list[Column], value: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(id, group, value, before, *keep): for each row the sum of `value` (default 1: the row's place from 0) over the rows before it.

    Rows are ordered by `order`, then id; a null group is the group ''; null values count 0. Repeated ids follow each other.
    """
    keys = [f"k{i}" for i in range(len(order))]
    v = F.coalesce(value.cast("bigint"), F.lit(0)) if value is not None else F.lit(1)
    d = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(group.cast("string"), F.lit("")).alias("group"), v.cast("bigint").alias("value"), *[o.alias(k) for o, k in zip(order, keys, strict=True)], *keep)
    by = ["group", *keys, "id"]
    spread = d.repartitionByRange(partitions(df.sparkSession), *by).sortWithinPartitions(*by).select("id", "group", "value", F.spark_partition_id().alias("part"), *keep)
    placed = cut(spread.mapInArrow(_sum_in_order, "id bigint, group string, part int, " + "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in keep) + "value bigint, here bigint, upto bigint"), "running")
    # at most one row per partition and one per group
    pieces = placed.groupBy("group", "part").agg(F.sum("value").alias("n"))
    offset = F.coalesce(F.expr("sum(n) over (partition by group order by part rows between unbounded preceding and 1 preceding)"), F.lit(0))
    offsets = cut(pieces.select("group", "part", offset.alias("offset")), "offsets")
    return placed.join(bounded_broadcast(offsets), ["group", "part"]).select("id", "group", "value", (F.col("here") + F.col("offset")).alias("before"), *keep)
