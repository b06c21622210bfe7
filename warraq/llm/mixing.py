"""Mixing sources to target shares of the tokens.

Every source's texts, in a fixed order, form one stream of tokens, cut into blocks of fixed length. The set's size is the
largest for which each source can give its share without using a block more than its allowed repeats; the blocks of each
source follow by largest remainder. Output slots are shuffled over all sources by one pseudorandom permutation, so the
counts a shard draws from the sources are multinomial, held to the exact totals; a source's slots map to its blocks by a
pseudorandom permutation for each round through the source. Slots and texts meet by block index.

Defined results: null and empty texts have no tokens; texts of a source without a target are left out; a target without
texts gets nothing and the other shares are scaled up, which the report shows; repeated ids count per row; an empty table
gives an empty set. Targets are a small fixed table; texts are never collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.llm.caps import apportion
from warraq.llm.nearcopies import mix
from warraq.operators.prefix import running_sum
from warraq.runtime import bounded_broadcast, cut

BLOCK, SHARD = 256, 1000


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at the positions x: a Feistel network on the next even number of bits, walked on until it lands inside."""
    if n < 2:
        return np.zeros_like(x)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, 5, dtype=np.uint64) + np.uint64(key % 2**63) * np.uint64(8))
    out = x.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        v = out[todo]
        left, right = v >> np.uint64(half), v & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        v = (left << np.uint64(half)) | right
        out[todo] = v
        todo = todo[v >= n]
    return out.astype(np.int64)


def plan(tokens: dict[str, int], targets: dict[str, tuple[float, int]], block: int = BLOCK, total: int | None = None) -> dict[str, tuple[int, int]]:
    """(blocks the source has, blocks it gives) by source. targets: (share, most repeats). `total` blocks, or as many as all
    targets can be met with; a source that can't give its share of `total` gives all it may."""
    have = {s: -(-tokens.get(s, 0) // block) for s in targets if tokens.get(s, 0) > 0 and targets[s][0] > 0}
    if not have:
        return {}
    total_share = sum(targets[s][0] for s in have)
    if total is None:
        total = min(int(have[s] * targets[s][1] * total_share / targets[s][0]) for s in have)
    names = sorted(have)
    # whole blocks in proportion to the shares, no source beyond its repeats
    scale = 10**9
    given = apportion(total, [max(1, round(targets[s][0] / total_share * scale)) for s in names])  # total is below the sum of these
    return {s: (have[s], min(g, have[s] * targets[s][1])) for s, g in zip(names, given, strict=True)}


def _slots(names: list[str], have: list[int], given: list[int], shard: int, seed: int):
    ends = np.cumsum(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = b["slot"].to_numpy()
            at = permuted(slot, int(ends[-1]), seed)
            s = np.searchsorted(ends, at, side="right")
            j = at - (ends[s] - np.array(given)[s])
            n = np.array(have)[s]
            copy = j // n
            block = np.zeros(len(slot), dtype=np.int64)
            for k in np.unique(s):
                for c in np.unique(copy[s == k]):
                    m = (s == k) & (copy == c)
                    block[m] = permuted(j[m] % n[m], have[k], seed + 1000 * int(k + 1) + int(c))
            yield pa.RecordBatch.from_arrays([pa.array(slot // shard), pa.array(slot), pa.array([names[k] for k in s]), pa.array(block), pa.array(copy)], ["shard", "slot", "source", "block", "copy"])

    return run


def mixed(sizes: DataFrame, targets: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = 1, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts, shares). sizes: (id, source, tokens), a cut; targets: (source, target_share, max_repeats).

    texts: (shard, slot, source, block, copy, id, from_token, to_token), the pieces of texts each slot holds; shares: per source its target, its share reached, what is missing of the target, and the most copies of a block used. The set has `total` tokens, or as many as the scarcest source allows.
    """
    spark = sizes.sparkSession
    want = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.collect()}  # a fixed small table
    ours = sizes.select("id", "source", "tokens").join(bounded_broadcast(targets.select("source").distinct()), "source", "left_semi").filter("tokens > 0")
    tokens = {r["source"]: r["n"] for r in ours.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}  # a row per target
    chosen = plan(tokens, want, block, None if total is None else max(1, total // block))
    names = list(chosen)
    spans = running_sum(ours, "id", F.col("source"), [F.xxhash64("id")], F.col("tokens")).withColumnRenamed("group", "source")
    lo, hi = F.col("before"), F.col("before") + F.col("value")
    at = F.explode(F.sequence(F.floor(lo / block), F.floor((hi - 1) / block)))
    pieces = spans.withColumn("block", at).select("source", "block", "id", (F.greatest(lo, F.col("block") * block) - lo).alias("from_token"), (F.least(hi, (F.col("block") + 1) * block) - lo).alias("to_token"))
    if names:
        slots = spark.range(sum(g for _, g in chosen.values())).withColumnRenamed("id", "slot").mapInArrow(_slots(names, [h for h, _ in chosen.values()], [g for _, g in chosen.values()], shard, seed), "shard bigint, slot bigint, source string, block bigint, copy bigint")
    else:
        slots = spark.createDataFrame([], "shard bigint, slot bigint, source string, block bigint, copy bigint")
    texts = cut(slots.join(pieces, ["source", "block"]).select("shard", "slot", "source", "block", "copy", "id", "from_token", "to_token"), "mixed")
    got = texts.groupBy("source").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("tokens"), (F.max("copy") + 1).alias("copies"))
    whole = texts.agg(F.sum(F.col("to_token") - F.col("from_token")).alias("total"))
    shares = targets.join(got, "source", "left").join(F.broadcast(whole)).select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.coalesce("tokens", F.lit(0)) / F.col("total")).alias("share"), F.greatest(F.lit(0.0), F.col("target_share") - F.coalesce("tokens", F.lit(0)) / F.col("total")).alias("shortfall"), F.coalesce("copies", F.lit(0)).alias("copies"))
    return texts, shares
