"""Packing texts into containers of fixed capacity by length patterns.

Lengths are put in a histogram (bounded by the capacity, whatever the number of texts). Patterns, sets of lengths that
fill a container, are enumerated from it: pairs and triples that fill exactly, and the fillings that best fit leads to when
the whole histogram is packed, equal lengths at a time. Non-negative least squares fits the patterns' repeat counts to the
histogram; they are rounded, every text takes its place by its exact rank within its length, and the residual texts are
packed by best fit in blocks. Patterns only propose: whatever they leave out is packed as residual.

Defined results: null and empty texts have no tokens and go to no container; a text longer than the capacity is split into
full containers and one remainder, others never; repeated ids are packed once per row, each row's containers being its own
where they are full; rows without an id are left out; an empty table packs nothing.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.operators.prefix import running_sum
from warraq.runtime import cut

#: Pairs and triples that become patterns (those that can be repeated most), residual texts a block.
PATTERNS, RESIDUAL = 3000, 20_000


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The container number of each size, largest first into the fullest container that takes it."""
    free: list[tuple[int, int]] = []
    out = [0] * len(sizes)
    n = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = bisect_left(free, (sizes[i], -1))
        if k == len(free):
            room, c = capacity, n
            n += 1
        else:
            room, c = free.pop(k)
        out[i] = c
        if room > sizes[i]:
            insort(free, (room - sizes[i], c))
    return out


Pattern = tuple[tuple[int, int], ...]


def fillings(hist: np.ndarray) -> Counter:
    """What best fit, longest first, fills containers with: pattern ((length, how many), ...) -> containers. hist over lengths 0..K.

    Equal containers are one entry with a count, and a length's texts are placed together: an emptiest fitting container takes
    as many of them as go in, as it stays the best fit. The work grows with the number of lengths, not of texts.
    """
    k = len(hist) - 1
    rooms: list[int] = []
    open_: dict[int, list[tuple[Pattern, int]]] = {}
    out: Counter = Counter()

    def put(room: int, p: Pattern, n: int) -> None:
        if not n:
            return
        if room == 0:
            out[tuple(sorted(p))] += n
            return
        if room not in open_:
            insort(rooms, room)
            open_[room] = []
        open_[room].append((p, n))

    for size in np.flatnonzero(hist)[::-1].tolist():
        left = int(hist[size])
        while left and size:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                room, p, n = k, (), left
            else:
                room = rooms[at]
                p, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            each = room // size
            times = min(n, left // each)
            put(room - each * size, (*p, (size, each)), times)
            n, left = n - times, left - times * each
            if left and n:  # fewer than one more container takes
                put(room - left * size, (*p, (size, left)), 1)
                n, left = n - 1, 0
            if p:
                put(room, p, n)
    for groups in open_.values():
        for p, n in groups:
            out[tuple(sorted(p))] += n
    return out


def patterns_of(hist: np.ndarray) -> list[Pattern]:
    """Patterns for a histogram over lengths 0..K (index K: the capacity)."""
    k = len(hist) - 1
    have = np.flatnonzero(hist)
    have = have[have > 0]
    # pairs and triples that fill exactly: how often they can be repeated, and their lengths
    best: list[np.ndarray] = []
    for i in have[::-1]:
        if 0 < k - i <= i and hist[k - i]:
            best.append(np.array([[min(hist[i], hist[k - i]), i, k - i, 0]]))
        rest = have[(have <= i) & (have < k - i)]
        third = k - i - rest
        ok = (third > 0) & (third <= rest)
        ok[ok] = hist[third[ok]] > 0
        if ok.any():
            j, t = rest[ok], third[ok]
            best.append(np.stack([np.minimum(np.minimum(hist[i], hist[j]), hist[t]), np.full(len(j), i), j, t], axis=1))
        if len(best) > 200:  # keep only what can still be among the first
            best = [_first(np.concatenate(best))]
    found: Counter = Counter()
    for r in _first(np.concatenate(best)).tolist() if best else []:
        found[tuple(sorted(Counter(x for x in r[1:] if x).items()))] += 1
    found.update(fillings(hist))
    return list(found)


def _first(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort(-rows.T[::-1])][:PATTERNS]


def nnls(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, target: np.ndarray, n: int, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |A x - target|, A given by its entries: projected gradient with momentum, columns scaled to length 1."""
    length = np.sqrt(np.bincount(cols, values**2, minlength=n))
    v = values / length[cols]
    times = lambda x: np.bincount(rows, v * x[cols], minlength=len(target))
    back = lambda r: np.bincount(cols, v * r[rows], minlength=n)
    z = np.ones(n)
    for _ in range(30):  # the largest eigenvalue of A'A
        z = back(times(z))
        top = np.linalg.norm(z)
        z /= top
    x = y = back(target) / top
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(times(y) - target) / top)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / s * (new - x)
        x, t = new, s
    return x / length


def fit_patterns(hist: np.ndarray) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(pattern, repeats): together they use no length more often than the histogram has it."""
    pats = patterns_of(hist)
    if not pats:
        return []
    rows = np.array([b for p in pats for b, _ in p])
    cols = np.repeat(np.arange(len(pats)), [len(p) for p in pats])
    values = np.array([m for p in pats for _, m in p], dtype=float)
    x = np.floor(nnls(rows, cols, values, hist.astype(float), len(pats)) + 0.5).astype(np.int64)
    left = hist.astype(np.int64).copy()
    out = []
    # the patterns with most tokens first; each as often as it is meant to be and still can
    for p in np.argsort([-sum(b * m for b, m in q) for q in pats], kind="stable"):
        n = int(min(x[p], min(left[b] // m for b, m in pats[p])))
        if n > 0:
            out.append((pats[p], n))
            for b, m in pats[p]:
                left[b] -= n * m
    return out


def _assign(starts: np.ndarray, sizes: np.ndarray, pattern: np.ndarray, many: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank, step = b["rank"].to_numpy(), b["step"].to_numpy().astype(np.int64)
            key = (step << 44) + rank
            at = np.searchsorted(starts, key, side="right") - 1
            at = np.maximum(at, 0)
            inside = (key >= starts[at]) & (key < starts[at] + sizes[at]) if len(starts) else np.zeros(len(key), bool)
            p = np.where(inside, pattern[at] if len(starts) else -1, -1)
            k = np.where(inside, (key - (starts[at] if len(starts) else 0)) // (many[at] if len(starts) else 1), 0)
            yield pa.RecordBatch.from_arrays([b["item"], b["row"], b["piece"], b["start"], b["tokens"], pa.array(p.astype(np.int64)), pa.array(k.astype(np.int64))], ["item", "row", "piece", "start", "tokens", "pattern", "number"])

    return run


def packed(sizes: DataFrame, capacity: int) -> DataFrame:
    """Of `sizes` (id, tokens), a cut: (id, piece, start, tokens, container). Containers are named, the names say how they came about."""
    n = F.col("tokens")
    cuts = F.when(n <= capacity, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.ceil(n / capacity).cast("bigint") - 1))
    # each row under a number of its own, as ids may repeat; a cut, so the numbers stay
    rows = sizes.select("id", "tokens").filter((n > 0) & F.col("id").isNotNull()).withColumn("item", F.monotonically_increasing_id())
    pieces = cut(rows.withColumn("piece", F.explode(cuts)).select("item", F.col("id").alias("row"), "piece", (F.col("piece") * capacity).alias("start"), F.least(n - F.col("piece") * capacity, F.lit(capacity)).cast("bigint").alias("tokens")), "pieces")
    full = pieces.filter(F.col("tokens") == capacity).withColumn("container", F.concat_ws("-", F.lit("full"), "item", "piece")).withColumnRenamed("row", "id")
    rest = pieces.filter(F.col("tokens") < capacity)
    counts = rest.groupBy("tokens").agg(F.count("*").alias("n")).collect()  # fewer rows than the capacity, whatever the table's size
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for r in counts:
        hist[r["tokens"]] += r["n"]
    plan = fit_patterns(hist)
    used: dict[int, int] = {}
    entries = []
    for p, (pattern, times) in enumerate(plan):
        for b, m in pattern:
            entries.append(((b << 44) + used.get(b, 0), m * times, p, m))
            used[b] = used.get(b, 0) + m * times
    entries.sort()
    arrays = [np.array([e[i] for e in entries], dtype=np.int64) for i in range(4)]
    ranked = running_sum(rest, "item", F.col("tokens"), [], keep=["tokens", "row", "piece", "start"])
    ranked = ranked.select(F.col("id").alias("item"), F.col("group").cast("int").alias("step"), F.col("before").alias("rank"), "tokens", "row", "piece", "start")
    placed = cut(ranked.mapInArrow(_assign(*arrays), "item bigint, row bigint, piece bigint, start bigint, tokens bigint, pattern bigint, number bigint"), "placed")
    by_pattern = placed.filter("pattern >= 0").withColumn("container", F.concat_ws("-", F.lit("pattern"), "pattern", "number"))
    left = placed.filter("pattern < 0")
    blocks = max(1, -(-left.count() // RESIDUAL))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        pdf = pdf.sort_values("item", kind="stable")
        return pd.DataFrame({"id": pdf["row"], "piece": pdf["piece"], "start": pdf["start"], "tokens": pdf["tokens"], "container": [f"rest-{block}-{c}" for c in best_fit(pdf["tokens"].tolist(), capacity)]})

    by_fit = left.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))).groupBy("block").applyInPandas(fit, "id bigint, piece bigint, start bigint, tokens bigint, container string")
    short = by_pattern.select(F.col("row").alias("id"), "piece", "start", "tokens", "container").unionByName(by_fit)
    return full.select("id", "piece", "start", "tokens", "container").unionByName(short)
