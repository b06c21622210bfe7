"""Near-duplicate texts by bit-sliced comparison of similarity sketches, with an exact check.

Each text becomes its set of word shingles (hashed to 64 bits), from that `BANDS * ROWS` minimum hashes. Three bits of
each minimum make the sketch: the expected Hamming distance of two sketches follows the overlap of the sets. Rows that
agree in a band of minima meet in a bucket; there the sketches are stored as vertical bit planes (64 rows a word), the
distances of one row to 64 others are counted at once with carry-save bitwise counters, and a block is abandoned as soon
as every lane exceeds the radius. What stays within the radius is checked exactly on the shingle sets.

Losses: a pair of overlap 0.82 meets in no band with probability 3e-6 and exceeds the radius with probability 1e-7.

Scale: equal sets are combined first (a group of copies of any size becomes one row), buckets beyond `BLOCK` rows are
split into block pairs, so no task holds an unbounded group, and nothing is collected to the driver.

Defined results: null, blank or too short texts (fewer than `size` words) have no shingles and no near-copies; equal texts
overlap by 1; rows without an id are left out; an id names one text, so rows repeated under it count once; an empty table
gives empty results. Columns other than id, text and lines are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.llm import looks
from warraq.llm.lines import line_ids_of_reading
from warraq.llm.skeleton import reading
from warraq.runtime import bounded_broadcast, cut

WORD = re.compile(r"[^\W_]+")
BANDS, ROWS, BITS = 21, 4, 3
#: Of 252 sketch bits, at overlap 0.82 about 23 +- 6 differ; unrelated texts differ in 126 +- 8.
RADIUS = 56
#: Rows of a bucket that one task compares with each other; larger buckets are split into block pairs.
BLOCK = 2048
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a fixed bijection of 64-bit words that looks random."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def words(text: str) -> list[str]:
    """The words of a text's reading form: runs of letters and digits."""
    return WORD.findall(reading(text))


def kept_words(text: str, common: set[int] | None) -> list[str]:
    """The words of a text without the lines listed in `common`."""
    t = reading(text)
    if common:
        t = "\n".join(x for x, i in zip(t.split("\n"), line_ids_of_reading(t), strict=True) if i not in common)
    return WORD.findall(t)


def shingle_sets(texts: list[list[str]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): the distinct 64-bit shingle hashes of each list of words, sorted within each, one after the other; starts has one entry more than there are texts."""
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    codes: dict[str, int] = {}
    flat = np.fromiter((codes.setdefault(w, len(codes)) for t in texts for w in t), dtype=np.int64, count=int(lens.sum()))
    hashed = np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in codes), dtype=np.uint64, count=len(codes))[flat] if len(codes) else np.zeros(0, np.uint64)
    ends = np.cumsum(lens)
    n = np.maximum(lens - size + 1, 0)
    doc = np.repeat(np.arange(len(texts)), n)
    first = np.repeat(ends - lens, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    h = np.zeros(len(first), dtype=np.uint64)
    for k in range(size):
        h = mix(h + hashed[first + k] + np.uint64(k + 1))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def sketches(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each set (none empty): its bands' hashes (n, BANDS) and its sketch of 252 bits in four words (n, 4)."""
    n = len(starts) - 1
    minima = np.empty((BANDS * ROWS, n), dtype=np.uint64)
    for k, s in enumerate(_SEEDS):
        x = (h ^ s) * _M1
        x ^= x >> np.uint64(32)
        minima[k] = np.minimum.reduceat(x * _M2, starts[:-1])
    bands = np.zeros((n, BANDS), dtype=np.uint64)
    for b in range(BANDS):
        x = np.full(n, b + 1, dtype=np.uint64)
        for r in range(ROWS):
            x = mix(x + minima[b * ROWS + r])
        bands[:, b] = x
    m = mix(minima)
    bits = np.stack([(m >> np.uint64(j)) & np.uint64(1) for j in range(BITS)], axis=1).reshape(BANDS * ROWS * BITS, n).astype(np.uint8)
    bits = np.concatenate([bits, np.zeros((256 - len(bits), n), dtype=np.uint8)])
    return bands, np.ascontiguousarray(np.packbits(bits.T, axis=1)).view(np.uint64)


def _csa(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def within(planes: np.ndarray, blocks: np.ndarray, queries: np.ndarray, valid: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit-sliced Hamming distances of query rows to blocks of 64 rows.

    planes: (256, number of blocks) words, bit l of planes[p, b] being bit p of row 64 b + l. blocks, queries, valid: for
    each comparison its block, its query's row, and the lanes asked for. Returns the surviving comparisons' numbers and
    the lanes within the radius.
    """
    alive = np.arange(len(blocks))
    width = 9
    count = [np.zeros(len(blocks), dtype=np.uint64) for _ in range(width)]
    rows, lane = queries >> 6, (queries & 63).astype(np.uint64)
    exceeds = np.zeros(len(blocks), dtype=np.uint64)
    for lo in range(0, 252, 63):
        for p0 in range(lo, lo + 63, 7):
            d = [planes[p][blocks] ^ (np.uint64(0) - ((planes[p][rows] >> lane) & np.uint64(1))) for p in range(p0, p0 + 7)]
            s1, c1 = _csa(d[0], d[1], d[2])
            s2, c2 = _csa(d[3], d[4], d[5])
            s, c3 = _csa(s1, s2, d[6])
            t, f = _csa(c1, c2, c3)  # the seven differences now number s + 2 t + 4 f
            carry = count[0] & s
            count[0] = count[0] ^ s
            count[1], carry = _csa(count[1], t, carry)
            count[2], carry = _csa(count[2], f, carry)
            for j in range(3, width):
                count[j], carry = count[j] ^ carry, count[j] & carry
        exceeds = np.zeros(len(blocks), dtype=np.uint64)
        equal = ~exceeds
        for j in reversed(range(width)):
            if radius >> j & 1:
                equal &= count[j]
            else:
                exceeds |= equal & count[j]
                equal &= ~count[j]
        keep = (~exceeds & valid) != 0
        if not keep.all():  # blocks of which all lanes exceed the radius are abandoned
            alive, blocks, rows, lane, valid, exceeds = alive[keep], blocks[keep], rows[keep], lane[keep], valid[keep], exceeds[keep]
            count = [c[keep] for c in count]
        if not len(alive):
            break
    return alive, ~exceeds & valid


def bit_planes(sketch: np.ndarray) -> np.ndarray:
    """(n, 4) words to vertical planes (256, ceil(n / 64))."""
    n = len(sketch)
    nb = max(1, -(-n // 64))
    bits = np.zeros((nb * 64, 256), dtype=np.uint8)
    bits[:n] = np.unpackbits(np.ascontiguousarray(sketch).view(np.uint8), axis=1)
    lanes = np.ascontiguousarray(bits.reshape(nb, 64, 256).transpose(2, 0, 1))
    return np.packbits(lanes, axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def close_pairs(group: np.ndarray, sketch: np.ndarray, radius: int = RADIUS, at_once: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i < j) of all rows of the same group (a sorted array) whose sketches differ by at most `radius` bits."""
    n = len(group)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    planes = bit_planes(sketch)
    end = np.searchsorted(group, group, side="right")
    q = np.arange(n)
    q = q[end > q + 1]
    first, last = (q + 1) >> 6, (end[q] - 1) >> 6
    per = last - first + 1
    queries = np.repeat(q, per)
    blocks = np.repeat(first, per) + (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
    out_i, out_j = [], []
    for k in range(0, len(queries), at_once):
        qs, bs = queries[k : k + at_once], blocks[k : k + at_once]
        lo = np.maximum(qs + 1, bs * 64) - bs * 64
        hi = np.minimum(end[qs], bs * 64 + 64) - bs * 64
        full = ~np.uint64(0)
        valid = (full >> (64 - hi).astype(np.uint64)) & (full << lo.astype(np.uint64))
        alive, lanes = within(planes, bs, qs, valid, radius)
        r, l = np.nonzero(np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        out_i.append(qs[alive[r]])
        out_j.append(bs[alive[r]] * 64 + l)
    return np.concatenate(out_i), np.concatenate(out_j)


def _sets_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, hashes, starts) of the rows that have shingles, some thousands at a time."""
    for big in batches:
        for at in range(0, big.num_rows, 2000):
            b = big.slice(at, 2000)
            common = b["lines"].to_pylist() if "lines" in b.schema.names else [None] * b.num_rows
            ids = b["id"].to_numpy(zero_copy_only=False)
            texts = [kept_words(t, set(c) if c else None) if t else [] for t, c in zip(b["text"].to_pylist(), common, strict=True)]
            has = [i for i, s in enumerate(texts) if len(s) >= size]
            if has:
                yield ids[has].astype(np.int64), *shingle_sets([texts[i] for i in has], size)


def _longs(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _sketch_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, h, starts in _sets_of(batches, size):
            bands, sketch = sketches(h, starts)
            f1, f2 = np.add.reduceat(h, starts[:-1]), np.add.reduceat(mix(h + np.uint64(7)), starts[:-1])
            lists = pa.FixedSizeListArray.from_arrays(_longs(bands.ravel()), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids), _longs(f1), _longs(f2), pa.array(np.diff(starts).astype(np.int32)), *[_longs(sketch[:, k]) for k in range(4)], lists], ["id", "f1", "f2", "n", "s0", "s1", "s2", "s3", "bands"])

    return run


def _set_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, h, starts in _sets_of(batches, size):
            packed = h.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([packed[8 * x : 8 * y] for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], pa.binary())], ["id", "shingles"])

    return run


_SKETCH = "id bigint, f1 bigint, f2 bigint, n int, s0 bigint, s1 bigint, s2 bigint, s3 bigint, bands array<bigint>"
_PAIR = "a bigint, b bigint"


def sketched(docs: DataFrame, size: int = 5) -> DataFrame:
    """(id, f1, f2, n, s0..s3, bands) of `docs` (id, text[, lines]), as a cut; f1, f2 and n name the shingle set."""
    looks.ensure(docs.sparkSession)
    return cut(docs.mapInArrow(_sketch_batches(size), _SKETCH), "sketches")


def _compare(radius: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def pairs(t: pa.Table) -> pa.RecordBatch:
            col = lambda c: t[c].combine_chunks().to_numpy(zero_copy_only=False)
            bucket, part, side, ids, n = col("bucket"), col("part"), col("side"), col("id"), col("n")
            new = np.ones(len(ids), dtype=bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])
            sketch = np.stack([col(f"s{k}") for k in range(4)], axis=1).view(np.uint64)
            i, j = close_pairs(np.cumsum(new), sketch, radius)
            size = np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9
            ok = size & ((side[i] != side[j]) | (side[i] == 0) & (part[i] >= 0)) & (ids[i] != ids[j])
            x, y = ids[i[ok]], ids[j[ok]]
            p = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows < 20_000:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            bucket, part = t["bucket"].to_numpy(), t["part"].to_numpy()
            same = (bucket == bucket[-1]) & (part == part[-1])  # the last group may go on: it waits
            last = int(np.argmax(same))
            if last:
                yield pairs(t.slice(0, last))
            held = t.slice(last).to_batches()
            rows = t.num_rows - last
        if held:
            yield pairs(pa.Table.from_batches(held))

    return run


def candidate_pairs(reps: DataFrame, least: float, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a < b) of the rows whose sketches are within the radius, of all that agree in a band. `reps` (id, n, s0..s3, bands) must be a cut."""
    cols = ["id", "n", "s0", "s1", "s2", "s3"]
    rows = reps.select(*cols, F.explode("bands").alias("bucket"))
    hot = cut(rows.groupBy("bucket").agg(F.count("*").alias("rows")).filter(F.col("rows") > block).withColumn("k", F.ceil(F.col("rows") / block).cast("int")).drop("rows"), "hot-buckets")
    plain = rows.withColumns({"part": F.lit(0), "side": F.lit(0)})
    if not hot.isEmpty():
        # block x of k meets block y >= x: a row goes to its own pairs only, k copies of it in all
        small = bounded_broadcast(hot)
        plain = rows.join(small, "bucket", "left_anti").withColumns({"part": F.lit(0), "side": F.lit(0)})
        own = rows.join(small, "bucket").withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        lo, hi = F.least("own", "other"), F.greatest("own", "other")
        # inside one block (part >= 0) all pairs count, between two (part < 0) only those across
        part = F.when(lo == hi, lo).otherwise(-(lo * F.col("k") + hi) - 1)
        plain = plain.unionByName(own.withColumn("part", part.cast("int")).withColumn("side", F.when(F.col("own") > lo, 1).otherwise(0)).select(*plain.columns))
    met = plain.repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    return met.mapInArrow(_compare(radius, least), _PAIR).distinct()


def _overlap_batches(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, sims = [], []
            for k, (x, y) in enumerate(zip(b["x"].to_pylist(), b["y"].to_pylist(), strict=True)):
                u, v = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                sim = both / (len(u) + len(v) - both)
                if sim >= least:
                    keep.append(k)
                    sims.append(sim)
            t = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([t["a"], t["b"], pa.array(sims, pa.float64())], ["a", "b", "overlap"])

    return run


def links(docs: DataFrame, least: float = 0.8, size: int = 5) -> tuple[DataFrame, DataFrame]:
    """Of `docs` (id, text[, lines]): (members, pairs): (id, rep) of every row with shingles, rep naming its class of equal
    sets; (a, b, overlap) between reps, exact. Both are cuts. The shingle sets of all texts are never stored: those of
    rows with a candidate are made again from the texts."""
    docs = docs.select("id", "text", *[c for c in docs.columns if c == "lines"]).filter("id is not null")
    sk = sketched(docs, size)
    first = F.min(F.struct("id", "n", "s0", "s1", "s2", "s3", "bands")).alias("r")
    classes = sk.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("m"))
    members = cut(sk.select("id", "f1", "f2", "n").join(classes.filter("m > 1").drop("m"), ["f1", "f2", "n"], "left").select("id", F.coalesce("rep", "id").alias("rep")).distinct(), "members")
    reps = cut(sk.groupBy("f1", "f2", "n").agg(first).select("r.*"), "reps")
    found = cut(candidate_pairs(reps, least), "candidates")
    need = bounded_broadcast(cut(found.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "candidate-ids"))
    sets = cut(docs.join(need, "id", "left_semi").mapInArrow(_set_batches(size), "id bigint, shingles binary").dropDuplicates(["id"]), "sets")
    both = found.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    exact = both.mapInArrow(_overlap_batches(least), _PAIR + ", overlap double")
    return members, cut(exact, "links")


def all_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_a < id_b) of every two rows whose classes are linked or the same: the written-out form, as large as its result."""
    m = members.alias("m")
    x = pairs.join(members.select(F.col("rep").alias("a"), F.col("id").alias("id_x")), "a").join(members.select(F.col("rep").alias("b"), F.col("id").alias("id_y")), "b").select("id_x", "id_y")
    several = members.groupBy("rep").agg(F.count("*").alias("k")).filter("k > 1").select("rep")
    same = m.join(several, "rep", "left_semi")
    y = same.select("rep", F.col("id").alias("id_x")).join(same.select("rep", F.col("id").alias("id_y")), "rep").filter("id_x < id_y").select("id_x", "id_y")
    return x.unionByName(y).select(F.least("id_x", "id_y").alias("id_a"), F.greatest("id_x", "id_y").alias("id_b")).filter("id_a < id_b")


def degrees(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, rep, n_links, n_same): one row per row with shingles: its class, its links to other classes, the rows of its class."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    same = members.groupBy("rep").agg(F.count("*").alias("n_same"))
    return members.join(same, "rep").join(ends, "rep", "left").select("id", "rep", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_same")
