"""Records that stand in more than one split: a weighted cosine join between the splits.

Every record is a vector of term weights (terms: runs of `size` words of the reading form), of length 1: all terms of a record
alike, or each by its rarity over all records. Inverted lists hold only those terms of a record that can start a pair: with
terms ordered from rare to common, a term goes to the list (or is looked up) only while the bound of the rest, the smaller of
its maximum-weight sum against the other side and its residual norm, still reaches the threshold. Partial dot products plus
the product of the residual norms behind the last term met prune again; what stays gets its exact dot product. Nothing is
lost: a pair at the threshold shares its rarest shared term in both lists, and a shared term that was not met lies behind the
last one met in both orders.

With equal weights, an overlap (Jaccard) of t implies a cosine of 2 t / (1 + t) at least, so the join at that cosine finds
every pair of overlap t; the exact size of the intersection gives the exact overlap. An overlap is one of sets, so it is asked
for with equal weights; weights by rarity are for a threshold on the cosine itself.

Defined results: null, blank or too short texts have no terms and overlap nothing; equal texts overlap by 1; records whose
split is null count as not of the reference split; rows without an id are left out, rows repeated under an id count once; an
empty table gives empty results. Equal vectors of a side are combined first; lists of hot terms are split into pieces, on both
sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.llm import looks
from warraq.llm.nearcopies import _longs, _sets_of, mix
from warraq.runtime import cut

#: Entries of one inverted list that meet in one group; longer lists are split.
PIECE = 5000


def cosine_for_overlap(t: float) -> float:
    return 2 * t / (1 + t)


def _vector_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tables = {True: b.filter(pc.equal(b["side"], True)), False: b.filter(pc.equal(b["side"], False))}
            for side, t in tables.items():
                for ids, h, starts in _sets_of(iter([t]), size):
                    f1, f2 = np.add.reduceat(h, starts[:-1]), np.add.reduceat(mix(h + np.uint64(7)), starts[:-1])
                    terms = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), _longs(h))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([side] * len(ids)), _longs(f1), _longs(f2), pa.array(np.diff(starts).astype(np.int32)), terms], ["id", "side", "f1", "f2", "n", "terms"])

    return run


_VECTOR = "id bigint, side boolean, f1 bigint, f2 bigint, n int, terms array<bigint>"


def prefix_length(w: np.ndarray, other: np.ndarray, least: float) -> int:
    """How many of a record's terms (rare to common; w: their weights, other: the largest weight the other side gives them)
    must be in the lists so that every record of the other side with a dot product of `least` or more is met."""
    norm = np.sqrt(np.cumsum((w * w)[::-1])[::-1])
    dot = np.cumsum((w * other)[::-1])[::-1]
    return int(np.count_nonzero(np.minimum(norm, dot) >= least - 1e-9))


def _prefix_batches(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b["terms"].flatten()
            ends = np.cumsum(b["terms"].value_lengths().to_numpy(zero_copy_only=False))
            w, other = flat.field("w").to_numpy(), flat.field("other").to_numpy()
            keep, rows, after = [], [], []
            lo = 0
            for r, hi in enumerate(ends.tolist()):
                p = prefix_length(w[lo:hi], other[lo:hi], least)
                if p:
                    keep.append(np.arange(lo, lo + p))
                    rows.append(np.full(p, r))
                    # of each term, the norm of those behind it
                    x = w[lo:hi] ** 2
                    after.append(np.sqrt(np.maximum(0.0, x.sum() - np.cumsum(x)))[:p])
                lo = hi
            at = pa.array(np.concatenate(keep) if keep else np.zeros(0, np.int64))
            row = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            t = flat.take(at)
            own = b.select(["id", "side", "n"]).take(row)
            yield pa.RecordBatch.from_arrays([t.field("term"), t.field("p1"), t.field("p0"), own["id"], own["side"], own["n"], t.field("w"), pa.array(np.concatenate(after) if after else np.zeros(0))], ["term", "p1", "p0", "id", "side", "n", "w", "after"])

    return run


_LIST = "term bigint, p1 int, p0 int, id bigint, side boolean, n int, w double, after double"


def _exact_batches(least: float, overlap: float):
    """Exact dot products and overlaps of pairs (a, b, x, y): sorted terms, as unsigned numbers, with their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, dots, sims = [], [], [], []
            for i, j, x, y in zip(b["a"].to_pylist(), b["b"].to_pylist(), b["x"], b["y"], strict=True):
                u, v = (z["terms"].values.to_numpy().view(np.uint64) for z in (x, y))
                at = np.minimum(np.searchsorted(v, u), len(v) - 1)
                hit = v[at] == u
                both = int(np.count_nonzero(hit))
                sim = both / (len(u) + len(v) - both)
                if sim < overlap:
                    continue
                if x["w"].is_valid:
                    dot = float((x["w"].values.to_numpy()[hit] * y["w"].values.to_numpy()[at[hit]]).sum())
                else:
                    dot = both / (len(u) * len(v)) ** 0.5
                if dot >= least - 1e-9:
                    for col, value in zip((a, c, dots, sims), (i, j, dot, sim), strict=True):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(dots, pa.float64()), pa.array(sims, pa.float64())], ["a", "b", "cosine", "overlap"])

    return run


def _sorted_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, side, n, terms, w) of vectors whose terms (term, w) come in any order: sorted by term as unsigned number."""
    for b in batches:
        terms, weights = [], []
        for t in b["t"]:
            x, w = t.values.field("term").to_numpy().view(np.uint64), t.values.field("w").to_numpy()
            o = np.argsort(x, kind="stable")
            terms.append(x[o].view(np.int64))
            weights.append(w[o])
        yield pa.RecordBatch.from_arrays([b["id"], b["side"], b["n"], pa.array(terms, pa.list_(pa.int64())), pa.array(weights, pa.list_(pa.float64()))], ["id", "side", "n", "terms", "w"])


def split_links(records: DataFrame, overlap: float = 0.8, size: int = 5, cosine: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Of `records` (id, side boolean, text): (members, links), both cuts. members: (id, side, rep); links: (a, b, cosine,
    overlap), a naming a class of equal vectors with side = true, b one with side = false. All pairs of that overlap; or, if
    `cosine` is given, all whose vectors weighted by rarity have that cosine, whatever their overlap."""
    looks.ensure(records.sparkSession)
    rare = cosine is not None
    least = cosine if rare else cosine_for_overlap(overlap)
    records = records.select("id", "side", "text").filter("id is not null")
    vectors = cut(records.mapInArrow(_vector_batches(size), _VECTOR), "vectors")
    key = ["side", "f1", "f2", "n"]
    members = cut(vectors.select("id", *key).join(vectors.groupBy(*key).agg(F.min("id").alias("rep")), key).select("id", "side", "rep").distinct(), "members")
    reps = cut(vectors.groupBy(*key).agg(F.min(F.struct("id", "terms")).alias("r")).select("side", "n", "r.*", F.lit(None).cast("array<double>").alias("w")), "classes")
    entries = reps.select("id", "side", "n", F.explode("terms").alias("term"), (1 / F.sqrt("n")).alias("w"))
    if rare:
        every = reps.agg(F.count("*").alias("all"))
        df = entries.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(every)).select("term", F.log1p(F.col("all") / F.col("df")).alias("idf"))  # one row
        weighed = entries.drop("w").join(df, "term").groupBy("id", "side", "n").agg(F.collect_list(F.struct("term", "idf")).alias("t"), F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
        reps = weighed.select("id", "side", "n", F.transform("t", lambda x: F.struct(x["term"].alias("term"), (x["idf"] / F.col("norm")).alias("w"))).alias("t"))
        reps = cut(reps.mapInArrow(_sorted_batches, "id bigint, side boolean, n int, terms array<bigint>, w array<double>"), "weighed-classes")
        entries = reps.select("id", "side", "n", F.explode(F.arrays_zip("terms", "w")).alias("t")).select("id", "side", "n", F.col("t.terms").alias("term"), "t.w")
    of = lambda s, c: F.when(F.col("side") == s, c)
    terms = entries.groupBy("term").agg(F.max(of(True, F.col("w"))).alias("m1"), F.max(of(False, F.col("w"))).alias("m0"), F.count(of(True, F.lit(1))).alias("n1"), F.count(of(False, F.lit(1))).alias("n0")).filter("m1 is not null and m0 is not null")
    # terms of one side only add nothing to any dot product
    pieces = [F.ceil(F.col(f"n{k}") / PIECE).cast("int").alias(f"p{k}") for k in (1, 0)]
    shared = entries.join(terms, "term").select("id", "side", "n", F.struct((F.col("n1") + F.col("n0")).alias("df"), "term", "w", F.when(F.col("side"), F.col("m0")).otherwise(F.col("m1")).alias("other"), *pieces).alias("t"))
    lists = shared.groupBy("id", "side", "n").agg(F.sort_array(F.collect_list("t")).alias("terms")).mapInArrow(_prefix_batches(least), _LIST)
    lists = cut(lists, "inverted-lists")

    def side(s: bool, own: str, other: str, names: str) -> DataFrame:
        """A side's entries: in one piece of its own, for every piece of the other side."""
        e = lists.filter(F.col("side") == s).withColumn(own, F.pmod(F.xxhash64("id"), F.col(own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return e.select("term", "p1", "p0", *[F.col(c).alias(c + names) for c in ("id", "n", "w", "after")])

    met = side(True, "p1", "p0", "a").join(side(False, "p0", "p1", "b"), ["term", "p1", "p0"])
    if not rare:
        met = met.filter(F.least("na", "nb") >= F.lit(overlap - 1e-9) * F.greatest("na", "nb"))
    partial = met.groupBy(F.col("ida").alias("a"), F.col("idb").alias("b")).agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"), F.min(F.col("aftera") * F.col("afterb")).alias("rest"))  # least behind the last term met
    found = partial.filter(F.col("dot") + F.col("rest") >= F.lit(least - 1e-6)).select("a", "b")
    vector = F.struct("terms", "w")
    one = reps.filter("side").select(F.col("id").alias("a"), vector.alias("x"))
    two = reps.filter("not side").select(F.col("id").alias("b"), vector.alias("y"))
    exact = found.join(one, "a").join(two, "b").mapInArrow(_exact_batches(least, 0.0 if rare else overlap), "a bigint, b bigint, cosine double, overlap double")
    return members, cut(exact, "split-links")


def overlapping_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_true, id_false, overlap) of all records of linked classes."""
    one = members.filter("side").select(F.col("rep").alias("a"), F.col("id").alias("id_true"))
    two = members.filter("not side").select(F.col("rep").alias("b"), F.col("id").alias("id_false"))
    return links.join(one, "a").join(two, "b").select("id_true", "id_false", "overlap")


def overlapping_records(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, n_links): each record with an overlap and the number of classes of the other side it is linked to."""
    one = links.groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("n_links")).withColumn("side", F.lit(True))
    two = links.groupBy(F.col("b").alias("rep")).agg(F.count("*").alias("n_links")).withColumn("side", F.lit(False))
    return members.join(one.unionByName(two), ["rep", "side"]).select("id", "n_links")
