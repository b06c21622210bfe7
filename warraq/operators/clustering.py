"""Incremental story clustering: within a batch each row joins the best earlier cluster or opens a new one.

The fold is sequential by definition, so a batch (a query's rows or a poll's intake, some thousands at most) is one group;
batches run in parallel. A batch must not be cut in pieces to save time, as a story may span all its sources. A row is compared only with earlier rows it has no place or title conflict with; a cluster's centroid is that of
those rows alone; the threshold falls as shared entities and title stems raise the confidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.functions import text as t

# Least confidence and the cosine it needs; weights of shared entities and title stems.
THRESHOLDS = [(0.6, 0.78), (0.3, 0.81), (-1.0, 0.84)]
ENTITY, STEMS = 0.35, 0.5


def threshold(confidence: float) -> float:
    return next(s for c, s in THRESHOLDS if confidence >= c)


def _meet(a: set[str], b: set[str]) -> bool:
    if not a or not b:
        return False
    if a & b:
        return True
    bare = lambda s: {x.replace("ال", "").strip() for x in s}
    return any(len(x) > 3 and len(y) > 3 and (x in y or y in x) for x in bare(a) for y in bare(b))


def _conflict(a: set[str], b: set[str]) -> bool:
    return bool(a - b) and bool(b - a)


def assign(rows: pd.DataFrame) -> list[int]:
    """Cluster numbers (from 0, in order of opening) of rows in order. Columns: vector, domains, words, stems, persons, organizations, locations."""
    vectors = [np.asarray(v, dtype=float) for v in rows["vector"]]
    vectors = [v / (np.linalg.norm(v) or 1.0) for v in vectors]
    sets = {c: [set(x) if x is not None else set() for x in rows[c]] for c in ("domains", "words", "stems", "persons", "organizations", "locations")}
    out: list[int] = []
    clusters: list[list[int]] = []
    for i in range(len(rows)):
        best, best_sim, best_conf = -1, -2.0, 0.0
        for k, members in enumerate(clusters):
            fit, conf = [], 0.0
            for j in members:
                a, b = sets["words"][i], sets["words"][j]
                if _conflict(sets["domains"][i], sets["domains"][j]) or a and b and not a & b and not sets["stems"][i] & sets["stems"][j]:
                    continue
                fit.append(j)
                shared = sum(_meet(sets[c][i], sets[c][j]) for c in ("persons", "locations", "organizations"))
                conf = max(conf, ENTITY * shared + STEMS * min(1.0, len(sets["stems"][i] & sets["stems"][j]) / 3))
            if not fit:
                continue
            centre = np.mean([vectors[j] for j in fit], axis=0)
            sim = float(vectors[i] @ (centre / (np.linalg.norm(centre) or 1.0)))
            if sim > best_sim:
                best, best_sim, best_conf = k, sim, conf
        if best >= 0 and best_sim >= threshold(best_conf):
            clusters[best].append(i)
            out.append(best)
        else:
            clusters.append([i])
            out.append(len(clusters) - 1)
    return out


def candidates(new: DataFrame, active: DataFrame, block: str) -> DataFrame:
    """(<block>, id, other, confidence): each row of `new` with the rows of `active` of its block that no place or title conflict
    keeps apart. Columns as for `assign`, and id.

    Titles without a word or stem in common are in conflict, unless one has no words, so the rows meet on words and stems of
    their block; rows without title words, few, meet the whole block.
    """
    both = F.array_union("words", F.transform("words", lambda w: t.light_stem(w)))
    key = lambda d, i: d.select(block, F.col("id").alias(i), F.explode(both).alias("_k"))
    bare = lambda d, i: d.filter(F.size("words") == 0).select(block, F.col("id").alias(i))
    every = lambda d, i: d.select(block, F.col("id").alias(i))
    met = key(new, "id").join(key(active, "other"), [block, "_k"]).select(block, "id", "other")
    for a, b in ((bare(new, "id"), every(active, "other")), (every(new, "id"), bare(active, "other"))):
        met = met.unionByName(a.join(b, block).select(block, "id", "other"))
    cols = ["domains", "words", "stems", "persons", "organizations", "locations"]
    x = new.select(F.col("id"), F.struct(*cols).alias("a"))
    y = active.select(F.col("id").alias("other"), F.struct(*cols).alias("b"))
    j = met.filter("id <> other").distinct().join(x, "id").join(y, "other").filter(~t.geo_conflict(F.col("a.domains"), F.col("b.domains")) & ~t.title_conflict(F.col("a.words"), F.col("b.words")))
    shared = sum((t.share_entities(F.col(f"a.{c}"), F.col(f"b.{c}")).cast("int") for c in ("persons", "organizations", "locations")), F.lit(0))
    stems = F.size(F.array_intersect("a.stems", "b.stems"))
    return j.select(block, "id", "other", (ENTITY * shared + STEMS * F.least(F.lit(1.0), stems / 3)).alias("confidence"))


_COLUMNS = ["vector", "domains", "words", "stems", "persons", "organizations", "locations"]


def _fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, seqs, found = [], [], []
        for k, rows in zip(b["batch"].to_pylist(), b["rows"].to_pylist(), strict=True):
            keys += [k] * len(rows)
            seqs += [r["seq"] for r in rows]
            found += assign(pd.DataFrame(rows, columns=["seq", *_COLUMNS]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(seqs, pa.int64()), pa.array(found, pa.int32())], ["batch", "seq", "cluster"])


def incremental(df: DataFrame, batch: str, seq: str) -> DataFrame:
    """(batch, seq, cluster) of rows with the columns of `assign`. A batch's rows come as one sorted array; many batches share an Arrow batch."""
    row = F.struct(F.col(seq).cast("bigint").alias("seq"), *[F.col(c) for c in _COLUMNS])
    g = df.groupBy(F.col(batch).cast("string").alias("batch")).agg(F.collect_list(row).alias("rows"))
    g = g.select("batch", F.array_sort("rows", lambda x, y: (x["seq"] > y["seq"]).cast("int") - (x["seq"] < y["seq"]).cast("int")).alias("rows"))
    return g.mapInArrow(_fold_batches, "batch string, seq bigint, cluster int").select(F.col("batch").alias(batch), F.col("seq").alias(seq), "cluster")
