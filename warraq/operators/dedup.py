"""De-duplication: by url, by fingerprint, and greedily by shingle overlap in arrival order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warraq.functions import text as t
from warraq.runtime import cut


def keep_first(df: DataFrame, key: Column, seq: str) -> DataFrame:
    """The row of least `seq` per key. An aggregate, so copies combine before the shuffle and no key fills a task."""
    first = df.groupBy(key.alias("_k")).agg(F.min(seq).alias(seq))
    return df.join(first.select(seq), seq, "left_semi")


def keep_last(df: DataFrame, key: Column, seq: str) -> DataFrame:
    """Per key the row of greatest `seq`, with `position` = the least one."""
    g = df.groupBy(key.alias("_k")).agg(F.max(seq).alias(seq), F.min(seq).alias("position"))
    return df.join(g.select(seq, "position"), seq)


def new_urls(df: DataFrame, known: DataFrame, seq: str = "id") -> DataFrame:
    """One row per url, the last delivered, not in the store."""
    return keep_last(df.filter("url is not null"), F.col("url"), seq).drop("position").join(known.select("url").distinct(), "url", "left_anti")


def shingle_rows(df: DataFrame, id_col: str, text: Column, size: int = 3) -> DataFrame:
    """(id, n, shingle): a row per distinct shingle (as a 64-bit hash) of each text that is not blank."""
    d = df.select(F.col(id_col).alias("id"), F.transform(t.shingles(F.lower(text), size), lambda s: F.xxhash64(s)).alias("s"), t.strip(text).alias("x")).filter("x <> ''")
    return d.select("id", F.size("s").alias("n"), F.explode("s").alias("shingle"))


def set_links(rows: DataFrame, least: float = 0.82, asked: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, links), cuts: (id, rep), rep being the least id with the same set; (a, b, overlap), a < b, of all reps with that
    Jaccard overlap, by an exact prefix filter. Copies, however many, are one rep and are never paired.

    Two sets of overlap t share one of their n - ceil(t n) + 1 rarest members, so only those are joined. `rows` should be a
    cut. With `asked`, a condition on id, only links of which a rep fulfils it.
    """
    sets = rows.groupBy("id", "n").agg(F.sort_array(F.collect_list("shingle")).alias("s"))
    sets = cut(sets.withColumn("f", F.md5(F.array_join("s", ","))), "sets")
    asked = F.lit(True) if asked is None else asked
    classes = sets.groupBy("f").agg(F.min("id").alias("rep"))
    members = cut(sets.join(classes, "f").select("id", "rep"), "members")
    reps = sets.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    df = rows.join(reps.select("id"), "id", "left_semi").groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = reps.select("id", "n", F.explode("s").alias("shingle")).join(df, "shingle", "left").select("id", "n", F.struct(F.coalesce("df", F.lit(1)).alias("df"), "shingle").alias("r"))
    prefix = ranked.groupBy("id", "n").agg(F.sort_array(F.collect_list("r")).alias("r")).select("id", "n", F.explode(F.slice("r", F.lit(1), F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1)).alias("r"))
    p = cut(prefix.filter("r.df > 1").select("id", "n", F.col("r.shingle").alias("k")), "prefix")
    few = p.filter(asked).select("id", "n", "k")
    a, b = p.toDF("a", "na", "k"), few.toDF("b", "nb", "k")
    met = a.join(b, "k").filter(F.expr(f"a <> b and least(na, nb) >= {least} * greatest(na, nb) - 1e-9")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    x, y = reps.select(F.col("id").alias("a"), F.col("s").alias("sa")), reps.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return members, cut(met.join(x, "a").join(y, "b").withColumn("overlap", both / (F.size("sa") + F.size("sb") - both)).filter(F.col("overlap") >= least).select("a", "b", "overlap"), "links")


def greedy(ids: DataFrame, pairs: DataFrame, before: Column | None = None) -> DataFrame:
    """(id, is_duplicate): in id order, a row is a duplicate if it overlaps an accepted earlier one.

    Rounds to a fixed point: a row without undecided or accepted earlier neighbours is accepted, one with an accepted
    earlier neighbour rejected. Only rows with a neighbour take part; each round is a cut. Rows with `before`, a condition on id, are accepted from the start.
    """
    edges = cut(pairs.select(F.col("a").alias("early"), F.col("b").alias("late")), "edges")
    state = cut(edges.select(F.explode(F.array("early", "late")).alias("id")).distinct().withColumn("state", F.when(F.lit(False) if before is None else before, True)), "state")
    while not state.filter("state is null").isEmpty():
        seen = edges.join(state.withColumnRenamed("id", "early"), "early").groupBy(F.col("late").alias("id")).agg(F.max(F.coalesce(F.col("state"), F.lit(False))).alias("hit"), F.max(F.col("state").isNull()).alias("open"))
        nxt = state.join(seen, "id", "left")
        state = cut(nxt.select("id", F.when(F.col("state").isNotNull(), F.col("state")).when(F.col("hit"), False).when(~F.coalesce("open", F.lit(False)), True).alias("state")), "state")
    return ids.join(state, "id", "left").select("id", (~F.coalesce("state", F.lit(True))).alias("is_duplicate"))


def deduplicated(df: DataFrame, id_col: str, text: Column, least: float = 0.82, known: DataFrame | None = None) -> DataFrame:
    """(id, is_duplicate, dup_kind) under the greedy rule; `known` (same columns) is accepted beforehand. Blank texts are never duplicates.

    Ids of both sides may meet: within, an id is (new, id), so the known come first; known rows are not compared with each other.
    """
    asked = before = None
    if known is not None:
        both = [d.select(F.struct(F.lit(new).alias("new"), F.col(id_col).alias("id")).alias("_id"), text.alias("_t")) for new, d in enumerate((known, df))]
        df, id_col, text = cut(both[0].unionByName(both[1]), "known-and-new"), "_id", F.col("_t")
        asked, before = F.col("id.new") == 1, F.col("id.new") == 0
    rows = cut(shingle_rows(df, id_col, text), "shingles")
    members, links = set_links(rows, least, asked)
    # of one set, the first row decides: if it is accepted the others are its duplicates, if not they overlap what it overlaps
    reps = greedy(members.select(F.col("rep").alias("id")).distinct(), links, before).select(F.col("id").alias("rep"), "is_duplicate")
    by_set = members.join(reps, "rep").select("id", ((F.col("id") != F.col("rep")) | F.col("is_duplicate")).alias("is_duplicate"))
    if before is not None:
        by_set = by_set.withColumn("is_duplicate", F.col("is_duplicate") & ~before)
    state = cut(df.select(F.col(id_col).alias("id")).join(by_set, "id", "left").select("id", F.coalesce("is_duplicate", F.lit(False)).alias("is_duplicate")), "decided")
    fp = df.select(F.col(id_col).alias("id"), t.fingerprint(text).alias("fp"))
    accepted = fp.join(state.filter("not is_duplicate"), "id").groupBy("fp").agg(F.min("id").alias("first"))
    out = state.join(fp, "id").join(accepted, "fp", "left").withColumn("dup_kind", F.when(F.col("is_duplicate"), F.when(F.col("first") < F.col("id"), "exact").otherwise("near")))
    out = out.select("id", "is_duplicate", "dup_kind")
    return out if known is None else out.filter(asked).select(F.col("id.id").alias("id"), "is_duplicate", "dup_kind")
