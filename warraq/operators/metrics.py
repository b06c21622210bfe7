"""Classification metrics in long form; everything is one or two aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warraq.operators.prefix import running_sum
from warraq.runtime import cut


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def binary(df: DataFrame, gold: Column, pred: Column) -> DataFrame:
    """One row: tn, fp, fn, tp, accuracy, f1 (0 without positives) of two booleans; rows with a null are left out."""
    n = lambda c: F.count(F.when(c, 1))
    d = df.select(gold.alias("g"), pred.alias("p")).dropna().agg(n(~F.col("g") & ~F.col("p")).alias("tn"), n(~F.col("g") & F.col("p")).alias("fp"), n(F.col("g") & ~F.col("p")).alias("fn"), n(F.col("g") & F.col("p")).alias("tp"))
    return d.withColumns({"accuracy": _ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), "f1": _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def relaxed(gold: Column, pred: Column) -> Column:
    """The prediction where it is among several gold labels, else the gold."""
    return F.when(F.array_contains(F.split(gold, r" \| "), pred), pred).otherwise(gold)


def per_class(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """(label, support, predicted, tp, precision, recall, f1) over the union of labels."""
    g = df.groupBy(F.col(gold).alias("label")).agg(F.count("*").alias("support"), F.count(F.when(F.col(gold) == F.col(pred), 1)).alias("tp"))
    p = df.groupBy(F.col(pred).alias("label")).agg(F.count("*").alias("predicted"))
    j = g.join(p, "label", "full").na.fill(0, ["support", "predicted", "tp"])
    j = j.withColumns({"precision": _ratio(F.col("tp"), F.col("predicted")), "recall": _ratio(F.col("tp"), F.col("support"))})
    return j.withColumn("f1", _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")))


def averages(classes: DataFrame) -> DataFrame:
    """accuracy (= micro F1), macro and weighted averages of a per-class table."""
    w = lambda c: _ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    return classes.agg(_ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), w("precision").alias("weighted_precision"), w("recall").alias("weighted_recall"), w("f1").alias("weighted_f1"))


def unparsed_wrong(gold: Column, pred: Column) -> Column:
    """A prediction that could not be read counts as the other class (0/1)."""
    return F.coalesce(pred, 1 - gold)


def best_threshold(df: DataFrame, gold: Column, score: Column) -> DataFrame:
    """(threshold, correct, total): the least score s of those for which `score > s` is right most often.

    Rows are first counted per distinct score; exact running counts over the scores, spread over range partitions, replace a
    scan per threshold.
    """
    per = df.select(gold.alias("g"), score.alias("s")).dropna().groupBy("s").agg(F.count(F.when(F.col("g"), 1)).alias("pos"), F.count("*").alias("n"))
    per = cut(per.withColumn("k", F.lit(0)), "scores")
    # right answers up to a threshold less wrong ones: each row that falls below it turns from one to the other
    run = running_sum(per, "k", F.lit(""), [F.col("s")], value=F.col("n") - 2 * F.col("pos"), keep=["s"])
    all_ = per.agg(F.sum("pos").alias("p"), F.sum("n").alias("total"))
    right = run.join(F.broadcast(all_)).select("s", (F.col("p") + F.col("before") + F.col("value")).alias("correct"), "total")
    best = right.agg(F.min_by(F.struct("s", "correct", "total"), F.struct((-F.col("correct")).alias("c"), F.col("s"))).alias("b"))
    return best.select(F.col("b.s").alias("threshold"), "b.correct", "b.total")


def exact_and_primary(df: DataFrame, gold: Column, pred: Column) -> DataFrame:
    """One row: rows, and the shares whose label is the gold one, and whose first label is the gold one's first."""
    first = lambda c: F.trim(F.element_at(F.split(c, r"\|"), 1))
    d = df.select(gold.alias("g"), pred.alias("p")).filter("g is not null")
    share = lambda c: _ratio(F.count(F.when(c, 1)), F.count("*"))
    return d.agg(F.count("*").alias("rows"), share(F.col("g") == F.col("p")).alias("exact"), share(first(F.col("g")) == first(F.col("p"))).alias("primary"))


def parse_failures(df: DataFrame, pred: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rows, those whose prediction could not be read, and their share; per group of `by`."""
    d = df.groupBy(*by).agg(F.count("*").alias("rows"), F.count(F.when(pred.isNull(), 1)).alias("failed"))
    return d.withColumn("failure_rate", _ratio(F.col("failed"), F.col("rows")))


def compliance(df: DataFrame, matched: Column) -> DataFrame:
    """One row: outputs, those in the wanted form, and their share; a null flag is not in the form."""
    d = df.agg(F.count("*").alias("outputs"), F.count(F.when(matched, 1)).alias("compliant"))
    return d.withColumn("compliance", _ratio(F.col("compliant"), F.col("outputs")))


def calibrated(df: DataFrame, gold: Column, score: Column, threshold: float | Column) -> DataFrame:
    """`binary` of `score > threshold`."""
    return binary(df, gold, score > threshold)


def mean_accuracy(df: DataFrame, tasks: Sequence[tuple[Column, Column]]) -> DataFrame:
    """One row: the accuracy of each task (gold, prediction) over its rows with a gold label, and their mean."""
    acc = [_ratio(F.count(F.when(g == p, 1)), F.count(g)).alias(f"accuracy_{i}") for i, (g, p) in enumerate(tasks)]
    d = df.agg(*acc)
    return d.withColumn("mean_accuracy", sum((F.col(f"accuracy_{i}") for i in range(len(tasks))), F.lit(0.0)) / len(tasks))


def class_means(df: DataFrame, label: str, value: Column) -> DataFrame:
    """(label, n, mean): rows of each class and the mean of `value` over them; nulls do not count in the mean."""
    return df.groupBy(label).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def length_stats(df: DataFrame, id_col: str, length: Column, budget: int, rows: int = 200) -> DataFrame:
    """Of the first `rows` rows by id: how many, greatest and mean length, and how many exceed the budget."""
    d = df.select(F.col(id_col).alias("id"), length.alias("n")).orderBy("id").limit(rows)
    return d.agg(F.count("*").alias("rows"), F.max("n").alias("longest"), F.avg("n").alias("mean"), F.count(F.when(F.col("n") > budget, 1)).alias("over"))
