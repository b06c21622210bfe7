"""Feedback as pure functions: joins, corrections, job states, merges of training sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warraq.functions import text as t

TASKS = ["propaganda", "statement", "attribution"]


def export(feedback: DataFrame, articles: DataFrame) -> DataFrame:
    """Approved feedback with its article, corrections applied: the training record."""
    a = articles.select(F.col("id").alias("article_id"), "title", "content", "content_clean", "source_name", "verified", "reliability_score", "published_at")
    f = feedback.filter("status = 'approved'")
    label = {x: t.corrected(F.col(f"{x}_correct"), F.col(f"corrected_{x}"), F.col(f"{x}_prediction")) for x in TASKS}
    return f.join(a, "article_id").select(
        F.col("id").alias("feedback_id"), t.truthy(F.col("content_clean"), F.col("content"), F.col("title")).alias("text"), "title", F.col("source_name").alias("source"),
        label["propaganda"].alias("propaganda_label"), label["statement"].alias("statement_type"), label["attribution"].alias("attribution_label"), "verified", "reliability_score", F.date_format("published_at", "yyyy-MM-dd").alias("date"),
    )


def merged(base: DataFrame, feedback: DataFrame, seq: str) -> DataFrame:
    """Union by (title, text) without outer white space; feedback wins, then the later row; `position` is the first place seen."""
    key = lambda d, f: d.withColumns({"_key": F.sha2(F.concat_ws("\n", t.strip(F.coalesce("title", F.lit(""))), t.strip(F.coalesce("text", F.lit("")))), 256), "_f": F.lit(f)})
    u = key(base, 0).unionByName(key(feedback, 1), allowMissingColumns=True)
    g = u.groupBy("_key").agg(F.max(F.struct("_f", seq)).alias("_w"), F.min(F.struct("_f", seq)).alias("position"))
    return u.join(g, "_key").filter(F.struct("_f", seq) == F.col("_w")).drop("_key", "_w", "_f")


def union_new(base: DataFrame, extra: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(base and the rows of `extra` not in it, once each; counts added, skipped)."""
    new = extra.select(*cols).distinct().join(base.select(*cols).distinct(), cols, "left_anti")
    counts = extra.agg(F.count("*").alias("all")).join(F.broadcast(new.agg(F.count("*").alias("added")))).select("added", (F.col("all") - F.col("added")).alias("skipped"))
    return base.select(*cols).unionByName(new), counts


def with_status(feedback: DataFrame, ids: Column, status: str, notes: str | None = None) -> DataFrame:
    """The table with some rows' status (and notes) replaced."""
    return feedback.withColumns({"status": F.when(ids, F.lit(status)).otherwise(F.col("status")), "admin_notes": F.when(ids & F.lit(notes is not None), F.lit(notes)).otherwise(F.col("admin_notes"))})


def stamp_job(feedback: DataFrame, job_id: int, threshold: int = 1, most: int | None = None) -> DataFrame:
    """Approved feedback without a job gets this one, if there are `threshold` rows or more; with `most`, only that of so many ids, the least ones."""
    free = (F.col("status") == "approved") & F.col("training_job_id").isNull()
    if most is not None:
        first = feedback.filter(free).select("id").distinct().orderBy("id").limit(most).withColumn("_first", F.lit(True))
        feedback = feedback.join(first, "id", "left")
        free = free & F.coalesce("_first", F.lit(False))
    n = feedback.agg(F.count(F.when(free, 1)).alias("_n"))
    return feedback.join(F.broadcast(n)).withColumn("training_job_id", F.when(free & (F.col("_n") >= threshold), F.lit(job_id)).otherwise(F.col("training_job_id"))).drop("_n", "_first")


def unstamp_job(feedback: DataFrame, job_id: int) -> DataFrame:
    return feedback.withColumn("training_job_id", F.when(F.col("training_job_id") != job_id, F.col("training_job_id")))


def finish_job(jobs: DataFrame, job_id: int, f1: float | None, error: str | None = None) -> DataFrame:
    """RUNNING -> COMPLETED or FAILED; the model is promoted when its F1 reaches the active one's."""
    mine = F.col("id") == job_id
    active = jobs.filter("is_active").agg(F.max("propaganda_f1").alias("_a"))
    ok = error is None
    better = F.lit(ok) & (F.lit(f1 or 0.0) >= F.coalesce("_a", F.lit(0.0)))
    j = jobs.join(F.broadcast(active))
    return j.withColumns({"status": F.when(mine, "COMPLETED" if ok else "FAILED").otherwise(F.col("status")), "propaganda_f1": F.when(mine, F.lit(f1)).otherwise(F.col("propaganda_f1")), "error_message": F.when(mine, F.lit(error)).otherwise(F.col("error_message")), "is_active": F.when(mine, better).otherwise(F.col("is_active") & ~better)}).drop("_a")


def running_job(jobs: DataFrame) -> int | None:
    """The id of the job that runs or waits; an error if there is more than one."""
    rows = jobs.filter(F.col("status").isin("RUNNING", "PENDING")).select("id").limit(2).collect()
    if len(rows) > 1:
        raise ValueError("more than one job runs")
    return rows[0]["id"] if rows else None


def purged_models(jobs: DataFrame, keep: int = 5) -> DataFrame:
    """Completed models beyond the newest `keep` that are not active. A job table is small by nature."""
    d = jobs.filter("model_path is not null and lower(status) = 'completed'")
    return d.withColumn("place", F.expr("row_number() over (order by finished_at desc nulls last, id desc)")).filter((F.col("place") > keep) & ~F.coalesce("is_active", F.lit(False)))


def inserted(feedback: DataFrame, articles: DataFrame, given: DataFrame) -> DataFrame:
    """The table with new rows: `given` (id, article_id, the judgements and corrections, notes, created_at) with the article's labels of now; unknown articles give none."""
    a = articles.select(F.col("id").alias("article_id"), F.col("propaganda_label").alias("propaganda_prediction"), F.col("statement_type").alias("statement_prediction"), F.col("attribution_label").alias("attribution_prediction"))
    new = given.join(a, "article_id").withColumns({"status": F.lit("pending"), "training_job_id": F.lit(None).cast("bigint"), "admin_notes": F.lit(None).cast("string")})
    return feedback.unionByName(new.select(*[c for c in feedback.columns if c in new.columns]), allowMissingColumns=True)
