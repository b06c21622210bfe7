"""Ingest as Structured Streaming: late rows, duplicates across polls, idempotent sinks, stories per batch."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from warraq.functions import text as t
from warraq.operators import dedup


def fresh(df: DataFrame, as_of: Column, hours: int = 48, event: str = "published_at") -> DataFrame:
    """Rows not older than `hours` before `as_of`; rows without a time stay."""
    return df.filter(F.col(event).isNull() | (F.col(event) >= as_of - F.expr(f"INTERVAL {hours} HOURS")))


def deduplicated(stream: DataFrame, text: Column, hours: int = 48, event: str = "published_at") -> DataFrame:
    """Exact duplicates by fingerprint within the watermark: state is dropped `hours` after the newest event.

    Rows without an event time take the time of arrival, which the watermark would otherwise ignore.
    """
    d = stream.withColumn("_t", F.coalesce(event, F.current_timestamp()) if event in stream.columns else F.current_timestamp()).withColumn("_fp", t.fingerprint(text))
    return d.withWatermark("_t", f"{hours} hours").dropDuplicatesWithinWatermark(["_fp"]).drop("_fp", "_t")


def near_deduplicated_sink(path: str, id_col: str, text: str, least: float = 0.82, known: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends the rows of a poll that neither copy nor nearly copy each other or a row of the store.

    The store is the state: it starts with `known` (same columns; the warm-up), lives as long as the table does and survives a
    restart; a batch that is written again finds its own ids in the store and appends nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = spark.read.schema(batch.schema).parquet(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None
        if store is not None:
            batch = batch.join(store.select(id_col), id_col, "left_anti").select(*batch.columns)
        before = [d for d in (store, known) if d is not None]
        seen = reduce(DataFrame.unionByName, before) if before else None
        dup = dedup.deduplicated(batch, id_col, F.col(text), least, known=seen)
        batch.join(dup.filter("not is_duplicate").select(F.col("id").alias(id_col)), id_col, "left_semi").select(*batch.columns).write.mode("append").parquet(path)

    return write


def stories_sink(path: str, seq: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that groups each poll's articles into stories; a batch that comes again replaces its part of the table."""

    def write(batch: DataFrame, number: int) -> None:
        from warraq.plans import pipeline

        d = pipeline.stories(batch.withColumn("_poll", F.lit(str(number))), "_poll", seq)
        d.select(seq, "cluster").write.mode("overwrite").parquet(f"{path}/poll={number}")

    return write


def windowed_counts(stream: DataFrame, event: str, key: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows per tumbling window and key; rows later than `late` are dropped by the watermark."""
    return stream.withWatermark(event, late).groupBy(F.window(event, size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(df: DataFrame, event: str, key: str, gap: str = "30 minutes") -> DataFrame:
    return df.groupBy(F.session_window(event, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), key, "n")


def idempotent_sink(path: str, key: str = "url") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends only rows whose key the table lacks, once per key."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
        new.select(*batch.columns).write.mode("append").parquet(path)

    return write


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start the ingest: a poll `every` so often, or (None) what is there now and then end."""
    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
