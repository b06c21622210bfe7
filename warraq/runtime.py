"""Session helpers: session construction, lineage cuts in the shared folder, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes (as JSON text) up to which `bounded_broadcast` hints a broadcast; beyond either the join falls back to a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20

_own_dir: str | None = None
_cuts: list[str] = []


def session(app: str = "warraq", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow; `conf` overrides."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return b.config(map=base | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: spark.checkpoint.dir of the session; only where that is unset and all runs on this machine, a folder of our own."""
    global _own_dir
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if d:
        return d
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: lineage is cut there")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="warraq-")
        atexit.register(shutil.rmtree, _own_dir, True)
    return "file://" + _own_dir


def forget_cuts() -> None:
    """Delete the cuts written so far, wherever they lie. Results that still read them can't be computed again."""
    spark = SparkSession.getActiveSession()
    while _cuts:
        path = _cuts.pop()
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        elif spark is not None:
            try:
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
            except Exception:  # noqa: BLE001  the session may end first; what is left is in its checkpoint folder
                return


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: the lineage ends there, and any executor may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _cuts:
        atexit.register(forget_cuts)
    _cuts.append(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether `df` (cheap to evaluate, e.g. a cut) holds at most `rows` rows and, written as text, `size` bytes."""
    n = df.limit(rows + 1).select(F.octet_length(F.to_json(F.struct(*df.columns))).alias("b")).agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).collect()[0]
    return n["n"] <= rows and n["b"] <= size


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if `df` is small; else leave the join to shuffle."""
    return F.broadcast(df) if is_small(df, rows, size) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
