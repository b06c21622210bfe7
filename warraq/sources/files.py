"""Readers and writers of the file formats the pipeline meets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq import schemas


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: str = schemas.FEEDBACK_RECORD, missing_ok: bool = True) -> DataFrame:
    """Strict JSON lines; a missing path gives an empty table or an error. Dates stay strings."""
    if missing_ok and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """.jsonl or .json by extension; anything else is an error."""
    if path.endswith(".jsonl"):
        return spark.read.schema(schema).json(path)
    if path.endswith(".json"):
        return spark.read.schema(schema).option("multiLine", True).json(path)
    raise ValueError(f"not a JSON file: {path}")


def read_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, counts total/skipped/valid) of JSON lines of which some are broken."""
    raw = spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    lines = spark.read.text(path).filter(F.trim("value") != "")
    good = raw.filter("_corrupt_record is null").drop("_corrupt_record")
    parsed = lines.select(F.from_json("value", schema + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    return good, parsed.agg(F.count("*").alias("total"), F.count(F.when(bad, 1)).alias("skipped"), F.count(F.when(~bad, 1)).alias("valid"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, nulls kept, other scripts as they are."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_predictions(df: DataFrame, path: str) -> None:
    cols = ["paragraph", "gold_label", "predicted_label", "correct", "format_matched", "raw_generation"]
    df.select(*cols).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON: the rows of a small table as structs."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def detect_column(df: DataFrame, candidates: Sequence[str], role: str) -> str:
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"no column for {role}: none of {list(candidates)} in {df.columns}")


def read_split(spark: SparkSession, path: str, split: str, fallbacks: Sequence[str] = ("train", "dev", "validation", "test")) -> DataFrame:
    """One split of a data set kept as folders of Parquet; where it is missing, the first of the fallbacks that is there."""
    for s in (split, *fallbacks):
        if _exists(spark, f"{path}/{s}"):
            return spark.read.parquet(f"{path}/{s}")
    raise ValueError(f"no split of {path}")


def create_tables(spark: SparkSession, tables: dict[str, str], drop: bool = False) -> None:
    """Parquet tables (name -> schema); with `drop` they are made anew."""
    for name, schema in tables.items():
        if drop:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema.replace(' bigint', ' BIGINT')}) USING parquet")


def append(df: DataFrame, table: str) -> None:
    """One atomic write of a batch."""
    df.write.mode("append").insertInto(table)
