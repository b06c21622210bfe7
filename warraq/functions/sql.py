"""The scalar functions for SQL users, as temporary SQL functions (no Python in the query)."""

from __future__ import annotations

from pyspark.sql import SparkSession

# name -> (parameters, type, body)
FUNCTIONS = {
    "text_strip": ("x STRING", "STRING", r"regexp_replace(x, r'(?U)[\s\x1c-\x1f]+\z|\A(?U)[\s\x1c-\x1f]+', '')"),
    "text_fingerprint": ("x STRING", "STRING", r"md5(lower(trim(regexp_replace(x, r'(?U)[\s\x1c-\x1f]+', ' '))))"),
    "text_truthy": ("a STRING, b STRING", "STRING", "coalesce(nullif(a, ''), b)"),
    "set_overlap": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN size(array_union(a, b)) = 0 THEN 1D ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END"),
    "cosine_of": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v) / sqrt(aggregate(a, 0D, (s, v) -> s + v * v) * aggregate(b, 0D, (s, v) -> s + v * v))"),
}


def register(spark: SparkSession) -> list[str]:
    for name, (params, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
