"""SQL functions of the session: their bodies are inlined into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "vec_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "vec_norm(a ARRAY<DOUBLE>) RETURNS DOUBLE": "sqrt(aggregate(transform(a, x -> x * x), 0D, (s, x) -> s + x))",
    "vec_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "coalesce(try_divide(vec_dot(a, b), vec_norm(a) * vec_norm(b)), 0D)",
    "vec_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))",
    "clean_whitespace(t STRING) RETURNS STRING": r"regexp_replace(regexp_replace(t, '^\\s+|\\s+$', ''), '\\s+', ' ')",
    "strip_tags(t STRING) RETURNS STRING": "regexp_replace(t, '<[^>]*>', '')",
    "chunk_windows(t STRING, size INT, step INT) RETURNS ARRAY<STRING>": "CASE WHEN length(t) > 0 THEN transform(sequence(0, length(t) - 1, step), i -> substring(t, i + 1, size)) ELSE CAST(array() AS ARRAY<STRING>) END",
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session and returns their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
