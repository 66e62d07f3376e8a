"""Scalar functions by the names and meanings that queries expect, over Spark's built-ins."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Temporary SQL functions: name -> (parameters, return type, body).
SQL_FUNCTIONS = {
    "remainder": ("a DOUBLE, b DOUBLE", "DOUBLE", "a % b"),
    "add_years": ("d DATE, n INT", "DATE", "add_months(d, n * 12)"),
    "add_seconds": ("ts TIMESTAMP, n INT", "TIMESTAMP", "timestampadd(SECOND, n, ts)"),
    "add_days": ("d DATE, n INT", "DATE", "date_add(d, n)"),
    "days_between": ("a DATE, b DATE", "INT", "abs(datediff(a, b))"),
    "to_double": ("e STRING", "DOUBLE", "try_cast(e AS DOUBLE)"),
    "to_integer": ("e STRING", "INT", "try_cast(try_cast(e AS DOUBLE) AS INT)"),
}


def register(spark: SparkSession) -> None:
    for name, (params, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")


def rewritten_call(name: str, args: list[str]) -> str | None:
    """SQL for calls of built-in names whose meaning differs here and that no SQL function can shadow;
    None for all others. ``args`` are SQL texts."""
    name = name.lower()
    if name == "replace" and len(args) == 3:
        return f"replace({args[0]}, {args[1]}, coalesce({args[2]}, ''))"
    if name == "to_varchar" and len(args) == 1:
        return f"CAST({args[0]} AS STRING)"
    if name in ("remainder", "mod") and len(args) == 2:
        return f"(({args[0]}) % ({args[1]}))"
    return None


#: EXTRACT gives integers for every field.
EXTRACT = {"day": "day", "month": "month", "year": "year", "hour": "hour", "minute": "minute", "second": "second"}
