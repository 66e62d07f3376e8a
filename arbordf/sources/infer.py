"""Schemas of files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, DecimalType, DoubleType, FloatType, IntegerType, LongType

from ..errors import AnalysisError

SCHEMA = "COLUMN_NAME STRING, ORDINAL_POSITION INT, IS_NULLABLE BOOLEAN, DATA_TYPE STRING, NUMERIC_PRECISION INT, NUMERIC_PRECISION_RADIX INT, NUMERIC_SCALE INT"

#: SQL names of types.
SQL_NAMES = {"string": "VARCHAR(*)", "int": "INTEGER", "tinyint": "TINYINT", "smallint": "SMALLINT", "bigint": "BIGINT", "float": "FLOAT", "double": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def sql_type(t: DataType) -> str:
    """The SQL name of a type; types without one raise."""
    if isinstance(t, DecimalType):
        return f"DECIMAL({t.precision},{t.scale})"
    name = t.simpleString()
    if name not in SQL_NAMES:
        raise AnalysisError(f"type {name} has no SQL name")
    return SQL_NAMES[name]


def numeric(t: DataType) -> tuple[int | None, int | None, int | None]:
    """(precision, radix, scale); null for types that have none."""
    if isinstance(t, DecimalType):
        return t.precision, 10, t.scale
    bits = {IntegerType: 32, LongType: 64, DoubleType: 53, FloatType: 24}.get(type(t))
    return bits, 2 if bits else None, 0 if isinstance(t, (IntegerType, LongType)) else None


def infer_schema(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """One row per column of a Parquet or ORC file; ``kind`` overrides the file's suffix."""
    kind = (kind or next((s for s in ("parquet", "orc") if path.rstrip("/").endswith("." + s)), "")).lower()
    if kind not in ("parquet", "orc"):
        raise AnalysisError(f"can't tell the file type of {path}")
    fields = spark.read.format(kind).load(path).schema.fields
    return spark.createDataFrame([(f.name, i + 1, f.nullable, _name(f.dataType), *numeric(f.dataType)) for i, f in enumerate(fields)], SCHEMA)


def _name(t: DataType) -> str:
    return SQL_NAMES.get(t.simpleString()) or (sql_type(t) if isinstance(t, DecimalType) else t.simpleString().upper())



