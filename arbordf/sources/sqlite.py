"""Tables in SQLite files, with queries pushed down to them.

Options: ``database``, one file or several by commas (shards of the same tables), in a folder that all executors
read. A scan or a pushed query runs in one task for each file; rows come back in batches.
"""

from __future__ import annotations

import sqlite3
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..errors import AnalysisError
from ..plans.pushdown import Source, marked
from ..plans.sqlgen import Select, quoted

#: Declared types that tables may have; others are read as text.
TYPES = {"INTEGER": LongType(), "INT": LongType(), "BIGINT": LongType(), "REAL": DoubleType(), "DOUBLE": DoubleType(), "TEXT": StringType()}


def opened(path: str) -> sqlite3.Connection:
    con = sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)
    con.execute("PRAGMA case_sensitive_like = ON")
    return con


class SqliteProvider:
    """See the module's text."""

    def files(self, options: dict[str, str]) -> list[str]:
        files = [f.strip() for f in options.get("database", "").split(",") if f.strip()]
        if not files:
            raise AnalysisError("a SQLite source needs the option database")
        return files

    def shards(self, options: dict[str, str]) -> int:
        return len(self.files(options))

    def supports(self, tree: Select) -> bool:
        return True

    def table_names(self, options: dict[str, str]) -> list[str]:
        with opened(self.files(options)[0]) as con:
            return [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]

    def table(self, spark: SparkSession, name: str, options: dict[str, str], schema: StructType | None = None) -> DataFrame:
        if schema is None:
            with opened(self.files(options)[0]) as con:
                cols = con.execute(f"PRAGMA table_info({quoted(name)})").fetchall()
            if not cols:
                raise AnalysisError(f"no table {name}")
            schema = StructType([StructField(c[1], TYPES.get(c[2].upper(), StringType())) for c in cols])
        options = {"database": ",".join(self.files(options))}
        sql = f"SELECT {', '.join(quoted(n) for n in schema.names)} FROM {quoted(name)}"
        return self.run(spark, sql, marked(schema, Source(self, name, options)), options)

    def execute(self, spark: SparkSession, sql: str, options: dict[str, str], schema: StructType | None) -> DataFrame:
        """Raw SQL; without a schema its columns are read as text."""
        if schema is None:
            with opened(self.files(options)[0]) as con:
                schema = StructType([StructField(d[0], StringType()) for d in con.execute(f"SELECT * FROM ({sql}) LIMIT 0").description])
        return self.run(spark, sql, schema, options)

    def run(self, spark: SparkSession, sql: str, schema: StructType, options: dict[str, str]) -> DataFrame:
        files = self.files(options)
        arrow = pa.schema([pa.field(f"f{i}", t) for i, t in enumerate(to_arrow_schema(schema).types)])
        text = [f.dataType.simpleString() == "string" for f in schema.fields]
        names = schema.names

        def rows(batches):
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    con = opened(path)
                    try:
                        cursor = con.execute(sql)
                        while got := cursor.fetchmany(10_000):
                            cols = [[v if v is None or not t or isinstance(v, str) else str(v) for v in c] for c, t in zip(zip(*got, strict=True), text, strict=True)]
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], names=names)
                    finally:
                        con.close()

        # a row of a path for each file, one to a task
        paths = spark.createDataFrame([(f, i) for i, f in enumerate(files)], "path string, i int").repartitionById(len(files), "i")
        return paths.select("path").mapInArrow(rows, schema)
