"""AnalyticsSession: the SQL dialect over a SparkSession."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .errors import AnalysisError
from .functions import nodes, scalars
from .operators import currency
from .operators.currency import BasicConversion, ErpConversion
from .plans import describe, engine_ddl, pushdown
from .plans.annotations import parse as parse_annotation
from .plans.ddl import Ddl
from .plans.frontend import Query
from .plans.lexer import Cursor, Token, split, statements
from .sources.providers import RawSqlProvider, TableProvider, needs, resolve
from .sources.registry import Registry

#: Column names that DDL refuses. Common reserved words of SQL:2003.
RESERVED = set(
    "ALL AND ANY AS BETWEEN BOTH CASE CAST CHECK COLUMN CONSTRAINT CREATE CROSS CURRENT CURSOR DELETE DESCRIBE DISTINCT DROP ELSE END EXCEPT EXISTS FETCH FOR FOREIGN FROM FULL "
    "GRANT GROUP HAVING IN INNER INSERT INTERSECT INTO IS JOIN LEADING LEFT LIKE NATURAL NOT NULL ON OR ORDER OUTER OVERLAPS PRIMARY REFERENCES RIGHT ROLLUP SELECT SET SOME TABLE "
    "THEN TO TRAILING TRIGGER UNION UNIQUE UPDATE USER USING VALUES WHEN WHERE WITH".split()
)
AUTO_REGISTER = "spark.arbordf.autoregister"
EMULATION = "spark.arbordf.hive_emulation"


class AnalyticsSession:
    """Runs statements of the dialect; ``spark`` stays usable directly. Names are folded to lower case unless
    ``spark.sql.caseSensitive`` is set."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.registry = Registry(spark.conf.get("spark.sql.caseSensitive", "false") == "true")
        self.frames: dict[str, Callable[[], DataFrame]] = {}
        self.table_functions: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self.node_columns: dict[tuple[str, str], str] = {}
        self.basic, self.erp = BasicConversion(spark, self.table), ErpConversion(spark)
        self._id, self._n = uuid.uuid4().hex[:12], itertools.count()
        self._views: list[str] = []
        self.key_names: list[str] = []
        if not getattr(spark, "_arbordf_functions", False):
            nodes.register(spark)
            scalars.register(spark)
            currency.register(spark)
            spark._arbordf_functions = True
        for provider in filter(None, (p.strip() for p in spark.conf.get(AUTO_REGISTER, "").split(","))):
            self.sql(f"REGISTER ALL TABLES USING {provider} IGNORING CONFLICTS")

    def sql(self, text: str) -> DataFrame:
        """Run one statement."""
        c, at = Cursor(text), len(self._views)
        try:
            if engine_ddl.is_engine_statement(c):
                return Ddl(self, text).engine()
            return Ddl(self, text).run() if Ddl.knows(c) else self._query(text)
        finally:
            # the result is analysed by now and holds the plans themselves; Spark's own dropTempView would also
            # uncache a DataFrame that a view stands for
            names = self.spark._jsparkSession.sessionState().catalog()
            for name in self._views[at:]:
                names.dropTempView(name)
            del self._views[at:]

    def script(self, text: str) -> list[DataFrame]:
        return [self.sql(s) for s in statements(text)]

    def _query(self, text: str) -> DataFrame:
        t = Cursor(text)
        if t.peek() and (t.peek().upper in ("SELECT", "WITH", "FROM", "VALUES") or t.peek().kind == "raw" or t.peek().text == "("):
            self.node_columns.clear()
            df = Query(self, text.rstrip().rstrip(";")).run()
            done = pushdown.pushed(df)
            return df if done is None else done
        return self.spark.sql(text)

    def table(self, name: str, inside: frozenset[str] = frozenset()) -> DataFrame:
        """The relation's DataFrame; a view's text is analysed anew, so it follows its bases."""
        r = self.registry.get(name)
        if r is None:
            return self.spark.table(name)
        if r.sql is not None:
            key = self.registry.fold(name)
            return Query(self, r.sql, inside=inside | {key}).run()
        return self.frames[self.registry.fold(name)]()

    def register(self, name: str, df: DataFrame, **about) -> None:
        """Enter a DataFrame as a temporary table of the dialect."""
        from .sources.registry import Relation

        self.registry.add(Relation(name, **about), replace=True)
        self.frames[self.registry.fold(name)] = lambda: df

    def temp_view(self, df: DataFrame) -> str:
        name = f"__arbordf_{self._id}_{next(self._n)}"
        df.createOrReplaceTempView(name)
        self._views.append(name)
        return name

    def raw_sql(self, text: str, provider: str, options: dict[str, str], schema: StructType | None) -> DataFrame:
        return needs(resolve(provider), RawSqlProvider, "raw SQL").execute(self.spark, text, options, schema)

    def cc_expression(self, amount: str, source: str, target: str, date: str) -> str:
        return self.basic.sql(amount, source, target, date, self.temp_view)

    def describe_query(self, query: Query, if_exists: bool) -> DataFrame:
        """Rows of describe_table(query); for the IF_EXISTS form none if the query can't be analysed."""
        try:
            df = query.run()
        except Exception:
            if not if_exists:
                raise
            return self.spark.createDataFrame([], describe.DESCRIBE)
        names = sorted(query.relations)
        table = names[0] if len(names) == 1 else ""
        origins = [o and describe.Origin(table if o.table.startswith("__arbordf_") else o.table, o.column) for o in describe.lineage(df)]
        return self.spark.createDataFrame(described_text(describe.described(df, table, origins)), describe.DESCRIBE)

    def columns(self, text: str, tokens: list[Token]) -> StructType:
        """The schema of a DDL column list: name [@(annotations)] type [COMMENT 'text'], ..."""
        fields, seen = [], set()
        for part in split(tokens):
            c = Cursor(text, part)
            quoted = c.peek() is not None and c.peek().kind == "quoted"
            name = c.name()
            if name.upper() in RESERVED and not quoted:
                raise AnalysisError(f"{name} is a reserved word")
            if name.lower() in seen:
                raise AnalysisError(f"column {name} occurs twice")
            seen.add(name.lower())
            meta = {}
            if c.take("@"):
                lo, hi = c.block()
                meta = parse_annotation(text, c.tokens[lo:hi])
            j = c.i
            while c.peek() and not c.at("COMMENT"):
                c.i += 1
            kind = c.source(j, c.i)
            if c.take("COMMENT"):
                meta["comment"] = c.string()
            fields.append(StructField(name, _parse_datatype_string(kind), True, meta))
        return StructType(fields)

    def provider_table(self, provider: str, name: str, options: dict[str, str], schema: StructType | None = None) -> Callable[[], DataFrame]:
        p = needs(resolve(provider), TableProvider, "tables")
        return lambda: p.table(self.spark, name, options, schema)


def described_text(rows: list[tuple]) -> list[tuple]:
    return [tuple(None if v is None else str(v) if i == 12 else v for i, v in enumerate(r)) for r in rows]
