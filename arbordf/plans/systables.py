"""System tables over the registry, the session and providers.

A query's own columns and conditions come along: rows that its filter excludes and columns it doesn't name are left
out before they reach Spark, and a provider that lists its catalog itself (``CatalogProvider``) gets both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string

from ..errors import AnalysisError, EngineError
from ..sources.infer import numeric
from ..sources.providers import CatalogProvider, PartitionProvider, TableProvider, ViewProvider, needs, resolve
from . import describe, filters
from .sqlgen import Expr

LOCAL = {"TABLES", "OBJECT_DEPENDENCIES", "TABLE_METADATA", "SCHEMAS", "SESSION_CONTEXT", "RELATION_SQL_NAME"}
REMOTE = {"TABLES", "TABLE_METADATA", "SCHEMAS", "PARTITION_FUNCTIONS", "PARTITION_SCHEMES"}
TABLES = "TABLE_NAME STRING, IS_TEMPORARY STRING, KIND STRING, PROVIDER STRING"
DEPENDENCIES = "BASE_SCHEMA_NAME STRING, BASE_OBJECT_NAME STRING, BASE_OBJECT_TYPE STRING, DEPENDENT_SCHEMA_NAME STRING, DEPENDENT_OBJECT_NAME STRING, DEPENDENT_OBJECT_TYPE STRING, DEPENDENCY_TYPE INT"
FUNCTIONS = "ID STRING, TYPE STRING, COLUMN_NAME STRING, COLUMN_TYPE STRING, BOUNDARIES STRING, BLOCK_SIZE INT, PARTITIONS INT, MIN_PARTITIONS INT, MAX_PARTITIONS INT"


#: Schemas by system table.
ALL = {"TABLES": TABLES, "OBJECT_DEPENDENCIES": DEPENDENCIES, "TABLE_METADATA": "TABLE_NAME STRING, METADATA_KEY STRING, METADATA_VALUE STRING", "SCHEMAS": describe.SCHEMAS,
       "SESSION_CONTEXT": "SECTION STRING, KEY STRING, VALUE STRING", "RELATION_SQL_NAME": "RELATION_NAME STRING, SQL_NAME STRING", "PARTITION_FUNCTIONS": FUNCTIONS, "PARTITION_SCHEMES": "ID STRING, PARTITION_FUNCTION_ID STRING, AUTO_COLOCATION BOOLEAN"}


def kept(rows: Sequence[tuple], names: list[str], wanted: list[str], where: Expr | None) -> list[tuple]:
    """The rows that ``where`` holds for, with the columns ``wanted``."""
    holds = filters.compiled(where) if where is not None else None
    at = [names.index(c) for c in wanted]
    return [tuple(r[i] for i in at) for r in rows if holds is None or holds(dict(zip(names, r, strict=True)))]


def system_table(session, name: str, provider: str | None = None, options: dict[str, str] | None = None, columns: set[str] | None = None, where: Expr | None = None) -> DataFrame:
    """The system table ``name`` (any case) of this session, or of a provider. ``columns``: those that the query names
    (None: all); ``where``: a condition that it demands."""
    name, options = name.upper(), options or {}
    if name not in LOCAL | REMOTE:
        raise AnalysisError(f"no system table {name}")
    if name not in (REMOTE if provider else LOCAL):
        raise AnalysisError(f"system table {name} is not available {'from a provider' if provider else 'without a provider'}")
    spark = session.spark
    schema: StructType = _parse_datatype_string(ALL[name])
    wanted = [c for c in schema.names if columns is None or c in columns] or schema.names[:1]
    if where is not None and not filters.columns(where) <= set(schema.names):
        where = None

    def make(rows: Sequence[tuple], _: str) -> DataFrame:
        return spark.createDataFrame(kept(rows, schema.names, wanted, where), StructType([schema[c] for c in wanted]))

    flag = lambda b: "TRUE" if b else "FALSE"
    found = resolve(provider) if provider else None
    if isinstance(found, CatalogProvider):
        listed = found.catalog(name, wanted, where, options)
        if listed is not None:
            return spark.createDataFrame(listed, StructType([schema[c] for c in wanted]))
    if name == "TABLES":
        if found:
            rows = [(t, "FALSE", "TABLE", provider) for t in needs(found, TableProvider, "table listings").table_names(options)]
            if isinstance(found, ViewProvider):
                rows += [(v, "FALSE", _kind(k), provider) for v, (k, _) in sorted(found.views(options).items())]
        else:
            rows = [(r.name, flag(r.is_temporary), _kind(r.kind), r.provider) for r in session.registry.all()]
        return make(rows, TABLES)
    if name == "OBJECT_DEPENDENCIES":
        return make([(None, b, bk, None, d, dk, 0) for b, bk, d, dk in session.registry.dependencies()], DEPENDENCIES)
    if name == "TABLE_METADATA":
        if found:
            rows = [(t, None, None) for t in needs(found, TableProvider, "table listings").table_names(options)]
        else:
            rows = [x for r in session.registry.all() for x in describe.exploded((r.name, r.metadata))]
        return make(rows, "TABLE_NAME STRING, METADATA_KEY STRING, METADATA_VALUE STRING")
    if name == "SCHEMAS":
        rows = []
        if found:
            frames = [(t, lambda t=t: found.table(spark, t, options)) for t in needs(found, TableProvider, "table listings").table_names(options)]
        else:
            frames = [(r.name, lambda r=r: session.table(r.name)) for r in session.registry.all()]
        for table, frame in frames:
            try:
                df = frame()
                origins = describe.lineage(df)
            except Exception as e:  # a view that no longer fits its bases has no schema
                if isinstance(e, (EngineError,)) or "pyspark" in type(e).__module__:
                    continue
                raise
            for i, (f, o) in enumerate(zip(df.schema.fields, origins, strict=True)):
                rows += [(None, table, f.name, (o.table or table) if o else table, o.column if o else f.name, i + 1, f.nullable, describe.data_type(f), f.dataType.simpleString(), *numeric(f.dataType), k, v, (f.metadata or {}).get("comment")) for k, v in (describe.annotations(f) or {None: None}).items()]
        return make([tuple(None if x is None else str(x) if j == 12 else x for j, x in enumerate(r)) for r in rows], describe.SCHEMAS)
    if name == "SESSION_CONTEXT":
        rows = [("SQLContext", r.key, r.value) for r in spark.sql("SET").collect()]
        rows += [("SparkContext", k, v) for k, v in spark.sparkContext.getConf().getAll()]
        return make(sorted(rows), "SECTION STRING, KEY STRING, VALUE STRING")
    if name == "RELATION_SQL_NAME":
        return make([(r.name, r.options.get("sql_name", r.name)) for r in session.registry.all()], "RELATION_NAME STRING, SQL_NAME STRING")
    p = needs(found, PartitionProvider, "partition functions")
    if name == "PARTITION_FUNCTIONS":
        rows = []
        for f in p.partition_functions(options):
            bounds = ",".join(f.splitters) or ",".join(map(str, f.boundaries())) or None
            rows += [(f.name, {"split": "RANGE", "interval": "RANGE"}.get(f.kind, f.kind.upper()), f"C{i + 1}", t, bounds, f.block_size, f.parts, f.min_partitions, f.max_partitions) for i, t in enumerate(f.types)]
        return make(rows, FUNCTIONS)
    return make([(s.name, s.function, s.auto_colocation) for s in p.partition_schemes(options)], "ID STRING, PARTITION_FUNCTION_ID STRING, AUTO_COLOCATION BOOLEAN")


def _kind(kind: str) -> str:
    return {"table": "TABLE", "view": "VIEW", "plain": "VIEW"}.get(kind, kind.upper())
