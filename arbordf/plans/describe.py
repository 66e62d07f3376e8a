"""Descriptions of queries and relations as rows."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql.types import StructField

from ..functions.nodes import NODE_KEY
from ..sources.infer import SQL_NAMES, numeric, sql_type

DESCRIBE = (
    "TABLE_SCHEMA STRING, TABLE_NAME STRING, COLUMN_NAME STRING, ORIGINAL_TABLE_NAME STRING, ORIGINAL_COLUMN_NAME STRING, ORDINAL_POSITION INT,"
    " IS_NULLABLE BOOLEAN, DATA_TYPE STRING, NUMERIC_PRECISION INT, NUMERIC_PRECISION_RADIX INT, NUMERIC_SCALE INT, ANNOTATION_KEY STRING, ANNOTATION_VALUE STRING"
)
SCHEMAS = DESCRIBE.replace("DATA_TYPE STRING,", "DATA_TYPE STRING, SPARK_TYPE STRING,") + ", COMMENT STRING"


@dataclass(frozen=True)
class Origin:
    """Where a column comes from."""

    table: str
    column: str


def data_type(f: StructField) -> str:
    if NODE_KEY in (f.metadata or {}):
        return "<INTERNAL>"
    name = f.dataType.simpleString()
    return SQL_NAMES.get(name) or (sql_type(f.dataType) if name.startswith("decimal") else name.upper())


def exploded(row: tuple) -> list[tuple]:
    """One row for every combination of the entries of list and dict values; an empty one counts as null."""
    parts = []
    for v in row:
        if isinstance(v, dict):
            parts.append([(k, None if x is None else str(x)) for k, x in v.items()] or [(None, None)])
        elif isinstance(v, list):
            parts.append([(x,) for x in v] or [(None,)])
        else:
            parts.append([(v,)])
    return [tuple(x for p in combo for x in p) for combo in product(*parts)]


def annotations(f: StructField) -> dict:
    return {k: v for k, v in (f.metadata or {}).items() if k not in (NODE_KEY, "comment") and not k.startswith("__")}


def described(df: DataFrame, table: str, origins: list[Origin | None]) -> list[tuple]:
    """Rows of DESCRIBE; a row for each annotation of a column, one with nulls if it has none."""
    out = []
    for i, (f, o) in enumerate(zip(df.schema.fields, origins, strict=True)):
        out += exploded(("", table, f.name, o.table if o else table, o.column if o else f.name, i + 1, f.nullable, data_type(f), *numeric(f.dataType), annotations(f)))
    return out


def lineage(df: DataFrame) -> list[Origin | None]:
    """Origins of a DataFrame's columns: aliases and expressions of a single attribute are followed down the
    analysed plan to the nearest named relation."""
    plan = df._jdf.queryExecution().analyzed()
    parents: dict[int, int] = {}
    names: dict[int, str] = {}
    tables: dict[int, str] = {}

    def seq(s):
        return [s.apply(i) for i in range(s.size())]

    def visit(p) -> None:
        kind = p.getClass().getSimpleName()
        for e in seq(p.expressions()):
            if e.getClass().getSimpleName() == "Alias":
                refs = seq(e.references().toSeq())
                if len(refs) == 1:
                    parents[e.exprId().id()] = refs[0].exprId().id()
        kids = seq(p.children())
        if kind == "SubqueryAlias":
            for a in seq(p.output()):
                tables.setdefault(a.exprId().id(), p.identifier().name())
        if not kids:
            for a in seq(p.output()):
                names[a.exprId().id()] = a.name()
        for k in kids:
            visit(k)

    visit(plan)
    out = []
    for a in seq(plan.output()):
        i, seen = a.exprId().id(), set()
        while i in parents and i not in seen:
            seen.add(i)
            i = parents[i]
        name = names.get(i)
        out.append(Origin(tables.get(i, ""), name) if name else None)
    return out
