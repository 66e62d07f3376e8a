"""What a data source must offer to be used by the catalog statements, and two providers.

A provider is found by name in a registry (``register_provider``) or as a class by its dotted path, also as a
package with a ``DefaultSource``.
"""

from __future__ import annotations

import importlib
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..errors import AnalysisError
from .partitions import PartitionFunction, PartitionScheme

Options = dict[str, str]


@runtime_checkable
class TableProvider(Protocol):
    """Tables by name."""

    def table_names(self, options: Options) -> list[str]: ...
    def table(self, spark: SparkSession, name: str, options: Options, schema: StructType | None = None) -> DataFrame: ...


@runtime_checkable
class CreatableProvider(Protocol):
    """Tables that can be made, dropped and appended to. A provider may name the kinds it makes (temporary,
    persistent) in ``table_kinds``; the option table_kind tells it which one a statement asks for."""

    def create_table(self, spark: SparkSession, name: str, schema: StructType | None, data: DataFrame | None, options: Options) -> None: ...
    def drop_table(self, name: str, options: Options) -> None: ...
    def append(self, spark: SparkSession, name: str, options: Options) -> None: ...


@runtime_checkable
class ViewProvider(Protocol):
    """Views kept as statement text, of the kinds in ``view_kinds``."""

    view_kinds: frozenset[str]

    def create_view(self, name: str, kind: str, sql: str, options: Options) -> None: ...
    def drop_view(self, name: str, options: Options) -> None: ...
    def views(self, options: Options) -> dict[str, tuple[str, str]]: ...


@runtime_checkable
class RawSqlProvider(Protocol):
    """Statements in the source's own language."""

    def execute(self, spark: SparkSession, sql: str, options: Options, schema: StructType | None) -> DataFrame: ...


@runtime_checkable
class PartitionProvider(Protocol):
    """Partition functions and schemes."""

    def create_partition_function(self, f: PartitionFunction, options: Options) -> None: ...
    def drop_partition_function(self, name: str, options: Options) -> None: ...
    def partition_functions(self, options: Options) -> list[PartitionFunction]: ...
    def partition_schemes(self, options: Options) -> list[PartitionScheme]: ...


@runtime_checkable
class CatalogProvider(Protocol):
    """System tables listed by the source itself: rows of the columns asked for, of which those may be left out that
    ``where`` (a condition of sqlgen; None for none) doesn't hold for. None: not a table it lists."""

    def catalog(self, table: str, columns: list[str], where: object | None, options: Options) -> list[tuple] | None: ...


@runtime_checkable
class DdlProvider(Protocol):
    """Engine statements (graphs, collections, series) as normalised text."""

    def run_ddl(self, text: str, options: Options) -> None: ...


_named: dict[str, object] = {}


def register_provider(name: str, provider: object) -> None:
    _named[name.lower()] = provider


def resolve(name: str) -> object:
    """The provider of that name; classes are made once without arguments."""
    key = name.lower()
    if key in _named:
        return _named[key]
    for path in (name, f"{name}.DefaultSource"):
        module, _, attr = path.rpartition(".")
        try:
            found = getattr(importlib.import_module(module), attr) if module else None
        except (ImportError, AttributeError):
            continue
        if isinstance(found, type):
            _named[key] = found()
            return _named[key]
    raise AnalysisError(f"no provider {name}")


def needs(provider: object, protocol: type, what: str):
    if not isinstance(provider, protocol):
        raise AnalysisError(f"{type(provider).__name__} doesn't support {what}")
    return provider


@dataclass
class MemoryProvider:
    """Everything in memory: for tests and small catalogs."""

    #: Whether the options path and paths stand for tablepath and files.
    renamed_options = True
    view_kinds: frozenset[str] = frozenset({"plain", "dimension", "cube"})
    frames: dict[str, DataFrame] = field(default_factory=dict)
    kept_views: dict[str, tuple[str, str]] = field(default_factory=dict)
    functions: dict[str, PartitionFunction] = field(default_factory=dict)
    schemes: list[PartitionScheme] = field(default_factory=list)
    statements: list[str] = field(default_factory=list)
    made: dict[str, str] = field(default_factory=dict)

    def table_names(self, options):
        return sorted(self.frames)

    def table(self, spark, name, options, schema=None):
        if name not in self.frames:
            raise AnalysisError(f"no table {name}")
        return self.frames[name]

    def create_table(self, spark, name, schema, data, options):
        self.frames[name] = data if data is not None else spark.createDataFrame([], schema or "field INT")
        self.made[name] = options.get("table_kind", "persistent")

    def drop_table(self, name, options):
        self.frames.pop(name, None)

    def append(self, spark, name, options):
        files = [f.strip() for f in (options.get("files") or options.get("paths") or "").split(",") if f.strip()]
        new = spark.read.format(options.get("format", "parquet")).load(files)
        self.frames[name] = self.frames[name].unionByName(new)

    def create_view(self, name, kind, sql, options):
        self.kept_views[name] = (kind, sql)

    def drop_view(self, name, options):
        self.kept_views.pop(name, None)

    def views(self, options):
        return dict(self.kept_views)

    def execute(self, spark, sql, options, schema):
        self.statements.append(sql)
        return spark.sql(sql)

    def create_partition_function(self, f, options):
        if f.name in self.functions:
            raise AnalysisError(f"partition function {f.name} exists")
        self.functions[f.name] = f

    def drop_partition_function(self, name, options):
        if self.functions.pop(name, None) is None:
            raise AnalysisError(f"no partition function {name}")

    def partition_functions(self, options):
        return [self.functions[k] for k in sorted(self.functions)]

    def partition_schemes(self, options):
        return list(self.schemes)

    def run_ddl(self, text, options):
        self.statements.append(text)


class SparkProvider:
    """Any Spark format by its name: tables are read with the options given, raw SQL goes to JDBC."""

    def __init__(self, format: str):
        self.format = format

    def table_names(self, options):
        return [t.strip() for t in options.get("tables", "").split(",") if t.strip()]

    def table(self, spark, name, options, schema=None):
        reader = spark.read.format(self.format).options(**{k: v for k, v in options.items() if k not in ("tables",)})
        return (reader.schema(schema) if schema else reader).load()

    def execute(self, spark, sql, options, schema):
        reader = spark.read.format("jdbc").options(**options).option("query", sql)
        return reader.load()


register_provider("memory", MemoryProvider())
for _f in ("parquet", "orc", "csv", "json", "jdbc", "text"):
    register_provider(_f, SparkProvider(_f))


def _register_sqlite() -> None:
    from .sqlite import SqliteProvider

    register_provider("sqlite", SqliteProvider())


_register_sqlite()
