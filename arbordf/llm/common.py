"""What the operators share: tables in the shared folder, column picking, word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the same set that bytes.split() splits on.
SPACE = b" \t\n\r\x0b\x0c"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, where it is unset in a
    local run, a temporary folder that is then set for the rest of the session. A cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="arbordf-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Limit Arrow batches to 8 MB for the session, unless it has a limit already: the usual 10,000 rows of long
    texts may be more than a worker holds."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(8 << 20))


#: Workspaces opened inside scratch(), innermost last.
_SCRATCH: list[list[Workspace]] = []


class Workspace:
    """Tables written to the shared folder, so that lineage is cut and a lost executor costs nothing
    but the tasks it ran. ``drop`` removes those that no returned plan reads any more."""

    def __init__(self, spark: SparkSession, label: str):
        small_batches(spark)
        self.spark, self.path = spark, f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        if _SCRATCH:
            _SCRATCH[-1].append(self)

    def folder(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:03d}-{name}"

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = self.folder(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._arbordf_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "_arbordf_path", None):
                remove(self.spark, path)

    def drop_all(self) -> None:
        remove(self.spark, self.path)


@contextmanager
def scratch() -> Iterator[None]:
    """All tables of workspaces opened inside go at the end: results must have been written by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for ws in _SCRATCH.pop():
            ws.drop_all()


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a shared folder or file, and the path in it."""
    return pafs.FileSystem.from_uri(folder)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, so that few texts exist as Python objects at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def semi_join(big: DataFrame, ids: DataFrame, key: str, small: int = 1_000_000) -> DataFrame:
    """Rows of ``big`` whose key is in ``ids`` (distinct keys, already written): broadcast when a count
    shows at most ``small`` ids (16 MB), else a shuffled join."""
    n = ids.count()
    return big.join(F.broadcast(ids) if n <= small else ids, key, "left_semi")


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^ \t\n\x0B\f\r]+"


def n_words(c: str = "text") -> Column:
    """Number of words of a text; 0 for null. Counted on the JVM."""
    return F.coalesce(F.regexp_count(F.col(c).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
