"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import EngineError

#: Path elements, or pairs of a node and one above it, that one task of a shuffle takes where their number is known.
CELLS = 500_000


def tasks(spark: SparkSession, cells: int | None) -> int:
    """Partitions of a shuffle of ``cells`` path elements: as many as the session says, or more, so that none has many more than ``CELLS``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(cells or 0) // CELLS))


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or, in a local run where that is unset, a temporary folder. A cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise EngineError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="arbordf-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/arbordf-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._arbordf_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Remove a table that ``written`` made and that no plan still to run reads."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    path = jvm.org.apache.hadoop.fs.Path(df._arbordf_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
