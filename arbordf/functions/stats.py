"""Descriptive statistics as aggregate columns, and the drift test of repeated timings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.tables import written


def mean(c: str) -> Column:
    return F.avg(c)


def stdev(c: str) -> Column:
    """Sample standard deviation (n - 1)."""
    return F.stddev_samp(c)


def pearson(a: str, b: str) -> Column:
    return F.corr(a, b)


def running_before(counts: DataFrame, value: str, n: str, name: str) -> DataFrame:
    """``counts`` (distinct values, numbers of rows) plus the number of rows with lesser values. Values are
    dealt in ranges; only the ranges' totals are ordered in one place."""
    ranges = max(2, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(counts.repartitionByRange(ranges, value).withColumn("_range", F.spark_partition_id()))
    upto = lambda w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = dealt.groupBy("_range").agg(F.sum(n).alias(n))
    totals = totals.select("_range", upto(Window.orderBy("_range")).alias("_before"))
    within = upto(Window.partitionBy("_range").orderBy(value))
    return dealt.withColumn(name, within).join(F.broadcast(totals), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with mean ranks for ties, as a one-row DataFrame (rho). Rows with a null count not."""
    out = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    for c in ("a", "b"):
        ranks = running_before(out.groupBy(c).agg(F.count("*").alias("n")), c, "n", "before")
        out = out.join(ranks.select(c, (F.col("before") + (F.col("n") + 1) / 2).alias(f"r{c}")), c)
    return out.agg(F.corr("ra", "rb").alias("rho"))


def drift(times: Sequence[float]) -> float:
    """Spearman correlation of run number and time: near 1 if runs get slower and slower."""
    n = len(times)
    order = sorted(range(n), key=lambda i: times[i])
    rank = [0.0] * n
    i = 0
    while i < n:
        j = i
        while j + 1 < n and times[order[j + 1]] == times[order[i]]:
            j += 1
        for k in order[i : j + 1]:
            rank[k] = (i + j) / 2
        i = j + 1
    m = (n - 1) / 2
    num = sum((i - m) * (rank[i] - m) for i in range(n))
    den = (sum((i - m) ** 2 for i in range(n)) * sum((r - m) ** 2 for r in rank)) ** 0.5
    return num / den if den else 0.0
