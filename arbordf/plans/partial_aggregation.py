"""Aggregates in two steps, for roll-ups kept between runs and for sources that aggregate themselves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AnalysisError


@dataclass(frozen=True)
class Aggregate:
    """function: avg, sum, count, min or max; ``column`` may be "*" for count; ``distinct`` as in SQL."""

    function: str
    column: str
    alias: str
    distinct: bool = False


def partial_columns(aggs: list[Aggregate]) -> list[tuple[str, Column]]:
    """Names (<alias>_<buffer>) and expressions of the first step. Averages are a sum in double and
    a count. Other functions have no two-step form here."""
    sets = {a.column for a in aggs if a.distinct}
    if len(sets) > 1:
        raise AnalysisError(f"distinct aggregates over several columns: {sorted(sets)}")
    out = []
    for a in aggs:
        if a.distinct:
            raise AnalysisError("a distinct aggregate needs its group's rows together")
        c = F.lit(1) if a.column == "*" else F.col(a.column)
        f = a.function.lower()
        if f == "avg":
            out += [(f"{a.alias}_sum", F.sum(c.cast("double"))), (f"{a.alias}_count", F.count(c))]
        elif f in ("sum", "count", "min", "max"):
            out.append((f"{a.alias}_{f}", getattr(F, f)(c)))
        else:
            raise AnalysisError(f"{a.function} has no two-step form")
    return out


def partial(df: DataFrame, keys: list[str], aggs: list[Aggregate]) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in partial_columns(aggs)])


def final(parts: DataFrame, keys: list[str], aggs: list[Aggregate]) -> DataFrame:
    """The aggregates from any number of partial results put together."""
    out = []
    for a in aggs:
        f = a.function.lower()
        if f == "avg":
            out.append((F.sum(f"{a.alias}_sum") / F.sum(f"{a.alias}_count")).alias(a.alias))
        else:
            out.append(getattr(F, "sum" if f == "count" else f)(f"{a.alias}_{f}").alias(a.alias))
    return parts.groupBy(*keys).agg(*out)
