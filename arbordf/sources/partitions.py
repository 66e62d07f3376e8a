"""Partition functions and schemes as records, with their use for dealing out rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import AnalysisError


@dataclass(frozen=True)
class PartitionFunction:
    """kind: hash, split (range by splitters), interval (range by stride or parts) or block."""

    name: str
    kind: str
    types: tuple[str, ...]
    parts: int | None = None
    splitters: tuple[str, ...] = ()
    right_closed: bool = False
    start: int | None = None
    end: int | None = None
    stride: int | None = None
    min_partitions: int | None = None
    max_partitions: int | None = None
    block_size: int | None = None

    def boundaries(self) -> list[int]:
        """Inner bounds of an interval function."""
        if self.kind != "interval" or self.start is None or self.end is None:
            return []
        step = self.stride or -(-(self.end - self.start) // max(1, self.parts or 1))
        return list(range(self.start + step, self.end, step))

    def apply(self, df: DataFrame, *columns: str) -> DataFrame:
        """Deal the rows of ``df`` out as this function says; range k of a range function is partition k."""
        if len(columns) != len(self.types):
            raise AnalysisError(f"{self.name} takes {len(self.types)} columns, {len(columns)} given")
        if self.kind == "hash" or self.kind == "block":
            return df.repartition(*([self.parts] if self.parts else []), *columns)
        bounds = [F.lit(b).cast(dict(df.dtypes)[columns[0]]) for b in (self.splitters or self.boundaries())]
        c = F.col(columns[0])
        # nulls are dealt to the first range
        part = F.coalesce(sum(((c > b if self.right_closed else c >= b).cast("int") for b in bounds), F.lit(0)), F.lit(0))
        return df.repartitionById(len(bounds) + 1, part)


@dataclass(frozen=True)
class PartitionScheme:
    name: str
    function: str
    auto_colocation: bool = False


SHOW_COLUMNS = "name STRING, kind STRING, types STRING, splitters STRING, rightClosed STRING, start STRING, end STRING, stride STRING, parts STRING, interval STRING"


def shown(f: PartitionFunction) -> tuple:
    text = lambda v: None if v is None else str(v)
    return (f.name, f.kind, ",".join(f.types), ",".join(f.splitters) or None, text(f.right_closed) if f.kind == "split" else None, text(f.start), text(f.end), text(f.stride), text(f.parts), None if f.kind != "interval" else ("stride" if f.stride else "parts"))
