"""Currency conversion of a stream against static rates, and windowed sums of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.currency import convert


def convert_stream(stream: DataFrame, amount: str, source: str, target: str, time: str, rates: DataFrame, result: str = "converted") -> DataFrame:
    """A stream-static join: each row gets the latest rate on or before its date."""
    return convert(stream, amount, source, target, F.date_format(time, "yyyy-MM-dd"), rates, result)


def windowed_sum(stream: DataFrame, time: str, value: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Sums and counts per key and window; rows later than ``late`` behind the newest are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
