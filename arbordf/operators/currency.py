"""Currency conversion by the latest rate on or before a date.

Dates are keys of digits (``2020-05-31`` and ``20200531`` are 20200531), cut into buckets by their last two. A
rate is looked up in two short sorted arrays: the rates of the date's own bucket, met by an equi join on
(from, to, bucket), and the last rate of each earlier bucket, met by the currency pair. So a row sees at most a
month of rates and one entry a month, however long the series, and a frequent pair is spread over its buckets.
Either side is broadcast when a count shows at most SMALL_RATES rates in it.

Amounts and rates are taken as DECIMAL(37,18); their product is put together from integer and fractional parts,
so that nothing is cut before the one cast to DECIMAL(30,15). An amount or result that doesn't fit is null.
``convert`` and the SQL function ``cc`` share all of this.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType, StringType

from ..errors import AnalysisError, EngineError

SMALL_RATES = 500_000
PREFIX = "spark.sql.currency.basic."
MODES = ("fail_on_error", "set_to_null", "keep_unconverted")
RESULT = "decimal(30,15)"
EXACT = "decimal(37,18)"


def date_key(date: str) -> str:
    """SQL of a date's key; null for text that is no number without its dashes."""
    return f"try_cast(replace(cast({date} AS string), '-', '') AS int)"


def rate_tables(rates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rates: four columns by position, from, to, date, rate. Returns (_f, _t, _b, _days: sorted array of since and
    rate in the bucket) and (_f, _t, _months: sorted array of bucket and its last rate). Of rates that repeat a
    pair and date the largest counts; rows with a null or a date that is none drop out."""
    r = rates.toDF("_f", "_t", "_since", "_rate").select("_f", "_t", F.expr(date_key("_since")).alias("since"), F.expr(f"try_cast(_rate AS {EXACT})").alias("rate"))
    r = r.where("_f is not null and _t is not null and since is not null and rate is not null")
    r = r.groupBy("_f", "_t", "since").agg(F.max("rate").alias("rate"))
    days = r.groupBy("_f", "_t", F.expr("since div 100").alias("_b")).agg(F.sort_array(F.collect_list(F.struct("since", "rate"))).alias("_days"))
    last = F.struct(F.col("_b").alias("bucket"), F.expr("element_at(_days, -1).rate").alias("rate"))
    return days, days.groupBy("_f", "_t").agg(F.sort_array(F.collect_list(last)).alias("_months"))


DAYS, MONTHS = f"ARRAY<STRUCT<since: INT, rate: {EXACT}>>", f"ARRAY<STRUCT<bucket: BIGINT, rate: {EXACT}>>"


def found_rate(key: str, days: str, months: str) -> str:
    """SQL of the latest rate on or before the date with that key."""
    return f"coalesce(try_element_at(filter({days}, x -> x.since <= {key}), -1).rate, try_element_at(filter({months}, x -> x.bucket < {key} div 100), -1).rate)"


def product(amount: str, rate: str) -> str:
    """SQL of amount * rate, both DECIMAL(37,18), as DECIMAL(30,15), rounded half up once. Whole and fractional parts
    are multiplied apart, since the type of the plain product would keep six digits; three of the four products
    are exact at 18 decimals, and the last is cut at 20, which leaves the rounding at 15 as it is."""
    whole = lambda x: f"cast(if({x} >= 0, floor({x}), ceil({x})) AS decimal(19,0))"
    rest = lambda x: f"cast({x} % 1BD AS decimal(18,18))"
    small = f"({rest(amount)} * {rest(rate)})"
    parts = [f"try_cast(try_multiply({whole(amount)}, {whole(rate)}) AS decimal(15,0))", *(f"try_cast({x} * {y} AS decimal(33,18))" for x, y in ((whole(amount), rest(rate)), (rest(amount), whole(rate))))]
    parts.append(f"cast({small} - {small} % 0.00000000000000000001BD AS decimal(21,20))")
    return f"try_cast({' + '.join(parts)} AS {RESULT})"


def quotient(amount: str, rate: str) -> str:
    """SQL of amount / rate to 14 decimals: a quotient of six, then that of the remainder."""
    first = f"try_cast(try_divide({amount}, {rate}) AS decimal(24,6))"
    rest = f"try_cast({amount} - {product(first, rate)} AS decimal(24,18))"
    return f"({first} + coalesce(try_cast(try_divide({rest}, {rate}) AS decimal(16,14)), 0BD))"


def scale_of(amount: str) -> str:
    """SQL of the number of decimals of an amount by its type: 15 where it has no fixed one."""
    return f"CASE WHEN typeof({amount}) LIKE 'decimal%' THEN least(15, int(regexp_extract(typeof({amount}), ',([0-9]+)', 1))) WHEN typeof({amount}) IN ('double', 'float', 'string') THEN 15 ELSE 0 END"


def conversion(amount: str, source: str, target: str, date: str, rate: str, swapped: str | None, mode: str, scale: int | str) -> str:
    """SQL of the converted amount, given SQL of the amount as DECIMAL(37,18), of its rate and, where inverse rates are
    allowed, of the swapped pair's; ``scale``: decimals of the amount's type, or SQL of them."""
    value = f"CASE WHEN {rate} IS NOT NULL THEN {product(amount, rate)}"
    if swapped:
        q = quotient(amount, swapped)
        rounded = lambda n: f"try_cast(bround({q}, {n}) AS {RESULT})"
        value += f" WHEN {swapped} IS NOT NULL THEN {rounded(scale) if isinstance(scale, int) else f'CASE {scale} ' + ' '.join(f'WHEN {n} THEN {rounded(n)}' for n in range(15)) + f' ELSE {rounded(15)} END'}"
    if mode == "keep_unconverted":
        value += f" ELSE try_cast({amount} AS {RESULT})"
    elif mode == "fail_on_error":
        value += f" ELSE cast(raise_error(concat('no rate from ', {source}, ' to ', {target}, ' on ', {date})) AS {RESULT})"
    given = " AND ".join(f"({x}) IS NOT NULL" for x in (amount, source, target, date))
    return f"CASE WHEN {given} THEN {value} END END"


def register(spark: SparkSession) -> None:
    """The SQL functions that cc(...) is made of: a function binds its arguments, so that a sub-query among them
    stands in the plan once."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION __cc_rate(k INT, days {DAYS}, months {MONTHS}) RETURNS {EXACT} RETURN {found_rate('k', 'days', 'months')}")
    for mode in MODES:
        for inverse in (False, True):
            body = conversion("a", "s", "t", "d", "r", "i" if inverse else None, mode, "n")
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {value_name(mode, inverse)}(a {EXACT}, s STRING, t STRING, d STRING, n INT, r {EXACT}, i {EXACT}) RETURNS {RESULT} RETURN {body}")


def value_name(mode: str, inverse: bool) -> str:
    return f"__cc_{mode}{'_inverse' if inverse else ''}"


def checked_mode(error_handling: str) -> str:
    mode = error_handling.lower()
    if mode not in MODES:
        raise AnalysisError(f"error_handling must be one of {', '.join(MODES)}")
    return mode


def convert(df: DataFrame, amount: str | Column, source: str | Column, target: str | Column, date: str | Column, rates: DataFrame, result: str = "converted", allow_inverse: bool = False, error_handling: str = "set_to_null") -> DataFrame:
    """``df`` with ``result`` = amount * rate(source, target, latest date <= date) as DECIMAL(30,15).

    With ``allow_inverse`` a pair without a rate is divided by the swapped pair's, rounded half even at the
    amount's scale. Without any rate: an error when rows are read, null, or the amount as it is. Any null
    argument gives null."""
    mode = checked_mode(error_handling)
    col = lambda c: F.col(c) if isinstance(c, str) else c
    days, months = rate_tables(rates)
    n = days.agg(F.sum(F.size("_days")).alias("rates"), F.count("*").alias("buckets")).first()
    few = lambda t, n: F.broadcast(t) if (n or 0) <= SMALL_RATES else t
    days, months = few(days, n.rates), few(months, n.buckets)
    kind = df.select(col(amount)).schema[0].dataType
    scale = min(15, kind.scale) if isinstance(kind, DecimalType) else 15 if isinstance(kind, (DoubleType, FloatType, StringType)) else 0
    out = df.withColumn("_a", col(amount).try_cast(EXACT)).withColumn("_s", col(source)).withColumn("_g", col(target)).withColumn("_d", col(date).cast("string")).withColumn("_k", F.expr(date_key("_d")))

    def look_up(out: DataFrame, f: str, t: str, name: str) -> DataFrame:
        own = days.toDF("_f", "_t", "_b", "_days")
        out = out.join(own, (F.col(f) == F.col("_f")) & (F.col(t) == F.col("_t")) & (F.expr("_k div 100") == F.col("_b")), "left").drop("_f", "_t", "_b")
        out = out.join(months, (F.col(f) == F.col("_f")) & (F.col(t) == F.col("_t")), "left").drop("_f", "_t")
        return out.withColumn(name, F.expr(found_rate("_k", "_days", "_months"))).drop("_days", "_months")

    out = look_up(out, "_s", "_g", "_r1")
    if allow_inverse:
        out = look_up(out, "_g", "_s", "_r2")
    value = F.expr(conversion("_a", "_s", "_g", "_d", "_r1", "_r2" if allow_inverse else None, mode, scale))
    return out.withColumn(result, value).drop("_a", "_s", "_g", "_d", "_k", "_r1", "_r2")


class BasicConversion:
    """Conversion with options from the session's configuration (keys below PREFIX: table, allow_inverse,
    do_update, error_handling), or from ``options`` where given there, and rates kept by table name until
    ``do_update`` asks for new ones."""

    def __init__(self, spark: SparkSession, lookup: Callable[[str], DataFrame] | None = None, options: dict[str, str] | None = None):
        self.spark, self.lookup, self.options = spark, lookup or spark.table, dict(options or {})
        self._name: str | None = None
        self._rates: DataFrame | None = None

    def option(self, key: str, default: str) -> str:
        return self.options.get(key) or self.spark.conf.get(PREFIX + key, default)

    def rates(self) -> DataFrame:
        name, update = self.option("table", "rates"), self.option("do_update", "false").lower() == "true"
        if name != self._name or update or self._rates is None:
            if self._rates is not None:
                self._rates.unpersist()
            self._rates = self.lookup(name).cache()
            self._name = name
            if update:
                self.spark.conf.set(PREFIX + "do_update", "false")
        return self._rates

    def settings(self) -> tuple[bool, str]:
        """(inverse rates allowed, error handling)."""
        return self.option("allow_inverse", "false").lower() == "true", checked_mode(self.option("error_handling", "set_to_null"))

    def cc(self, df: DataFrame, amount, source, target, date, result: str = "cc") -> DataFrame:
        return convert(df, amount, source, target, date, self.rates(), result, *self.settings())

    def sql(self, amount: str, source: str, target: str, date: str, view: Callable[[DataFrame], str]) -> str:
        """SQL of cc(...), usable in any expression: the arrays come by scalar sub-queries, which Spark turns into
        the equi joins of ``convert``. ``view`` names a DataFrame for SQL."""
        days, months = map(view, rate_tables(self.rates()))
        inverse, mode = self.settings()
        key = date_key(date)

        def look(f: str, t: str) -> str:
            pair = f"_f = {f} AND _t = {t}"
            return f"__cc_rate({key}, (SELECT first(_days) FROM {days} WHERE {pair} AND _b = {key} div 100), (SELECT first(_months) FROM {months} WHERE {pair}))"

        swapped = look(target, source) if inverse else f"cast(NULL AS {EXACT})"
        return f"{value_name(mode, inverse)}(try_cast({amount} AS {EXACT}), cast({source} AS STRING), cast({target} AS STRING), cast({date} AS STRING), {scale_of(amount)}, {look(source, target)}, {swapped})"


class ErpConversion:
    """Adapter for ``convert_currency``: hands the five configuration tables to a conversion library. The
    algorithm is that library's; without one every call raises."""

    TABLES = ("tcurx", "tcurv", "tcurf", "tcurr", "tcurn")
    PREFIX = "spark.sql.currency.erp."

    def __init__(self, spark: SparkSession, library: Callable[..., DataFrame] | None = None):
        self.spark, self.library = spark, library

    def tables(self) -> dict[str, str]:
        conf = self.spark.conf
        prefix = conf.get(self.PREFIX + "table_prefix", "")
        return {t: prefix + conf.get(self.PREFIX + f"table.{t}", t.upper()) for t in self.TABLES}

    def convert_currency(self, df: DataFrame, client, conversion_type, amount, source, target, date, result: str = "convert_currency") -> DataFrame:
        if self.library is None:
            raise EngineError("convert_currency needs a conversion library; none is registered")
        return self.library(df, {k: self.spark.table(v) for k, v in self.tables().items()}, client, conversion_type, amount, source, target, date, result)
