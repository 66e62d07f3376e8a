import random
from datetime import date, timedelta
from decimal import ROUND_HALF_UP, localcontext
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from arbordf.errors import AnalysisError, EngineError
from arbordf.operators.currency import BasicConversion, ErpConversion, convert
from arbordf.session import AnalyticsSession

RATES = [("A", "B", "2020-01-01", D("2")), ("A", "B", "2020-06-01", D("4")), ("C", "A", "2020-01-01", D("8")), ("A", "B", "2020-06-01", D("3"))]
ROWS = [(1, D("10.00"), "A", "B", "2019-12-31"), (2, D("10.00"), "A", "B", "2020-01-01"), (3, D("10.00"), "A", "B", "2020-05-31"), (4, D("10.00"), "A", "B", "2021-01-01"), (5, D("1.00"), "A", "C", "2020-02-02"), (6, None, "A", "B", "2020-02-02"), (7, D("5.00"), None, "B", "2020-02-02")]


@pytest.fixture
def data(spark):
    return spark.createDataFrame(ROWS, "i int, amount decimal(10,2), f string, t string, d string"), spark.createDataFrame(RATES, "x string, y string, z string, r decimal(10,4)")


def run(data, **how):
    return {r.i: r.converted for r in convert(data[0], "amount", "f", "t", "d", data[1], **how).collect()}


def test_latest_rate(data):
    assert run(data) == {1: None, 2: 20, 3: 20, 4: 40, 5: None, 6: None, 7: None}


def test_inverse_rounds_half_even(data):
    assert run(data, allow_inverse=True)[5] == D("0.12")


def test_error_modes(data):
    assert run(data, error_handling="KEEP_UNCONVERTED") == {1: 10, 2: 20, 3: 20, 4: 40, 5: 1, 6: None, 7: None}
    with pytest.raises(Exception, match="no rate"):
        run(data, error_handling="fail_on_error")
    with pytest.raises(AnalysisError):
        run(data, error_handling="other")


def exact(a, r):
    return (a * r).quantize(D("1e-15"), ROUND_HALF_UP)


def test_precision_of_convert_and_cc(spark):
    """Rates of many digits, amounts of many, over 10^18 and negative; both ways give the same."""
    with localcontext() as ctx:
        ctx.prec = 80
        amounts = [D("1000000"), D("1.12345678"), D("-7.00000001"), D("1234567890123456789.5"), D("99999999999999.99999999"), D("0.00000001"), D("-1017.00001017"), D("0.00000049")]
        rates = [D("0.0000004"), D("0.0123456789"), D("1.0000000001"), D("123.4567890123"), D("0.00000000000123"), D("123.45678901234"), D("0.99999999999995")]
        rows = [(i * 100 + j, a, f"R{j}", "X", "2021-03-05") for i, a in enumerate(amounts) for j in range(len(rates))]
        df = spark.createDataFrame(rows, "i int, amount decimal(28,8), f string, t string, d string")
        table = spark.createDataFrame([(f"R{j}", "X", "2020-12-31", r) for j, r in enumerate(rates)], "f string, t string, d string, r decimal(24,14)")
        got = {r.i: r.converted for r in convert(df, "amount", "f", "t", "d", table).collect()}
        s = AnalyticsSession(spark)
        s.register("precise_rates", table)
        s.register("precise_amounts", df)
        s.basic.options["table"] = "precise_rates"
        assert {r.i: r.c for r in s.sql("SELECT i, cc(amount, f, t, d) AS c FROM precise_amounts").collect()} == got
        for i, a in enumerate(amounts):
            for j, r in enumerate(rates):
                want = exact(a, r)
                assert got[i * 100 + j] == (want if abs(want) < 10**15 else None), (a, r)


def test_cc_rounds_inverse_rates_like_convert(spark):
    table = spark.createDataFrame([("B", "A", "2020-01-01", D("3"))], "f string, t string, d string, r decimal(10,4)")
    s = AnalyticsSession(spark)
    s.register("inverse_rates", table)
    s.basic.options |= {"table": "inverse_rates", "allow_inverse": "true"}
    for kind, want in (("decimal(10,2)", D("0.33")), ("decimal(10,4)", D("0.3333")), ("int", D("0"))):
        df = spark.createDataFrame([(D("1.00"),)], "a decimal(10,4)").selectExpr(f"cast(a as {kind}) AS a", "'A' AS f", "'B' AS t", "'2020-02-01' AS d")
        s.register("inverse_amounts", df)
        assert s.sql("SELECT cc(a, f, t, d) AS c FROM inverse_amounts").first().c == want == convert(df, "a", "f", "t", "d", table, allow_inverse=True).first().converted


def test_lookup_over_buckets(spark):
    """Every date of some years against sparse and dense rates, by brute force."""
    r = random.Random(2)
    days = [date(2019, 1, 1) + timedelta(i) for i in range(1200)]
    rates = [(f, "X", str(d), D(k)) for k, (f, d) in enumerate((f, d) for f, share in (("S", 0.01), ("M", 0.2), ("D", 1)) for d in days[100:900] if r.random() < share)]
    rows = [(i, D(1), f, "X", str(d) if i % 2 else str(d).replace("-", "")) for i, (f, d) in enumerate((f, d) for f in "SMDN" for d in days[::7])]
    df = spark.createDataFrame(rows, "i int, a decimal(10,0), f string, t string, d string")
    got = {x.i: x.converted for x in convert(df, "a", "f", "t", "d", spark.createDataFrame(rates, "f string, t string, d string, r decimal(10,0)")).collect()}
    for i, _, f, _, d in rows:
        upto = [(x[2].replace("-", ""), x[3]) for x in rates if x[0] == f and x[2].replace("-", "") <= d.replace("-", "")]
        assert got[i] == (max(upto)[1] if upto else None)


def test_a_date_that_is_none_has_no_rate(spark, data):
    df = data[0].withColumn("d", F.lit("yesterday"))
    assert {r.converted for r in convert(df, "amount", "f", "t", "d", data[1]).collect()} == {None}


def test_plan_joins_on_keys(spark, data, monkeypatch):
    import arbordf.operators.currency as c

    monkeypatch.setattr(c, "SMALL_RATES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = convert(data[0], "amount", "f", "t", "d", data[1], allow_inverse=True)._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.split("== Physical Plan ==")[1].count("SortMergeJoin") >= 4
        assert run(data, allow_inverse=True) == {1: None, 2: 20, 3: 20, 4: 40, 5: D("0.12"), 6: None, 7: None}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rates_are_kept_until_update(spark, data):
    b = BasicConversion(spark)
    spark.conf.set("spark.sql.currency.basic.table", "my_rates")
    data[1].createOrReplaceTempView("my_rates")
    value = lambda: {r.i: r.cc for r in b.cc(data[0], "amount", "f", "t", "d").collect()}[2]
    assert value() == 20
    spark.createDataFrame([("A", "B", "2000-01-01", D("7"))], "x string, y string, z string, r decimal(10,4)").createOrReplaceTempView("my_rates")
    assert value() == 20
    spark.conf.set("spark.sql.currency.basic.do_update", "true")
    assert value() == 70 and spark.conf.get("spark.sql.currency.basic.do_update") == "false"


def test_erp_needs_its_library(spark, data):
    with pytest.raises(EngineError):
        ErpConversion(spark).convert_currency(data[0], *"abcdef")
    seen = {}
    for t in ErpConversion.TABLES:
        spark.range(1).createOrReplaceTempView(t.upper())
    ErpConversion(spark, lambda df, tables, *a: seen.update(tables) or df).convert_currency(data[0], *"abcdef")
    assert set(seen) == set(ErpConversion.TABLES)
