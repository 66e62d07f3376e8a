import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql.types import ArrayType, DecimalType, IntegerType

from arbordf.errors import AnalysisError
from arbordf.functions.stats import drift, spearman
from arbordf.plans.filters import Comparison, reduce_and, reduce_or
from arbordf.plans.partial_aggregation import Aggregate, final, partial
from arbordf.plans.sqlgen import Aliased, Call, Col, Join, Lit, Select, SetOp, Table
from arbordf.treeview import html, tree

HOLDS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b}


def test_filter_reduction_keeps_meaning():
    r = random.Random(1)
    for _ in range(3000):
        fs = [Comparison.of(*(("a", op, v) if r.random() < 0.5 else (v, op, "a"))) for op, v in ((r.choice(list(HOLDS)), r.randint(0, 4)) for _ in range(r.randint(1, 5)))]
        both, either = reduce_and(fs), reduce_or(fs)
        for x in [i / 2 for i in range(-2, 12)]:
            assert all(HOLDS[f.op](x, f.value) for f in fs) == (both is not None and all(HOLDS[f.op](x, f.value) for f in both))
            assert any(HOLDS[f.op](x, f.value) for f in fs) == any(HOLDS[f.op](x, f.value) for f in either)
        assert both is None or len(both) <= 2


def test_operand_order_counts():
    assert Comparison.of(5, ">", "a") == Comparison("a", "<", 5)


def test_partial_aggregation(spark):
    df = spark.createDataFrame([(k, v) for k in "ab" for v in (1, 2, None, 4)], "k string, v int")
    aggs = [Aggregate("avg", "v", "m"), Aggregate("count", "*", "n"), Aggregate("count", "v", "c"), Aggregate("sum", "v", "s"), Aggregate("min", "v", "lo"), Aggregate("max", "v", "hi")]
    parts = partial(df.where("v < 3 or v is null"), ["k"], aggs).union(partial(df.where("v >= 3"), ["k"], aggs))
    assert sorted(map(tuple, final(parts, ["k"], aggs).collect())) == [(k, 7 / 3, 4, 3, 7, 1, 4) for k in "ab"]
    for bad in ([Aggregate("stddev", "v", "x")], [Aggregate("count", "v", "x", True)], [Aggregate("count", "v", "x", True), Aggregate("sum", "k", "y", True)]):
        with pytest.raises(AnalysisError):
            partial(df, ["k"], bad)


def test_sql_text():
    t = Aliased(Table("t", "s"), "a")
    q = Select(((Col("x", "a"), None), (Call("count", ()), "n")), Join(t, Table('o"dd'), "LEFT", Call("=", (Col("x", "a"), Col("y")))), Call("AND", (Call("IN", (Col("z"), Lit("it's"), Lit(None))), Call("BETWEEN", (Col("d"), Lit(date(2020, 1, 2)), Lit(Decimal("1.50")))))), (Col("x", "a"),), Call(">", (Call("count", ()), Lit(1))), ((Col("n"), False),), 5, True)
    assert q.sql() == 'SELECT DISTINCT "a"."x", COUNT(*) AS "n" FROM "s"."t" AS "a" LEFT JOIN "o""dd" ON ("a"."x" = "y") WHERE (("z" IN (\'it\'\'s\', NULL)) AND ("d" BETWEEN DATE \'2020-01-02\' AND 1.50)) GROUP BY "a"."x" HAVING (COUNT(*) > 1) ORDER BY "n" DESC LIMIT 5'
    assert SetOp(Select((), Table("a")), Select((), Table("b")), "EXCEPT").sql() == 'SELECT * FROM "a" EXCEPT SELECT * FROM "b"'
    assert SetOp(Select((), Table("a"), limit=1), Select((), Table("b"))).sql() == '(SELECT * FROM "a" LIMIT 1) UNION ALL SELECT * FROM "b"'
    assert Call("CAST", (Col("x"),), type=DecimalType(5, 2)).sql() == 'CAST("x" AS DECIMAL(5,2))' and Call("CASE", (Call("IS NULL", (Col("x"),)), Lit(1), Lit(True))).sql() == 'CASE WHEN ("x" IS NULL) THEN 1 ELSE TRUE END'
    with pytest.raises(AnalysisError):
        Call("CAST", (Col("x"),), type=ArrayType(IntegerType())).sql()


def test_generated_sql_runs_on_duckdb():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.sql("CREATE TABLE t AS SELECT range AS x, range % 3 AS g FROM range(10)")
    q = Select(((Col("g"), None), (Call("sum", (Col("x"),)), "s")), Select((), Table("t"), Call(">", (Col("x"), Lit(2)))), group=(Col("g"),), order=((Col("g"), True),))
    assert c.sql(q.sql().replace("FROM (SELECT * FROM \"t\" WHERE (\"x\" > 2))", "FROM (SELECT * FROM \"t\" WHERE (\"x\" > 2)) AS q")).fetchall() == [(0, 18), (1, 11), (2, 13)]


def test_statistics(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, 5.0), (None, 1.0)], "a int, b double")
    assert abs(spearman(df, "a", "b").first().rho + 0.8660254) < 1e-6
    assert drift([1, 2, 3, 4]) == 1 and drift([2, 2, 2]) == 0 and abs(drift([3, 1, 2])) <= 1


def test_tree_view(spark):
    df = spark.createDataFrame([(1, None, "r&d"), (2, 1, "x"), (3, 1, "y")], "id int, up int, name string")
    nodes = tree(df, "id", "up", "name")
    assert html(nodes) == "<ul><li>r&amp;d<ul><li>x</li><li>y</li></ul></li></ul>"
    with pytest.raises(AnalysisError):
        tree(df, "id", "up", "name", most=2)


def test_streaming_conversion(spark, tmp_path):
    from arbordf.streaming.currency import convert_stream

    spark.createDataFrame([(1.5, "A", "B", "2020-03-01 10:00:00")], "amount double, f string, t string, at string").selectExpr("amount", "f", "t", "timestamp(at) AS at").write.parquet(str(tmp_path / "in"))
    rates = spark.createDataFrame([("A", "B", "2020-01-01", 2.0)], "f string, t string, d string, r double")
    stream = spark.readStream.schema("amount double, f string, t string, at timestamp").parquet(str(tmp_path / "in"))
    q = convert_stream(stream, "amount", "f", "t", "at", rates).writeStream.format("memory").queryName("converted_rows").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert float(spark.table("converted_rows").first().converted) == 3.0


def test_source_filters_split_rename_and_compile(spark):
    """Every condition, whole or in two parts, keeps the rows that Spark keeps."""
    import itertools

    from arbordf.plans import filters as X
    from arbordf.plans.sqlgen import Call, Col, Lit

    a, b, s = Col("a"), Col("b"), Col("s")
    simple = [Call("=", (a, Lit(1))), Call("<>", (a, b)), Call("<", (b, Lit(2))), Call("IN", (a, Lit(1), Lit(None))), Call("BETWEEN", (b, Lit(0), Lit(1))), Call("IS NULL", (a,)), Call("IS NOT NULL", (s,)), Call("LIKE", (s, Lit("x%"))), Call(">=", (s, Lit("xy")))]
    whole = [*simple, *(Call("NOT", (c,)) for c in simple), *(Call(op, pair) for op in ("AND", "OR") for pair in itertools.combinations(simple, 2)), Call("NOT", (Call("OR", (simple[1], Call("AND", (simple[0], simple[7])))),))]
    values = [(x, y, z) for x in (None, 0, 1) for y in (None, 1, 3) for z in (None, "x", "xyz", "q")]
    df = spark.createDataFrame(values, "a int, b int, s string").coalesce(1).cache()
    for c in whole:
        want = {tuple(r) for r in df.where(c.sql().replace('"', "`")).collect()}
        keep = X.compiled(c)
        rows = [dict(zip("abs", v)) for v in values]
        assert {tuple(r.values()) for r in rows if keep(r)} == want, c.sql()
        rest, own = X.split(c, {"a"})
        parts = [X.compiled(p) for p in (rest, own) if p is not None]
        assert {tuple(r.values()) for r in rows if all(p(r) for p in parts)} == want
        assert own is None or X.columns(own) <= {"a"}
        moved = X.renamed(c, {"a": "z"})
        assert "a" not in X.columns(moved) and {tuple(r.values()) for r in rows if X.compiled(moved)(r | {"z": r["a"]})} == want
