import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from arbordf.errors import AnalysisError, EngineError, ParseError
from arbordf.plans.lexer import statements
from arbordf.session import AnalyticsSession
from arbordf.sources import providers

H = "HIERARCHY (USING animals AS v JOIN PRIOR u ON v.pred = u.succ ORDER SIBLINGS BY ord START WHERE pred IS NULL SET node) AS H"


@pytest.fixture
def s(spark):
    providers.register_provider("memory", providers.MemoryProvider())
    spark.createDataFrame([("a", None, 1, 1), ("b", 1, 2, 1), ("c", 1, 3, 2), ("d", 2, 4, 1)], "name string, pred long, succ long, ord int").createOrReplaceTempView("animals")
    return AnalyticsSession(spark)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_hierarchy_in_sql(s):
    assert rows(s.sql(f"SELECT name, level(node), pre_rank(H.node) FROM {H} ORDER BY 3")) == [("a", 1, 1), ("b", 2, 2), ("d", 3, 3), ("c", 2, 4)]
    assert s.sql(f"SELECT * FROM {H}").columns == ["name", "pred", "succ", "ord"]
    assert s.sql(f"SELECT *, node FROM {H}").columns[-1] == "node"
    assert s.sql(f"SELECT H.* FROM {H}, (SELECT 1 AS one) AS q").columns == ["name", "pred", "succ", "ord"]
    flipped = H.replace("v.pred = u.succ", "u.succ = v.pred")
    assert rows(s.sql(f"SELECT max(level(node)) FROM {flipped}")) == [(3,)]
    assert rows(s.sql("SELECT name(node) FROM HIERARCHY (USING (SELECT 'r' AS a, 'x' AS b) AS q WITH LEVELS (a, b) MATCH PATH SET node) AS L ORDER BY 1")) == [("r",), ("x",)]


@pytest.mark.parametrize("bad", [H.replace(" AS H", ""), H.replace("v.pred = u.succ", "v.pred < u.succ"), H.replace("v.pred = u.succ", "v.name = u.succ"), H.replace("v.pred = u.succ", "v.pred = v.succ"), "HIERARCHY (USING animals AS v WITH LEVELS (name) MATCH NAME SET node) AS H"])
def test_hierarchy_errors(s, bad):
    with pytest.raises(EngineError):
        s.sql(f"SELECT name FROM {bad}")


def test_mixed_hierarchies(s):
    other = H.replace("ORDER SIBLINGS BY ord", "ORDER SIBLINGS BY succ").replace("AS H", "AS G")
    with pytest.raises(AnalysisError, match="mixes"):
        s.sql(f"SELECT H.name FROM {H}, {other} WHERE is_child(H.node, G.node)")


def test_views_follow_their_bases(s, spark):
    s.sql("CREATE TEMPORARY VIEW v AS SELECT * FROM animals")
    s.sql("CREATE DIMENSION VIEW w AS SELECT name FROM v WHERE succ > 1")
    assert s.sql("SELECT * FROM w").count() == 3
    spark.createDataFrame([Row(name="n", succ=5, extra=1)]).createOrReplaceTempView("animals")
    assert s.sql("SELECT * FROM v").columns == ["name", "succ", "extra"] and rows(s.sql("SELECT * FROM w")) == [("n",)]
    with pytest.raises(AnalysisError, match="CASCADE"):
        s.sql("DROP VIEW v")
    with pytest.raises(AnalysisError, match="is a view"):
        s.sql("DROP TABLE w")
    with pytest.raises(AnalysisError, match="exists"):
        s.sql("CREATE VIEW w AS SELECT 1 AS x")
    with pytest.raises(AnalysisError, match="itself"):
        s.sql("CREATE VIEW loop AS SELECT * FROM loop")
    s.sql("DROP VIEW v CASCADE")
    assert rows(s.sql("SELECT count(*) FROM SYS.TABLES")) == [(0,)]
    s.sql("DROP VIEW IF EXISTS v")


def test_hierarchy_view_hides_its_node(s):
    s.sql(f"CREATE VIEW hv AS SELECT name, node FROM {H}")
    assert s.sql("SELECT * FROM hv").columns == ["name"]
    assert rows(s.sql("SELECT a.name FROM hv AS a, hv AS b WHERE is_parent(a.node, b.node) AND b.name = 'd'")) == [("b",)]


def test_stars_of_set_operations_and_strings(s):
    s.sql(f"CREATE VIEW hv AS SELECT name, node FROM {H}")
    assert rows(s.sql("SELECT * FROM hv AS a UNION SELECT b.* FROM hv AS b EXCEPT SELECT 'a' ORDER BY 1")) == [("b",), ("c",), ("d",)]
    assert rows(s.sql(r"""SELECT 'a\nb', "it's", 'x''y', regexp_replace('a1', '\\d', ''), {{q'q}}"""))[0] == ("a\nb", "it's", "x'y", "a", "q'q")
    assert rows(s.sql("SELECT name, row_number() OVER (PARTITION BY pred ORDER BY succ DESC) AS r FROM animals WHERE (succ > 1) AND (pred = 1) ORDER BY 2"))[0] == ("c", 1)


def meta(df, i=0):
    return dict(df.schema.fields[i].metadata)


def test_annotations(s):
    s.sql("CREATE VIEW t AS SELECT name @(foo = 'x', n = 3), succ AS k @(a.b = ('p', 'q'), z = null) FROM animals")
    assert meta(s.sql("SELECT name FROM t")) == {"foo": "x", "n": 3} and meta(s.sql("SELECT k AS other FROM t")) == {"a.b": "[p,q]", "z": None}
    assert meta(s.sql("SELECT name @(foo = 'y', d = 1.5) FROM t")) == {"foo": "y", "n": 3, "d": 1.5}
    assert meta(s.sql("SELECT name @(n = ?) FROM t")) == {"n": 3} and meta(s.sql("SELECT name @(* = ?) FROM t")) == {"foo": "x", "n": 3}
    assert meta(s.sql("SELECT name @(* = 'v') FROM t")) == {"foo": "v", "n": "v"}
    assert meta(s.sql("SELECT * @(all = 1) FROM t"), 1)["all"] == 1
    assert meta(s.sql("SELECT q.n FROM (SELECT name AS n @(in = 'b') FROM t) AS q")) == {"foo": "x", "n": 3, "in": "b"}
    union = s.sql("SELECT name @(left = 1) FROM t UNION SELECT name @(right = 1) FROM t")
    assert meta(union) == {"foo": "x", "n": 3, "left": 1}
    for bad in ("SELECT succ + 1 @(a = 1) FROM animals", "SELECT name @(a = 1, a = 2) FROM t", "SELECT name @(* = 1, a = 2) FROM t", "SELECT name @(a = @b.c) FROM t"):
        with pytest.raises(AnalysisError):
            s.sql(bad)


def test_describe(s):
    s.sql("CREATE VIEW t AS SELECT name AS label @(k = 'v'), succ FROM animals")
    got = rows(s.sql("SELECT COLUMN_NAME, ORIGINAL_COLUMN_NAME, ORDINAL_POSITION, DATA_TYPE, NUMERIC_PRECISION, ANNOTATION_KEY, ANNOTATION_VALUE FROM describe_table(SELECT label, succ, sum(ord) AS total FROM (SELECT label, succ, 1 AS ord FROM t) AS q GROUP BY label, succ) ORDER BY 3"))
    assert got[0] == ("label", "name", 1, "VARCHAR(*)", None, "k", "v") and got[1] == ("succ", "succ", 2, "BIGINT", 64, None, None)
    assert s.sql("SELECT * FROM describe_table_if_exists(SELECT * FROM nowhere)").count() == 0
    with pytest.raises(Exception):
        s.sql("SELECT * FROM describe_table(SELECT * FROM nowhere)")
    assert rows(s.sql(f"SELECT DATA_TYPE FROM describe_table(SELECT node FROM {H})")) == [("<INTERNAL>",)]


def test_tables_and_providers(s, spark, tmp_path):
    s.sql("CREATE TABLE t1 (a @(k = 'v') INT COMMENT 'c', b STRING) USING memory OPTIONS (x 'y')")
    s.sql("CREATE TABLE IF NOT EXISTS t1 (a INT) USING memory")
    assert s.sql("SELECT * FROM t1").schema.fields[0].metadata == {"k": "v", "comment": "c"}
    assert "t1 (a @(k" in rows(s.sql("DESCRIBE TABLE t1 USING memory"))[0][1] and rows(s.sql("DESCRIBE TABLE nope USING memory")) == [("", "")]
    for bad in ("CREATE TEMPORARY TABLE IF NOT EXISTS x (a INT) USING memory", "CREATE TABLE x (a INT, A STRING) USING memory", "CREATE TABLE x (select INT) USING memory", "CREATE TABLE t1 (a INT) USING memory", "CREATE TABLE x (a INT) USING memory AS SELECT 1 AS a", "CREATE TABLE x (a INT) USING no.such"):
        with pytest.raises(AnalysisError):
            s.sql(bad)
    s.sql("CREATE TABLE t2 USING memory AS SELECT name FROM animals")
    assert s.sql("SELECT * FROM t2").count() == 4
    spark.createDataFrame([("x",)], "name string").write.parquet(str(tmp_path / "more"))
    s.sql(f"APPEND TABLE t2 OPTIONS (files '{tmp_path}/more')")
    assert s.sql("SELECT * FROM t2").count() == 5
    assert ("t2", "FALSE", "TABLE") in rows(s.sql("SHOW TABLES USING memory"))
    fresh = AnalyticsSession(spark)
    fresh.sql("REGISTER TABLE t2 USING memory")
    with pytest.raises(AnalysisError):
        fresh.sql("REGISTER ALL TABLES USING memory")
    fresh.sql("REGISTER ALL TABLES IF NOT EXISTS USING memory")
    assert {r[0] for r in rows(fresh.sql("SELECT TABLE_NAME FROM SYS_TABLES"))} == {"t1", "t2"}
    s.sql("DROP TABLE t1")
    assert "t1" not in {r[0] for r in rows(s.sql("SHOW TABLES USING memory"))}


def test_tables_register_at_start(s, spark):
    s.sql("CREATE TABLE auto USING memory AS SELECT 1 AS x")
    spark.conf.set("spark.arbordf.autoregister", "memory")
    try:
        assert rows(AnalyticsSession(spark).sql("SELECT * FROM auto")) == [(1,)]
    finally:
        spark.conf.unset("spark.arbordf.autoregister")


def test_names_fold_unless_case_matters(s, spark):
    s.sql("CREATE VIEW Folded AS SELECT 1 AS x")
    assert rows(s.sql("SELECT * FROM fOLDED")) == [(1,)]
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        strict = AnalyticsSession(spark)
        strict.sql("CREATE VIEW a AS SELECT 1 AS x")
        strict.sql("CREATE VIEW A AS SELECT 2 AS x")
        assert rows(strict.sql("SELECT * FROM A")) == [(2,)]
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")


def test_persisted_views(s, spark):
    s.sql("CREATE CUBE VIEW c AS SELECT name FROM animals USING memory")
    assert ("c", "FALSE", "CUBE") in rows(s.sql("SHOW TABLES USING memory"))
    fresh = AnalyticsSession(spark)
    fresh.sql("REGISTER ALL TABLES USING memory")
    assert fresh.sql("SELECT * FROM c").count() == 4
    s.sql("DROP VIEW c")
    assert rows(s.sql("SHOW TABLES USING memory")) == []


def test_system_tables(s):
    s.sql("CREATE VIEW v AS SELECT name @(k = 'x'), succ FROM animals")
    s.sql("CREATE VIEW broken AS SELECT nothing FROM animals")
    assert {r[0] for r in rows(s.sql("SELECT TABLE_NAME FROM sys.schemas"))} == {"v"}
    assert rows(s.sql("SELECT COLUMN_NAME, ANNOTATION_VALUE FROM SYS.SCHEMAS WHERE ANNOTATION_KEY = 'k'")) == [("name", "x")]
    assert (None, "animals", "UNKNOWN", None, "v", "VIEW", 0) in rows(s.sql("SELECT * FROM SYS_OBJECT_DEPENDENCIES"))
    assert rows(s.sql("SELECT count(*) > 5 FROM SYS.SESSION_CONTEXT")) == [(True,)]
    assert ("v", None, None) in rows(s.sql("SELECT * FROM SYS.TABLE_METADATA")) and ("v", "v") in rows(s.sql("SELECT * FROM SYS.RELATION_SQL_NAME"))
    for bad in ("SELECT * FROM SYS.NOPE", "SELECT * FROM SYS.PARTITION_FUNCTIONS", "SELECT * FROM SYS.SESSION_CONTEXT USING memory"):
        with pytest.raises(AnalysisError):
            s.sql(bad)


def test_partition_functions(s):
    s.sql("CREATE PARTITION FUNCTION h (INT, STRING) AS HASH PARTITIONS 4 USING memory")
    s.sql("CREATE PARTITION FUNCTION r (INT) AS RANGE SPLITTERS RIGHT CLOSED (5, 10) USING memory")
    s.sql("CREATE PARTITION FUNCTION i (INT) AS RANGE START 0 END 10 PARTS 3 USING memory")
    assert [r[:4] for r in rows(s.sql("SHOW PARTITION FUNCTIONS USING memory"))] == [("h", "hash", "INT,STRING", None), ("i", "interval", "INT", None), ("r", "split", "INT", "5,10")]
    assert ("i", "RANGE", "C1", "INT", "4,8", None, 3, None, None) in rows(s.sql("SELECT * FROM SYS.PARTITION_FUNCTIONS USING memory"))
    s.sql("DROP PARTITION FUNCTION h USING memory")
    s.sql("DROP PARTITION FUNCTION IF EXISTS h USING memory")
    for bad in ("DROP PARTITION FUNCTION h USING memory", "CREATE PARTITION FUNCTION i (INT) AS HASH USING memory", "CREATE PARTITION FUNCTION z (INT, INT) AS RANGE START 0 END 1 PARTS 1 USING memory"):
        with pytest.raises(AnalysisError):
            s.sql(bad)
    from arbordf.sources.partitions import PartitionFunction

    df = s.spark.range(100).select("id")
    assert PartitionFunction("f", "split", ("BIGINT",), splitters=("10", "50")).apply(df, "id").rdd.getNumPartitions() == 3


def test_raw_sql_and_infer(s, spark, tmp_path):
    assert rows(s.sql("``SELECT 1 AS x`` USING memory")) == [(1,)]
    assert rows(s.sql("SELECT q.x + 1 FROM (``SELECT 1 AS x`` USING memory) AS q")) == [(2,)]
    spark.createDataFrame([("a", 1)], "name string, age int").write.orc(str(tmp_path / "p.orc"))
    assert rows(s.sql(f"INFER SCHEMA OF '{tmp_path}/p.orc'")) == [("name", 1, True, "VARCHAR(*)", None, None, None), ("age", 2, True, "INTEGER", 32, 2, 0)]
    with pytest.raises(AnalysisError):
        s.sql("INFER SCHEMA OF '/x/y.txt'")


def test_functions(s):
    got = rows(s.sql("SELECT replace('abc', 'b', NULL), replace(NULL, 'a', 'b'), to_varchar(3), to_integer('1.9'), to_integer('x'), to_double('2.5'), EXTRACT(SECOND FROM TIMESTAMP '2020-01-01 00:00:05.5'), days_between(DATE '2020-01-01', DATE '2020-01-05'), add_days(DATE '2020-01-31', 1), add_seconds(TIMESTAMP '2020-01-01 00:00:00', 61), mod(-7, 3), remainder(7, -3), {{brace's}}"))[0]
    assert got[:8] == ("ac", None, "3", 1, None, 2.5, 5, 4) and str(got[8]) == "2020-02-01" and got[9].minute == 1 and got[10:] == (-1, 1, "brace's")
    assert rows(s.sql("SELECT count(*), count(DISTINCT *), APPROXIMATE COUNT(DISTINCT name) FROM animals")) == [(4, 3, 4)]
    for bad in ("SELECT sum(*) FROM animals", "SELECT $f(name) FROM animals", "SELECT EXTRACT(WEEK FROM now())", "SELECT rand(1 + 1)", "SELECT convert_currency(1, 2, 3, 4, 5, 6)"):
        with pytest.raises(EngineError):
            s.sql(bad)


def test_cc_anywhere(s, spark):
    spark.sql("SELECT 'A' AS f, 'B' AS t, '2020-01-01' AS d, CAST(2 AS DECIMAL(20,6)) AS r").createOrReplaceTempView("cc_rates_t")
    spark.conf.set("spark.sql.currency.basic.table", "cc_rates_t")
    assert [int(r[0]) for r in rows(s.sql("SELECT cc(succ, 'A', 'B', '2021-01-01') + 1 AS v FROM animals WHERE cc(succ, 'A', 'B', '2021-01-01') > 4 ORDER BY 1"))] == [7, 9]


def test_emulation(s, spark):
    with pytest.raises(AnalysisError):
        s.sql("SHOW SCHEMAS")
    spark.conf.set("spark.arbordf.hive_emulation", "true")
    try:
        assert rows(s.sql("SHOW SCHEMAS")) == [("default",)] and s.sql("USE anything").count() == 0
        assert rows(s.sql("DESC animals"))[0][:2] == ("name", "string") and s.sql("DESCRIBE FORMATTED animals").count() == 8
    finally:
        spark.conf.unset("spark.arbordf.hive_emulation")


def test_engine_statements(s):
    good = {
        "create graph g using memory": "CREATE GRAPH g",
        "CREATE COLLECTION IF NOT EXISTS c PARTITION BY f (a, b) USING memory OPTIONS (k 'v')": "CREATE COLLECTION IF NOT EXISTS c PARTITION BY f (a, b)",
        "DROP GRAPH IF EXISTS g USING memory": "DROP GRAPH IF EXISTS g",
        "APPEND COLLECTION c OPTIONS (k 'v') USING memory": "APPEND COLLECTION c",
        "LOAD SERIES TABLE s USING memory": "LOAD SERIES TABLE s",
        "CREATE SERIES TABLE s (t TIME, v DOUBLE) SERIES (PERIOD FOR SERIES (t) MINVALUE 0 NO MAXVALUE NOT POPULATE MISSING VALUES NOT ALLOWED COMPRESSION ON v USE SDT ERROR 1 PERCENT) USING memory": "CREATE SERIES TABLE s (t TIMESTAMP, v DOUBLE) SERIES (PERIOD FOR SERIES (t) MINVALUE 0 NO MAXVALUE NOT POPULATE MISSING VALUES NOT ALLOWED COMPRESSION ON (v) USE SDT ERROR 1 PERCENT)",
        "CREATE PARTITION SCHEME ps USING f WITH COLOCATION USING memory": "CREATE PARTITION SCHEME ps USING f WITH COLOCATION",
    }
    for text, want in good.items():
        s.sql(text)
        assert providers.resolve("memory").statements[-1] == want
    for bad in ("CREATE GRAPH USING memory", "CREATE SERIES TABLE s (t TIME) USING memory", "CREATE SERIES TABLE s (t TIME) SERIES (PERIOD FOR SERIES (t) POPULATE POPULATE) USING memory", "CREATE SERIES TABLE s (t TIME) SERIES (PERIOD FOR SERIES (t) DEFAULT COMPRESSION USE ZIP) USING memory"):
        with pytest.raises((ParseError, AnalysisError)):
            s.sql(bad)


def test_parse_errors_have_a_place(s):
    with pytest.raises(ParseError) as e:
        s.sql("SELECT name\nFROM animals WHERE (succ")
    assert (e.value.line, e.value.column) == (2, 20)


def test_scripts_and_cli(s, spark, tmp_path):
    assert statements("SELECT ';' AS a; -- c;\n/* ; */ SELECT `;` FROM t;") == ["SELECT ';' AS a", "-- c;\n/* ; */ SELECT `;` FROM t"]
    from arbordf.cli import main

    (tmp_path / "q.sql").write_text("SELECT 1 AS a, 'x;y' AS b; SELECT NULL AS n")
    assert main(["-o", str(tmp_path / "out"), str(tmp_path / "q.sql")]) == 0
    assert (tmp_path / "out").read_text() == "1,x;y\n\n"


def test_deep_describe_and_insert(s, spark):
    s.sql("CREATE VIEW v AS SELECT name FROM animals")
    row = s.sql("DEEP DESCRIBE v").first()
    assert row.NAME == "v" and [f.name for f in row.FIELDS] == ["name"] and row.CHILDREN[0].name == "animals" and [f.type for f in row.CHILDREN[0].fields] == ["string", "bigint", "bigint", "int"]
    spark.sql("CREATE TABLE IF NOT EXISTS sink (name STRING) USING parquet")
    s.sql("INSERT OVERWRITE TABLE sink SELECT name FROM v")
    assert spark.table("sink").count() == 4
    spark.sql("DROP TABLE sink")


def test_table_functions_can_be_added(s):
    s.table_functions["ROW_COUNT"] = lambda df: df.groupBy().count()
    assert rows(s.sql("SELECT * FROM row_count(SELECT * FROM animals)")) == [(4,)]


def test_notebook_command(s):
    from arbordf.treeview import interpret

    assert interpret(s, "SELECT name, pred FROM animals WHERE succ < 3 ORDER BY succ", 1) == "<table><tr><th>name</th><th>pred</th></tr><tr><td>a</td><td></td></tr></table><p>first 1 rows</p>"
    tree = interpret(s, f"TREEVIEW succ pred name SELECT name, succ, pred FROM {H}")
    assert tree.startswith("<ul><li>a<ul>") and "<li>b<ul><li>d</li></ul></li>" in tree
    for bad in ("treeview succ pred name", "treeview succ SUCC name SELECT * FROM animals"):
        with pytest.raises(AnalysisError):
            interpret(s, bad)


def test_providers_say_which_tables_they_make(s):
    class Only(providers.MemoryProvider):
        table_kinds = frozenset({"temporary"})

    made = Only()
    providers.register_provider("only", made)
    s.sql("CREATE TEMPORARY TABLE short (a INT) USING only")
    assert made.made["short"] == "temporary"
    with pytest.raises(AnalysisError, match="persistent"):
        s.sql("CREATE TABLE long (a INT) USING only")
    assert ("short", "TRUE") in [(r[0], r[1]) for r in rows(s.sql("SELECT TABLE_NAME, IS_TEMPORARY FROM SYS.TABLES"))]


def test_system_tables_are_pruned_and_filtered(s, monkeypatch):
    from arbordf.plans import systables

    seen = []
    whole = systables.kept
    monkeypatch.setattr(systables, "kept", lambda rows, names, wanted, where: seen.append((wanted, out := whole(rows, names, wanted, where))) or out)
    for i in range(5):
        s.sql(f"CREATE VIEW v{i} AS SELECT name FROM animals")
    for sql, want, columns, n in [
        ("SELECT TABLE_NAME FROM SYS.TABLES WHERE TABLE_NAME IN ('v1', 'v2') AND KIND = 'VIEW' AND length(TABLE_NAME) > 1", [("v1",), ("v2",)], ["TABLE_NAME", "KIND"], 2),
        ("SELECT a.TABLE_NAME FROM SYS.TABLES AS a WHERE a.TABLE_NAME LIKE 'v%' AND NOT a.TABLE_NAME = 'v0' AND PROVIDER IS NULL", [(f"v{i}",) for i in range(1, 5)], ["TABLE_NAME", "PROVIDER"], 5),
        ("SELECT TABLE_NAME FROM SYS.TABLES WHERE TABLE_NAME = 'v1' OR TABLE_NAME = 'v3'", [("v1",), ("v3",)], ["TABLE_NAME"], 5),
        ("SELECT count(*) AS n FROM SYS.TABLES WHERE TABLE_NAME <> 'v1'", [(4,)], ["TABLE_NAME"], 4),
        ("SELECT * FROM SYS.TABLES WHERE TABLE_NAME = 'v2'", [("v2", "TRUE", "VIEW", None)], ["TABLE_NAME", "IS_TEMPORARY", "KIND", "PROVIDER"], 1),
        ("SELECT DEPENDENT_OBJECT_NAME FROM SYS.TABLES JOIN SYS.OBJECT_DEPENDENCIES ON TABLE_NAME = DEPENDENT_OBJECT_NAME WHERE TABLE_NAME = 'v4'", [("v4",)], None, None),
    ]:
        seen.clear()
        assert sorted(rows(s.sql(sql))) == want
        if columns:
            assert seen[0][0] == columns and len(seen[0][1]) == n


def test_providers_list_their_own_catalog(s):
    class Listing(providers.MemoryProvider):
        def catalog(self, table, columns, where, options):
            self.asked = table, columns, None if where is None else where.sql()
            return [tuple(f"{c} 1" for c in columns)] if table == "SCHEMAS" else None

    p = Listing()
    providers.register_provider("listing", p)
    got = s.sql("SELECT COLUMN_NAME, TABLE_NAME FROM SYS.SCHEMAS USING listing WHERE TABLE_NAME = 'TABLE_NAME 1'")
    assert rows(got) == [("COLUMN_NAME 1", "TABLE_NAME 1")] and p.asked == ("SCHEMAS", ["TABLE_NAME", "COLUMN_NAME"], "(\"TABLE_NAME\" = 'TABLE_NAME 1')")
    p.frames["kept"] = s.spark.range(1)
    assert rows(s.sql("SELECT TABLE_NAME FROM SYS.TABLES USING listing")) == [("kept",)]


def test_statements_leave_no_views_and_no_cache_behind(s, spark):
    kept = spark.range(10).cache()
    s.register("kept", kept)
    names = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("__arbordf")}
    before = names()
    out = s.sql("SELECT count(*) AS n FROM kept AS a JOIN (SELECT id @(k = 1) FROM kept) AS b ON a.id = b.id")
    assert names() == before and out.first().n == 10 and kept.storageLevel.useMemory
    with pytest.raises(Exception):
        s.sql("SELECT nothing FROM kept")
    assert names() == before
    other = AnalyticsSession(spark)
    other.register("kept", spark.range(3))
    assert out.first().n == 10 and other.sql("SELECT count(*) AS n FROM kept").first().n == 3
    kept.unpersist()


def test_sketches_beside_exact_counts_are_not_kept_per_value(spark):
    s = AnalyticsSession(spark)
    s.register("visits", spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") % 700).alias("who"), (F.col("id") % 11).alias("day")))
    both = s.sql("SELECT g, count(DISTINCT who) AS n, APPROXIMATE(0.02) COUNT(DISTINCT who) AS a, abs(APPROXIMATE COUNT(DISTINCT day)) AS d FROM visits GROUP BY g")
    plain = spark.range(3000).groupBy((F.col("id") % 3).alias("g")).agg(F.count_distinct(F.col("id") % 700).alias("n"), F.approx_count_distinct(F.col("id") % 700, 0.02).alias("a"), F.approx_count_distinct(F.col("id") % 11).alias("d"))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, plain.collect()))
    sketches = [x for x in both._jdf.queryExecution().sparkPlan().toString().splitlines() if "approx_count_distinct" in x]
    assert sketches and not any("who" in x.partition("functions=")[0] for x in sketches)
    alone = s.sql("SELECT APPROXIMATE COUNT(DISTINCT who) AS a FROM (SELECT who, count(DISTINCT day) AS n FROM visits GROUP BY who) AS q")
    assert "approx_count_distinct(distinct" not in alone._jdf.queryExecution().executedPlan().toString()
    assert s.sql("SELECT g, APPROXIMATE COUNT(DISTINCT who) OVER (PARTITION BY g) AS a, (SELECT count(DISTINCT day) FROM visits) AS n FROM visits").count() == 3000
