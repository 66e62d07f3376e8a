import random
import sqlite3

import pytest

from arbordf.plans import pushdown
from arbordf.plans.pushdown import Unsupported, sql_of
from arbordf.session import AnalyticsSession
from arbordf.sources.providers import MemoryProvider, register_provider

ROWS = [(i, f"n{i % 7}", None if i % 11 == 0 else round((i * 37 % 101) / 4, 2), i % 5) for i in range(200)]
GROUPS = [(0, "zero"), (1, "O'ne"), (2, None), (3, "three"), (9, "nine")]


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    """The same tables in one file, in three shards, and in Spark."""
    folder = tmp_path_factory.mktemp("db")

    def write(name, items, groups):
        con = sqlite3.connect(folder / name)
        con.execute("CREATE TABLE items (id INTEGER, name TEXT, price REAL, grp INTEGER)")
        con.execute("CREATE TABLE groups (g INTEGER, label TEXT)")
        con.executemany("INSERT INTO items VALUES (?, ?, ?, ?)", items)
        con.executemany("INSERT INTO groups VALUES (?, ?)", groups)
        con.commit()
        con.close()
        return str(folder / name)

    r = random.Random(1)
    one = write("one.db", ROWS, GROUPS)
    deal = {i: r.randrange(3) for i, *_ in ROWS}
    many = ",".join(write(f"s{k}.db", [x for x in ROWS if deal[x[0]] == k], [x for x in GROUPS if x[0] % 3 == k]) for k in range(3))
    plain = spark.createDataFrame(ROWS, "id long, name string, price double, grp long"), spark.createDataFrame(GROUPS, "g long, label string")
    out = {}
    for kind, opts in (("one", one), ("many", many)):
        s = AnalyticsSession(spark)
        s.sql(f"REGISTER ALL TABLES USING sqlite OPTIONS (database '{opts}')")
        out[kind] = s
    s = AnalyticsSession(spark)
    for n, df in zip(("items", "groups"), plain):
        s.register(n, df)
    return out | {"spark": s}


WHOLE = [
    "SELECT id, name FROM items WHERE price > 5 AND name <> 'n3' AND id BETWEEN 20 AND 90",
    "SELECT * FROM items WHERE name LIKE 'n%' AND price IS NULL",
    "SELECT id + 2 * grp AS a, -price AS m, CASE WHEN grp = 1 THEN 'one' WHEN grp IN (2, 3) THEN name END AS c, coalesce(price, 0.5) AS p FROM items",
    "SELECT name, count(*) AS n, count(price) AS k, sum(id) AS s, avg(price) AS a, min(name) AS lo, max(price) AS hi FROM items GROUP BY name",
    "SELECT count(DISTINCT name) AS n, avg(id) AS a FROM items",
    "SELECT label, sum(price) AS total FROM items JOIN groups ON grp = g WHERE id > 3 GROUP BY label HAVING count(*) > 2",
    "SELECT a.id, b.id AS other FROM items a JOIN items b ON a.id = b.grp AND b.price > 20",
    "SELECT g, label, name FROM groups LEFT JOIN items ON g = grp AND id < 12",
    "SELECT id, price FROM items ORDER BY price DESC, id LIMIT 7",
    "SELECT q.name, q.n FROM (SELECT name, count(*) AS n FROM items GROUP BY name) AS q WHERE q.n > 28 ORDER BY name",
    "SELECT grp AS k FROM items UNION ALL SELECT g FROM groups WHERE g > 1",
    "SELECT grp AS k FROM items UNION SELECT g FROM groups",
    "SELECT DISTINCT name, grp FROM items WHERE id % 3 = 1",
    "SELECT label FROM groups WHERE label = 'O''ne'",
    "SELECT id FROM items WHERE id > 3 AND 50 >= id AND id >= 10 AND id < 60 AND grp = 1 AND grp >= 1 AND name <> 'n1'",
    "SELECT id FROM items WHERE id > 30 AND id < 20",
    "WITH big AS (SELECT * FROM items WHERE price >= 20) SELECT count(*) AS n FROM big",
]


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sql", WHOLE)
def test_whole_queries_run_at_the_source(sources, sql):
    want = sources["spark"].sql(sql)
    got = sources["one"].sql(sql)
    assert got.columns == want.columns and got.dtypes == want.dtypes and rows(got) == rows(want)
    assert not any(x in plan(got) for x in ("HashAggregate", "Join", "Filter", "Sort ", "TakeOrdered"))
    if "LIMIT" in sql:
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


@pytest.mark.parametrize("sql", WHOLE)
def test_shards_give_the_same(sources, sql):
    assert rows(sources["many"].sql(sql)) == rows(sources["spark"].sql(sql))


def test_shards_do_rows_and_first_steps(sources):
    s = sources["many"]
    by_row = plan(s.sql(WHOLE[0]))
    assert "Filter" not in by_row and by_row.count("MapInArrow") == 1
    steps = plan(s.sql(WHOLE[3]))
    assert "a4_sum" in steps and "a4_count" in steps  # sums and counts come from the shards
    assert "a0_sum" not in plan(s.sql(WHOLE[4]))  # a distinct count needs its rows together


def test_what_has_no_sql_stays_with_spark(sources, spark):
    s = sources["one"]
    for sql in ("SELECT upper(name) AS u FROM items", "SELECT id, row_number() OVER (ORDER BY id) AS r FROM items WHERE id < 5", "SELECT id / grp AS q FROM items WHERE grp > 0", "SELECT g FROM groups FULL JOIN items ON g = id", "SELECT name FROM items ORDER BY price NULLS LAST, id LIMIT 3"):
        assert rows(s.sql(sql)) == rows(sources["spark"].sql(sql))
    with pytest.raises(Unsupported):
        sql_of(spark.range(3))
    register_provider("beside", MemoryProvider({"plain"}, {"kept": spark.createDataFrame(GROUPS, "g long, label string")}))
    s.sql("REGISTER TABLE kept USING beside")
    mixed = s.sql("SELECT count(*) AS n FROM items JOIN kept ON items.grp = kept.g")
    assert mixed.first().n == sum(x[3] in (0, 1, 2, 3, 9) for x in ROWS)


def test_annotations_and_describe_survive(sources):
    df = sources["one"].sql("SELECT name @(k = 'v'), id FROM items WHERE id < 3")
    assert df.schema["name"].metadata == {"k": "v"} and df.schema["id"].metadata == {}
    assert sources["one"].sql("SELECT COLUMN_NAME, ANNOTATION_KEY FROM describe_table(SELECT name FROM items)").collect()[0][1] is None


def test_raw_sql_and_listing(sources, tmp_path):
    s = sources["one"]
    path = s.registry.get("items").options["database"]
    got = s.sql(f"``SELECT name, group_concat(id) AS ids FROM items WHERE id < 15 GROUP BY name`` USING sqlite OPTIONS (database '{path}') AS (name STRING, ids STRING)")
    assert got.count() == 7 and got.dtypes == [("name", "string"), ("ids", "string")]
    assert {r.TABLE_NAME for r in s.sql(f"SHOW TABLES USING sqlite OPTIONS (database '{path}')").collect()} == {"items", "groups"}


def test_nothing_is_looked_at_without_sources(spark, monkeypatch):
    monkeypatch.setattr(pushdown, "SOURCES", {})
    assert pushdown.pushed(spark.range(3)) is None


def test_pushed_filters_are_reduced(sources):
    from arbordf.plans.frontend import Query

    s = sources["one"]
    text = sql_of(Query(s, "SELECT id FROM items WHERE id > 3 AND 50 >= id AND id >= 10 AND id < 60").run())
    where = text[text.index("WHERE") :]
    assert ">= 10" in where and "<= 50" in where and "> 3" not in where and "< 60" not in where
    assert "(1 = 0)" in sql_of(Query(s, "SELECT id FROM items WHERE id > 30 AND id < 20").run())
