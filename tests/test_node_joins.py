import hashlib
import itertools
import re

import pytest
from pyspark.sql import functions as F

from arbordf.errors import AnalysisError
from arbordf.functions import nodes as N
from arbordf.operators import node_joins, tables
from arbordf.operators.hierarchy import hierarchy
from arbordf.operators.node_joins import node_join, rank_counts
from arbordf.session import AnalyticsSession

EDGES = [("a", None), ("b", "a"), ("c", "a"), ("d", "b"), ("e", "b"), ("f", "e"), ("g", "c"), ("x", None), ("y", "x")]
KINDS = ("inner", "left", "right", "full", "left_semi", "left_anti")
SQL_JOIN = {"inner": "JOIN", "left": "LEFT OUTER JOIN", "right": "RIGHT JOIN", "left_semi": "LEFT SEMI JOIN", "left_anti": "LEFT ANTI JOIN"}


@pytest.fixture(scope="module")
def sides(spark):
    """Left rows repeat, either side has rows without a node and nodes the other lacks."""
    h = hierarchy(spark.createDataFrame(EDGES, "k string, up string"), "up", "k", order=["k"])
    more = spark.createDataFrame([("b", 1), ("c", 2), ("c", 2), ("d", 3), ("f", 4), ("g", 5), ("g", 5), ("y", 6), ("none", 7)], "lk string, n int")
    left = more.join(h.select("k", F.col("node").alias("ln")), F.col("lk") == F.col("k"), "left").drop("k")
    right = spark.createDataFrame([("a", 10), ("b", 20), ("e", 30), ("e", 30), ("g", 40), ("x", 50), ("zero", 60)], "rk string, m int")
    right = right.join(h.select("k", F.col("node").alias("rn")), F.col("rk") == F.col("k"), "left").drop("k")
    return left.cache(), right.cache()


def plain(left, right, predicate, how):
    """The join by a theta condition, which Spark pairs row by row."""
    return left.join(right, N.call(predicate, F.col("ln"), F.col("rn")), how)


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns) if c not in ("ln", "rn")) for r in df.collect()), key=str)


@pytest.mark.parametrize("predicate", sorted(N.BINARY))
def test_all_kinds_equal_the_theta_join(spark, sides, predicate):
    AnalyticsSession(spark)  # registers the node functions
    for how in KINDS:
        out = node_join(sides[0], "ln", sides[1], "rn", predicate, how)
        want = plain(*sides, predicate, how)
        assert out.columns == want.columns
        assert rows(out) == rows(want), (predicate, how)


@pytest.mark.parametrize("predicate", sorted(N.BINARY))
def test_sql_equals_the_theta_join(spark, sides, predicate):
    s = AnalyticsSession(spark)
    s.register("nl", sides[0])
    s.register("nr", sides[1])
    for how, words in SQL_JOIN.items():
        one = how in ("left_semi", "left_anti")
        out = s.sql(f"SELECT l.lk, l.n{'' if one else ', r.rk, r.m'} FROM nl AS l {words} nr r ON {predicate.upper()}(l.ln, r.rn) AND l.n < 7")
        want = sides[0].join(sides[1], N.call(predicate, F.col("ln"), F.col("rn")) & (F.col("n") < 7), how)
        assert rows(out) == rows(want.drop("ln", "rn")), (predicate, how)
        stars = s.sql(f"SELECT * FROM nl AS l {words} nr r ON {predicate}(l.ln, r.rn) AND l.n < 7")
        assert rows(stars) == rows(out) and not [c for c in stars.columns if c.startswith("__")]
    where = s.sql(f"SELECT l.*, r.m, 1 AS one FROM nl l, nr r WHERE l.n > 0 AND ({predicate}(l.ln, r.rn)) ORDER BY n")
    assert rows(where.drop("one")) == rows(plain(*sides, predicate, "inner").drop("rk"))
    flipped = s.sql(f"SELECT l.lk, l.n, r.rk, r.m FROM nl l JOIN nr r ON {predicate}(r.rn, l.ln)")
    assert rows(flipped) == rows(sides[0].join(sides[1], N.call(predicate, F.col("rn"), F.col("ln"))))


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_plan_pairs_all_rows(spark, sides):
    s = AnalyticsSession(spark)
    s.register("nl", sides[0])
    s.register("nr", sides[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for predicate in sorted(set(N.BINARY) - {"is_following", "is_preceding"}):
            plans = [node_join(sides[0], "ln", sides[1], "rn", predicate, how) for how in KINDS]
            plans += [s.sql(f"SELECT l.n FROM nl l {words} nr r ON {predicate}(l.ln, r.rn)") for words in SQL_JOIN.values() if words[:5] != "RIGHT"]
            plans += [s.sql(f"SELECT r.m FROM nl l RIGHT JOIN nr r ON {predicate}(l.ln, r.rn)"), s.sql(f"SELECT l.n FROM nl l, nr r WHERE {predicate}(l.ln, r.rn)")]
            for p in map(physical, plans):
                assert "Cartesian" not in p and "NestedLoop" not in p, (predicate, p)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_either_of_several_predicates_meets_on_keys(spark, sides):
    s = AnalyticsSession(spark)
    s.register("nl", sides[0])
    s.register("nr", sides[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for p, q in (("is_sibling", "is_child"), ("is_ancestor", "is_self")):
            for how, words in SQL_JOIN.items():
                want = rows(sides[0].join(sides[1], N.call(p, F.col("ln"), F.col("rn")) | N.call(q, F.col("rn"), F.col("ln")) & (F.col("n") < 6), how).drop("ln", "rn"))
                got = s.sql(f"SELECT * FROM nl AS l {words} nr r ON ({p}(l.ln, r.rn) OR (l.n < 6 AND {q}(r.rn, l.ln)))")
                assert rows(got) == want, (p, q, how)
                plan = physical(got)
                assert "Cartesian" not in plan and "NestedLoop" not in plan, (p, q, how)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_that_repeat_a_node_are_not_multiplied_by_prefixes(spark, sides):
    s = AnalyticsSession(spark)
    s.register("nl", sides[0])
    s.register("nr", sides[1])
    plans = [s.sql(f"SELECT l.n, r.m FROM nl l {words} nr r ON is_ancestor(r.rn, l.ln)") for words in ("JOIN", "RIGHT JOIN", "LEFT JOIN")]
    plans += [node_join(sides[0], "ln", sides[1], "rn", "is_descendant", how).select("n", "m") for how in ("inner", "left", "right")]
    for plan in plans:
        lines = plan._jdf.queryExecution().optimizedPlan().toString().splitlines()
        at = [i for i, x in enumerate(lines) if "Generate explode" in x and "slice(" in x]
        assert at and all(any("Aggregate" in x for x in lines[i + 1 : i + 3]) for i in at), "\n".join(lines)
        joins = [x for x in lines if "Join " in x]
        assert joins and not any(".path" in x for x in joins)


def test_nodes_with_many_below_are_dealt_to_several_tasks(spark, sides, monkeypatch):
    monkeypatch.setattr(node_joins, "HEAVY", 1)
    s = AnalyticsSession(spark)
    s.register("nl", sides[0])
    s.register("nr", sides[1])
    for predicate in ("is_descendant", "is_ancestor_or_self"):
        for how in KINDS:
            assert rows(node_join(sides[0], "ln", sides[1], "rn", predicate, how)) == rows(plain(*sides, predicate, how)), (predicate, how)
        for how in ("left", "right"):
            assert rows(s.sql(f"SELECT * FROM nl l {SQL_JOIN[how]} nr r ON {predicate}(l.ln, r.rn)")) == rows(plain(*sides, predicate, how).drop("ln", "rn")), (predicate, how)


def test_keys_of_a_large_hierarchy_are_dealt_to_more_tasks(spark, sides, monkeypatch):
    """By the path elements of all its nodes, 21 here, and in no more than the session's 4 where those do."""
    s = AnalyticsSession(spark)
    s.register("nl", sides[0])
    s.register("nr", sides[1])
    dealt = lambda df: re.findall(r"RepartitionByExpression \[[^\]]*\], (\d+)", df._jdf.queryExecution().optimizedPlan().toString())
    text = "SELECT l.n, r.m FROM nl l JOIN nr r ON {}(l.ln, r.rn)"
    assert not dealt(node_join(sides[0], "ln", sides[1], "rn", "is_descendant")) and not dealt(s.sql(text.format("is_ancestor")))
    monkeypatch.setattr(tables, "CELLS", 2)
    for predicate in ("is_descendant", "is_descendant_or_self", "is_ancestor", "is_ancestor_or_self"):
        outs = [node_join(sides[0], "ln", sides[1], "rn", predicate, how) for how in KINDS]
        either = s.sql(text.format(f"is_child(r.rn, l.ln) OR {predicate}"))
        assert all(set(dealt(x)) == {"11"} for x in (*outs, either, s.sql(text.format(predicate)))), predicate
    for predicate in ("is_descendant", "is_ancestor_or_self"):
        want = rows(plain(*sides, predicate, "inner").select("n", "m"))
        assert rows(node_join(sides[0], "ln", sides[1], "rn", predicate).select("n", "m")) == want == rows(s.sql(text.format(predicate)))


def test_rows_of_a_large_hierarchy_meet_in_more_tasks(spark, sides, monkeypatch):
    """Both sides of both joins; rows without a node, which an outer join keeps, are not dealt by their key."""
    s = AnalyticsSession(spark)
    s.register("nl", sides[0])
    s.register("nr", sides[1])
    monkeypatch.setattr(tables, "CELLS", 2)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    got = s.sql("SELECT name(r.rn) AS a, l.n, r.m FROM nl l JOIN nr r ON is_ancestor(r.rn, l.ln)")
    for df in (got, node_join(sides[0], "ln", sides[1], "rn", "is_descendant")):
        assert plan(df).count("RepartitionByExpression") == 4
    assert plan(s.sql("SELECT l.n, r.m FROM nl l LEFT JOIN nr r ON is_ancestor(r.rn, l.ln)")).count("RepartitionByExpression") == 2
    assert rows(got.select("n", "m")) == rows(plain(*sides, "is_descendant", "inner").select("n", "m"))


def test_keys_of_paths_differ_and_are_those_of_prefixes(spark):
    odd = [[], [""], ["", ""], ["a"], ["a", "b"], ["a\x01b"], ["a", "\x01"], ["\x01", "a"], ["a", None, "c"], [None, "a"], ["\x02"], ["\x02", "1:a"], ["\x021:a"], ["1:a"], ["-", "a"]]
    df = spark.createDataFrame([(p,) for p in odd], "path array<string>").selectExpr("path", "named_struct('path', path) AS node")
    got = {tuple(r.path): (r.k, r.up) for r in df.selectExpr("path", f"{node_joins.digest_sql('node')} AS k", f"{node_joins._prefix_digests('path', False)} AS up").collect()}
    assert len({bytes(k) for k, _ in got.values()}) == len(odd)
    assert all(not p and not up or up[-1] == k for p, (k, up) in got.items())
    assert all(up[n - 1] == got[p[:n]][0] for p, (_, up) in got.items() for n in range(1, len(p)) if p[:n] in got)
    # a plain path's key takes no function of its elements
    assert got["a", "b"][0] == hashlib.sha256(b"a\x01b").digest()


def test_a_predicate_inside_a_case_is_no_demand(spark, sides):
    s = AnalyticsSession(spark)
    s.register("nl", sides[0])
    s.register("nr", sides[1])
    got = s.sql("SELECT l.n, r.m FROM nl l JOIN nr r ON CASE WHEN l.n > 2 AND is_self(l.ln, r.rn) AND r.m > 0 THEN false ELSE true END")
    cond = (F.col("n") > 2) & N.call("is_self", F.col("ln"), F.col("rn")) & (F.col("m") > 0)
    assert rows(got) == rows(sides[0].join(sides[1], F.when(cond, False).otherwise(True)).select("n", "m"))


def test_three_relations_and_a_disjunction(spark, sides):
    s = AnalyticsSession(spark)
    s.register("nl", sides[0])
    s.register("nr", sides[1])
    got = s.sql("SELECT a.n, b.m, c.n AS n2 FROM nl a JOIN nr b ON is_descendant(a.ln, b.rn) LEFT JOIN nl c ON is_descendant(c.ln, b.rn) AND c.n BETWEEN 3 AND 5")
    left, right = sides
    want = left.join(right, N.call("is_descendant", F.col("ln"), F.col("rn"))).join(left.toDF("lk2", "n2", "ln2"), N.call("is_descendant", F.col("ln2"), F.col("rn")) & F.col("n2").between(3, 5), "left").select("n", "m", "n2")
    assert rows(got) == rows(want)
    either = s.sql("SELECT a.n, b.m FROM nl a JOIN nr b ON is_self(a.ln, b.rn) OR is_child(a.ln, b.rn)")
    assert rows(either) == rows(left.join(right, N.call("is_self", F.col("ln"), F.col("rn")) | N.call("is_child", F.col("ln"), F.col("rn"))).select("n", "m"))


def test_a_hierarchy_in_the_query_joined_with_itself(spark):
    s = AnalyticsSession(spark)
    s.register("staff_edges", spark.createDataFrame(EDGES, "k string, up string"))
    h = "HIERARCHY (USING staff_edges AS v JOIN PRIOR u ON v.up = u.k ORDER SIBLINGS BY k START WHERE up IS NULL SET node)"
    got = s.sql(f"SELECT A.k AS x, B.k AS y FROM (SELECT k, node FROM {h} AS H) A, (SELECT k, node FROM {h} AS H) B WHERE IS_CHILD(A.node, B.node)")
    assert {tuple(r) for r in got.collect()} == {e for e in EDGES if e[1]}
    below = {tuple(r) for r in s.sql(f"SELECT A.k, B.k FROM {h} AS A JOIN {h} AS B ON IS_DESCENDANT(A.node, B.node)").collect()}
    up = dict(EDGES)
    want = set()
    for k in up:
        p = up[k]
        while p:
            want.add((k, p))
            p = up[p]
    assert below == want


def test_rank_counts_equal_pair_counts(spark):
    AnalyticsSession(spark)
    h = hierarchy(spark.createDataFrame(EDGES, "k string, up string"), "up", "k", order=["k"])
    got = {r.k: (r.n_following, r.n_preceding) for r in rank_counts(h).collect()}
    other = h.select(F.col("k").alias("k2"), F.col("node").alias("n2"))
    for i, p in enumerate(("is_following", "is_preceding")):
        same_tree = F.col("node")["path"][0] == F.col("n2")["path"][0]
        want = {r.k2: r.n for r in h.join(other, N.call(p, F.col("node"), F.col("n2")) & same_tree).groupBy("k2").agg(F.count("*").alias("n")).collect()}
        assert {k: v[i] for k, v in got.items()} == {k: want.get(k, 0) for k in got}


def test_clashing_names_raise(spark, sides):
    with pytest.raises(AnalysisError):
        node_join(sides[0], "ln", sides[0], "ln", "is_self")
