import random

import pytest
from pyspark.sql import functions as F

from arbordf.errors import AnalysisError
from arbordf.functions import nodes as N
from arbordf.operators.hierarchy import adjacency_nodes, hierarchy, level_hierarchy, ranked
from arbordf.operators.node_joins import node_join


def dfs(edges, roots):
    """Plain depth-first ranks: key -> (level, pre, post, leaf). edges: key -> ordered children."""
    out = {}
    for root in roots:
        pre, post, stack, seen = 0, 0, [(root, 1, False)], set()
        first = {}
        while stack:
            k, level, leave = stack.pop()
            if leave:
                post += 1
                out[k] = (level, first[k], post, not [c for c in edges.get(k, []) if c in first and first[c] > first[k]])
                continue
            if k in seen:
                continue
            seen.add(k)
            pre += 1
            first[k] = pre
            stack.append((k, level, True))
            stack += [(c, level + 1, False) for c in reversed(edges.get(k, []))]
    return out


def nodes(df, key="k"):
    return {r[key]: (r.level, r.preRank, r.postRank, r.isLeaf) for r in df.select(key, N.call("level", "node").alias("level"), "node.*").collect()}


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 5), (3, 3)])
def test_random_forests(spark, seed, parts):
    r = random.Random(seed)
    rows = [(i, None if i < 3 else r.randrange(max(0, i - 40), i), r.randint(0, 5)) for i in range(250)]
    order = lambda i: (-rows[i][2], i)
    edges = {}
    for i, p, _ in rows:
        if p is not None:
            edges.setdefault(p, []).append(i)
    for c in edges.values():
        c.sort(key=order)
    shuffled = list(rows)
    r.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "k long, p long, o int").repartition(parts)
    got = nodes(hierarchy(df, "p", "k", None, [F.desc("o"), F.col("k")]))
    assert got == dfs(edges, [0, 1, 2])
    by_ranges = {x.id: (x.preRank, x.postRank) for x in ranked(adjacency_nodes(df, "p", "k", None, [F.desc("o"), F.col("k")]).select("id", "root", "path", "opath"), window_nodes=3).collect()}
    assert by_ranges == {k: v[1:3] for k, v in got.items()}


def test_long_chain(spark):
    df = spark.range(400).select(F.col("id").alias("k"), F.when(F.col("id") > 0, F.col("id") - 1).alias("p"))
    got = nodes(hierarchy(df, "p", "k"))
    assert got[399] == (400, 400, 1, True) and got[0] == (1, 1, 400, False)


def test_cycles_orphans_and_no_roots(spark):
    df = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (7, 8), (8, 7), (9, 7)], "k long, p long")
    assert set(nodes(hierarchy(df, "p", "k", "k = 1"))) == {1, 2, 3}
    assert nodes(hierarchy(df, "p", "k")) == {}
    assert hierarchy(df.where("false"), "p", "k").count() == 0
    assert nodes(hierarchy(spark.createDataFrame([(1, 1)], "k long, p long"), "p", "k", "k = 1")) == {1: (1, 1, 1, True)}


def test_start_rows_are_no_children(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "k long, p long")
    assert nodes(hierarchy(df, "p", "k", "k in (1, 2)")) == {1: (1, 1, 1, True), 2: (1, 1, 2, False), 3: (2, 2, 1, True)}


def test_repeated_keys(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (2, 1, "c")], "k long, p long, x string")
    out = hierarchy(df, "p", "k", None, ["x"])
    assert out.count() == 3 and out.select("node").distinct().count() == 2
    with pytest.raises(AnalysisError):
        hierarchy(df, "p", "k", None, ["x"], strict=True)


def test_key_types(spark):
    df = spark.createDataFrame([("a", ""), ("b", "a")], "k string, p string")
    assert nodes(hierarchy(df, "p", "k", "p = ''"))["b"][0] == 2
    with pytest.raises(AnalysisError):
        hierarchy(spark.createDataFrame([([1], None)], "k array<int>, p array<int>"), "p", "k")


def test_levels(spark):
    rows = [("r", "a", "x", 1), ("r", "a", None, 2), ("r", "b", None, 3), ("s", None, None, 4), (None, None, None, 5), ("t", "a", "z", 6)]
    out = level_hierarchy(spark.createDataFrame(rows, "l1 string, l2 string, l3 string, v int"), ["l1", "l2", "l3"], ["v"]).collect()
    got = sorted(((r.l1, r.l2, r.l3, r.v, r.node.preRank, r.node.postRank, r.node.isLeaf) for r in out), key=str)
    want = [("r", None, None, None, 1, 4, False), ("r", "a", None, 2, 2, 2, False), ("r", "a", "x", 1, 3, 1, True), ("r", "b", None, 3, 4, 3, True), ("s", None, None, 4, 1, 1, True), ("t", None, None, None, 1, 3, False), ("t", "a", None, None, 2, 2, False), ("t", "a", "z", 6, 3, 1, True)]
    assert got == sorted(want, key=str)
    assert out[0].node.path == [out[0].l1, out[0].l2, out[0].l3]


def test_level_errors(spark):
    df = spark.createDataFrame([("a", None, "c")], "x string, y string, z string")
    with pytest.raises(Exception, match="level is null"):
        level_hierarchy(df, ["x", "y", "z"]).collect()
    with pytest.raises(AnalysisError):
        level_hierarchy(df, ["x", "y"], match="NAME")
    with pytest.raises(AnalysisError):
        level_hierarchy(spark.createDataFrame([("a", 1)], "x string, y int"), ["x", "y"])


def small(spark, node):
    return hierarchy(spark.createDataFrame([("a", 1, None), ("b", 2, 1), ("c", 3, 1), ("d", 4, 2), ("e", 5, 3), ("z", 9, None)], "n string, k long, p long"), "p", "k", None, ["k"], node).select(F.col("n").alias(f"n_{node}"), node)


TREE = {"a": None, "b": "a", "c": "a", "d": "b", "e": "c", "z": None}
PRE = {"a": 1, "b": 2, "d": 3, "c": 4, "e": 5, "z": 1}


def above(x):
    while TREE[x]:
        x = TREE[x]
        yield x


TRUTH = {
    "is_descendant": lambda u, v: v in above(u), "is_descendant_or_self": lambda u, v: u == v or v in above(u), "is_ancestor": lambda u, v: u in above(v), "is_ancestor_or_self": lambda u, v: u == v or u in above(v),
    "is_parent": lambda u, v: TREE[v] == u, "is_child": lambda u, v: TREE[u] == v, "is_sibling": lambda u, v: u != v and TREE[u] == TREE[v], "is_self": lambda u, v: u == v,
    "is_sibling_or_self": lambda u, v: TREE[u] == TREE[v], "is_following": lambda u, v: PRE[u] > PRE[v] and v not in above(u), "is_preceding": lambda u, v: PRE[v] > PRE[u] and u not in above(v),
}


@pytest.mark.parametrize("name", TRUTH)
def test_truth_tables(spark, name):
    N.register(spark)
    want = {(u, v) for u in TREE for v in TREE if TRUTH[name](u, v)}
    a, b = small(spark, "u"), small(spark, "v")
    assert {(r[0], r[1]) for r in a.crossJoin(b).where(F.expr(f"{name}(u, v)")).select("n_u", "n_v").collect()} == want
    assert {(r[0], r[1]) for r in a.crossJoin(b).where(N.call(name, "u", "v")).select("n_u", "n_v").collect()} == want
    assert {(r[0], r[1]) for r in node_join(a, "u", b, "v", name).select("n_u", "n_v").collect()} == want
    left = {(r[0], r[1]) for r in node_join(a, "u", b, "v", name, "left").select("n_u", "n_v").collect()}
    assert left == want | {(u, None) for u in TREE if not any((u, v) in want for v in TREE)}


def test_node_join_is_an_equi_join(spark):
    plan = node_join(small(spark, "u"), "u", small(spark, "v"), "v", "is_descendant")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_mixed_hierarchies_raise(spark):
    other = level_hierarchy(spark.createDataFrame([("a",)], "l string"), ["l"], node="w")
    with pytest.raises(AnalysisError):
        node_join(small(spark, "u"), "u", other, "w", "is_self")


def test_null_nodes(spark):
    N.register(spark)
    row = spark.sql(f"SELECT level(n) a, name(n) b, is_root(n) c, is_self(n, n) d, is_following(n, n) e FROM (SELECT CAST(NULL AS {N.NODE_TYPE}) AS n)").first()
    assert list(row) == [None] * 5


def test_hot_parents_and_large_trees_are_numbered_by_ranges(spark, monkeypatch):
    """One parent has most rows, in an order with ties and nulls; levels alike."""
    import arbordf.operators.hierarchy as H

    r = random.Random(6)
    rows = [(0, None, 1), (1, 0, 1)] + [(i, 1 if i % 4 else r.randrange(i), r.choice([None, 1, 2])) for i in range(2, 300)]
    df = spark.createDataFrame(rows, "k long, p long, o int").repartition(6)
    order = [F.desc("o"), F.col("k").desc()]
    want = nodes(hierarchy(df, "p", "k", None, order))
    levels = spark.createDataFrame([(f"r{i % 2}", "big" if i % 5 else f"n{i}", f"c{i}", i) for i in range(200)], "a string, b string, c string, v int")
    plain = {(x.a, x.b, x.c): x.node for x in level_hierarchy(levels, ["a", "b", "c"], [F.desc("v")]).collect()}
    monkeypatch.setattr(H, "SMALL_BYTES", -1)
    assert {x.id: (x.preRank, x.postRank) for x in adjacency_nodes(df, "p", "k", None, order, window_nodes=10).collect()} == {k: v[1:3] for k, v in want.items()}
    assert {(x.a, x.b, x.c): x.node for x in level_hierarchy(levels, ["a", "b", "c"], [F.desc("v")], window_nodes=10).collect()} == plain


def test_ranges_of_a_large_tree_follow_its_path_elements(spark, monkeypatch):
    """A tree of 300 nodes and about 2,200 path elements gets more ranges than the session's 4 partitions, and a range is not gathered anew for its ranks."""
    import arbordf.operators.tables as T

    edges = [(i, i // 2 if i > 1 else None) for i in range(1, 301)]
    df = spark.createDataFrame(edges, "k long, p long").repartition(5)
    want = nodes(hierarchy(df, "p", "k", None, [F.col("k").desc()]))
    monkeypatch.setattr(T, "CELLS", 100)
    out = adjacency_nodes(df, "p", "k", None, [F.col("k").desc()], window_nodes=10)
    assert {x.id: (x.preRank, x.postRank) for x in out.collect()} == {k: v[1:3] for k, v in want.items()}
    assert len(out.inputFiles()) > 4
    assert "row_number" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_rounds_leave_one_table(spark, tmp_path):
    from arbordf.operators.tables import shared_folder

    root = shared_folder(spark).removeprefix("file://")
    import os

    before = set(os.listdir(root))
    df = spark.range(40).select(F.col("id").alias("k"), F.when(F.col("id") > 0, F.col("id") - 1).alias("p"))
    hierarchy(df, "p", "k").count()
    assert len(set(os.listdir(root)) - before) == 1


def test_identity_is_how_a_hierarchy_is_made(spark):
    a, b = (spark.createDataFrame([(1, None)], f"k long, p long, {x} int" if x else "k long, p long") if not x else spark.createDataFrame([(1, None, 2)], f"k long, p long, {x} int") for x in ("", "x"))
    left, right = hierarchy(a, "p", "k", node="u").select("u"), hierarchy(b, "p", "k", node="v").select("v")
    assert node_join(left, "u", right, "v", "is_self").count() == 1
