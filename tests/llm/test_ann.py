import numpy as np
import pytest

from arbordf.llm.ann import BEAM, FEW, MOST, beam_search, build_graph, directions, n_shards, nearest, on_sphere, robust_prune, widened

SCHEMA = "vec_id long, embedding array<float>, label int, shard int"


def brute(x, ids, q, k):
    s = x.astype(float) @ x[q].astype(float)
    order = sorted((-s[i], ids[i]) for i in range(len(ids)) if i != q)
    return [i for _, i in order[:k]], -order[min(k, len(order)) - 1][0]


def test_recall_and_scores(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 16)).astype(np.float32) * r.uniform(0.5, 2, size=(3000, 1)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0, 1) for i, v in enumerate(x)], SCHEMA)
    rows = nearest(df, every=20, k=20, shards=5).collect()
    by = {}
    for row in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(row.query_id, []).append(row)
    assert sorted(by) == list(range(0, 3000, 20))
    hit = 0
    for q, found in by.items():
        assert [f.rank for f in found] == list(range(1, 21)) and all(f.vec_id != q for f in found)
        assert [(-f.score, f.vec_id) for f in found] == sorted((-f.score, f.vec_id) for f in found)
        assert all(abs(f.score - float(x[q].astype(float) @ x[f.vec_id].astype(float))) < 1e-12 for f in found)
        hit += len({f.vec_id for f in found} & set(brute(x, range(3000), q, 20)[0]))
    assert hit / (20 * len(by)) >= 0.95


def test_a_very_common_vector(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 8)).astype(np.float32)
    x[::2] = x[0]
    rows = nearest(spark.createDataFrame([(i, v.tolist(), 0, 1) for i, v in enumerate(x)], SCHEMA), every=20, k=20).collect()
    for q in range(0, 200, 20):
        got = [row.vec_id for row in sorted(rows, key=lambda r: r.rank) if row.query_id == q]
        want = sorted(range(200), key=lambda i: (-float(x[i].astype(float) @ x[q].astype(float)), i))
        assert got == [i for i in want if i != q][:20]


def test_rows_that_take_no_part(spark):
    bad = [(1, None), (2, [0.0] * 4), (3, [1.0, None, 0.0, 0.0]), (4, [float("nan"), 1.0, 0.0, 0.0]), (5, [float("inf"), 1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]), (6, [1.0, 2.0])]
    good = [(0, [1.0, 0.0, 0.0, 0.0]), (20, [0.5, 0.0, 0.0, 1.0]), (20, [0.5, 0.0, 0.0, 1.0]), (7, [0.25, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 0, 0) for r in bad + good], SCHEMA)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(df).collect())
    assert got == [(0, 1, 20, 0.5), (0, 2, 7, 0.25), (20, 1, 0, 0.5), (20, 2, 7, 0.125)]
    assert nearest(df.where("false")).count() == 0
    assert nearest(df.where("vec_id = 0")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 65, 300])
def test_graph_reaches_all(n):
    graph, start = build_graph(on_sphere(np.random.default_rng(n).normal(size=(n, 6)).astype(np.float32)))
    seen, todo = {int(start[0])}, [int(start[0])]
    while todo:
        for j in graph[todo.pop()]:
            if j < n and int(j) not in seen:
                seen.add(int(j))
                todo.append(int(j))
    assert len(seen) >= 0.99 * n


def test_pruning_keeps_diverse_edges():
    p = np.array([[0, 0], [1, 0], [1.05, 0], [0, 1.5]], np.float32)
    assert robust_prune(p, np.array([0]), np.array([[1, 2, 3, 3, -1]]), 3, 1.2).tolist() == [[1, 3, 4]]


@pytest.mark.parametrize("n", [12_000])
def test_recall_of_one_large_shard(n):
    """Vectors without structure and of different norms, all in one shard."""
    r = np.random.default_rng(5)
    x = r.normal(size=(n, 32)).astype(np.float32)
    sphere = on_sphere(x)
    graph, start = build_graph(sphere)
    q = x[::100]
    found, _ = beam_search(sphere, graph, start, directions(q), widened(BEAM, n))
    want = np.argsort(-(q.astype(float) @ x.T.astype(float)), axis=1)[:, :20]
    assert np.mean([len(set(a[:24]) & set(b)) / 20 for a, b in zip(found.tolist(), want.tolist())]) >= 0.9


def test_the_number_of_shards_is_bounded_by_memory_alone():
    assert n_shards(500, 1000) == 1 and n_shards(10_000, 1000) == FEW == n_shards(60_000, 1000) and n_shards(10**7, 100) == MOST
    assert n_shards(10**9, 1000) == -(-(10**12) // (512 << 20))


def test_double_vectors_keep_their_precision(spark):
    rows = [(0, [1.0, 1e-60]), (1, [0.1, 0.2]), (2, [1e-300, 0.0]), (3, [1.0 + 2**-40, 0.0]), (4, [1.0, 0.0]), (5, [0.0, 0.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(3, 1.0 + 2**-40), (4, 1.0), (1, 0.1 + 0.2e-60), (2, 1e-300)]


def test_one_id_for_many_rows(spark):
    r = np.random.default_rng(3)
    rows = [(0, v.tolist()) for v in r.normal(size=(700, 4)).astype(np.float32)] + [(i, v.tolist()) for i, v in enumerate(r.normal(size=(30, 4)).astype(np.float32), 1)]
    out = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=20)
    assert out.where("query_id = 0").count() == 700 * 20 and not out.where("query_id = 0 and vec_id = 0").isEmpty() and out.where("query_id = 20").count() == 20
