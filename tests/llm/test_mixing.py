import random

import pytest
from pyspark.sql import functions as F

from arbordf.llm.mixing import budgets, mixed

LEAF = "domain string, lang string, source string, tokens long"


def fill(children, budget):
    """Plain water filling in rationals: child -> part."""
    out, open_ = {}, dict(children)
    while open_:
        w = sum(x[0] for x in open_.values())
        short = {k: c for k, (wt, c) in open_.items() if c * w <= budget * wt}
        if not short:
            return out | {k: budget * wt / w for k, (wt, _) in open_.items()}
        for k, c in short.items():
            out[k], budget = c, budget - c
            del open_[k]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_shortages_go_to_siblings_first(spark, seed):
    r = random.Random(seed)
    leaves = [(d, lang, s, r.choice([0, 5, 100, 1000, 20_000])) for d in "ab" for lang in ("en", "de", "fr") for s in "xyz" if r.random() < 0.9]
    weights = {"domain": {"a": 3}, "lang": {"en": 4, "fr": 0 if seed == 2 else 2}, "source": {"x": 2}}
    total = sum(x[3] for x in leaves) * 7 // 10
    got = {(x.domain, x.lang, x.source): x.target for x in budgets(spark.createDataFrame(leaves, LEAF), weights, total, 2).collect()}
    w = lambda level, k: weights[level].get(k, 1)
    cap = lambda *p: sum(2 * x[3] for x in leaves if x[: len(p)] == p and w("lang", x[1]))
    top = fill({d: (w("domain", d), cap(d)) for d in {x[0] for x in leaves}}, total)
    for d, b in top.items():
        mid = fill({k: (w("lang", k), cap(d, k)) for k in {x[1] for x in leaves if x[0] == d} if w("lang", k)}, b)
        for k, b2 in mid.items():
            for s, want in fill({x[2]: (w("source", x[2]), 2 * x[3]) for x in leaves if x[:2] == (d, k)}, b2).items():
                assert abs(got[d, k, s] - want) <= 3
    assert sum(got.values()) <= total


def test_prefix_in_seeded_order(spark):
    r = random.Random(9)
    rows = [(i, "w " * r.randint(0, 30), "en", f"src{i % 2}", 1, "e") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int, epoch string")
    out = mixed(df, F.lit("d"), {"source": {"src0": 3}}, (1, 2), 2).collect()
    n = {i: t.count("w") for i, t, *_ in rows}
    for s in (0, 1):
        mine = [x for x in out if x.source == f"src{s}"]
        goal = sum(n.values()) // 2 * (3 if s == 0 else 1) // 4
        assert goal - 31 <= sum(x.n_tokens for x in mine) <= goal + 1
    assert all(x.n_tokens == n[x.doc_id] for x in out)
    again = mixed(df.repartition(5), F.lit("d"), {"source": {"src0": 3}}, (1, 2), 2)
    assert sorted((x.doc_id, x.epoch) for x in out) == sorted((x.doc_id, x.epoch) for x in again.collect())


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert mixed(spark.createDataFrame([], schema), F.lit("d"), {}).count() == 0
    df = spark.createDataFrame([(None, "a b", None, None), (1, None, None, None), (2, "a", "en", "s"), (2, "a", "en", "s")], schema)
    assert mixed(df, F.lit(None).cast("string"), {}, (1, 1), 1).count() == 4
    assert mixed(df, F.lit("d"), {}, (2, 1), 2).count() == 8


def test_slices_of_slices_give_the_same_rows(spark):
    """A leaf that holds most rows, one id for a third of them, one very long text: cut down to any size."""
    r = random.Random(4)
    rows = [(7 if i % 3 == 0 else None if i % 50 == 1 else i, "w " * r.randint(0, 9) + f"t{i}", "en", "big" if i % 10 else f"s{i}") for i in range(2500)] + [(5000, "long " * 2000, "en", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    key = lambda out: sorted((str(x.doc_id), x.text[-9:], x.epoch) for x in out.collect())
    whole = mixed(df, F.lit("d"), {}, (1, 2), 2, edge_rows=10**9)
    tokens = {(str(i), t[-9:]): len(t.split()) for i, t, *_ in rows}
    assert 0.3 * sum(tokens.values()) < sum(tokens[k[:2]] for k in key(whole)) <= 0.5 * sum(tokens.values())
    assert key(whole) == key(mixed(df.repartition(7), F.lit("d"), {}, (1, 2), 2, edge_rows=20))
