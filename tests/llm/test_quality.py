import random

import numpy as np
from pyspark.sql import functions as F

from arbordf.llm.quality import N_STATS, fit, good_documents, scored, stats, train

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host int, posterior string"


def documents(n=600, seed=3):
    r = random.Random(seed)
    words = ["".join(r.choice("aeiounrst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        bad = r.random() < (0.6 if i % 5 == 0 else 0.1)
        w = [r.choice(words) for _ in range(r.randint(20, 200))]
        text = r.choice([" ".join(x.upper() + "!!" for x in w), " ".join(x + "***" for x in w), " ".join([w[0]] * 80)]) if bad else " ".join(w).capitalize() + "."
        rows.append((i, text, "en", "junk" if i % 5 == 0 else f"s{i % 3}", len(text), 7, "own"))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = documents()
    df, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = scored(df, lab.where("doc_id % 2 = 0")).collect()
    truth = dict((i, q) for i, q, _ in labels)
    assert np.mean([(r.posterior >= 0.5) == bool(truth[r.doc_id]) for r in out if r.doc_id % 2]) > 0.98
    kept = good_documents(df, lab)
    assert kept.columns == df.columns and kept.where("posterior <> 'own' or host <> 7").isEmpty()


def plain_strength(groups):
    """groups: (n, good, mean of the level above)."""
    n, k = sum(g[0] for g in groups), len(groups)
    within = sum(g[0] * g[2] * (1 - g[2]) for g in groups) / n
    ss, even = sum(g[0] * (g[1] / g[0] - g[2]) ** 2 for g in groups), n - sum(g[0] ** 2 for g in groups) / n
    between = (ss - (k - 1) * within) / even if even > 0 else 0
    return min(10_000, max(1, within / between - 1)) if between > 0 and k > 1 else 10_000


def test_rates_equal_a_plain_recomputation(spark):
    """Both levels, strengths and each document's rate without itself."""
    rows, labels = documents()
    rows += [(10_000, rows[0][1], "en", "rare", 1, 0, ""), (10_001, None, None, None, 1, 0, ""), (10_002, rows[7][1], "de", "s0", 1, 0, ""), (10_002, rows[7][1], "de", "s0", 1, 0, "")]
    df, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = train(df, lab)
    p = [1 / (1 + np.exp(-(model.evidence(np.array([stats(r[1] or "")]))[0] + model.prior))) for r in rows]
    paths, hosts = {}, {}
    for r, x in zip(rows, p):
        for at, key in ((paths, (r[3], r[2])), (hosts, r[3])):
            n, good = at.get(key, (0, 0.0))
            at[key] = n + 1, good + x
    mean = sum(p) / len(p)
    k = plain_strength([(n, g, mean) for n, g in hosts.values()])
    host_rate = {h: (g + k * mean) / (n + k) for h, (n, g) in hosts.items()}
    k2 = plain_strength([(n, g, host_rate[h]) for (h, _), (n, g) in paths.items()])
    got = scored(df, lab).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.source, r.lang): r for r in got}
    for r, x in zip(rows, p):
        n, good = paths[r[3], r[2]]
        hn, hgood = hosts[r[3]]
        rate = (good - x + k2 * (hgood - x + k * mean) / (hn - 1 + k)) / (n - 1 + k2)
        rate = min(max(rate, 1e-6), 1 - 1e-6)
        mine = by[r[0], r[3], r[2]]
        assert abs(mine.site_rate - rate) < 1e-9
        odds = np.log(x / (1 - x)) - model.prior + np.log(rate / (1 - rate))
        assert abs(mine.posterior - 1 / (1 + np.exp(-odds))) < 1e-6


def test_sites_shrink(spark):
    rows, labels = documents()
    rows += [(10_000, rows[0][1], "en", "rare", 1, 0, "")]
    df, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rates = {}
    for r in scored(df, lab).collect():
        rates.setdefault(r.host, []).append(r.site_rate)
    assert max(rates["junk"]) < min(rates["rare"]) < min(rates["s0"]) + 0.05


def test_edges(spark):
    lab = spark.createDataFrame([(None, 1, 0), (1, 5, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(None, None, None, None, None, 1, ""), (1, "", None, "a", 0, 1, ""), (1, "", None, "a", 0, 1, ""), (2, "x " * 100_000, "en", None, 0, 1, "")], SCHEMA)
    out = scored(df, lab)
    assert out.count() == 4 and out.where(F.col("posterior").isNull()).isEmpty()
    assert scored(df.where("false"), lab).count() == 0 == good_documents(df.where("false"), lab).count()
    assert stats("") == [0.0] * N_STATS and fit(np.zeros((0, N_STATS)), np.zeros(0)).prior == 0
