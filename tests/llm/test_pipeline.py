import random

import corpus_pipeline as P


def tables(spark, path):
    r = random.Random(1)
    words = ["".join(r.choice("aeiounrst") for _ in range(r.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(300):
        text = " ".join(r.choice(words) for _ in range(60)) + (" a.b@c.de" if i % 10 == 0 else "")
        good = i % 4 != 0 or i == 0
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if i % 7 == 0 and i and good and rows[i - 1][1][-1] != "!":
            text = rows[i - 1][1]
        rows.append((i, text, r.choice(["en", "de"]), f"src{i % 6}", len(text)))
        labels.append((i, int(good), 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows, labels


def test_stages(spark, tmp_path):
    rows, labels = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        out = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        seen[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    good = {i for i, q, _ in labels if q}
    assert {r.doc_id for r in seen["quality"]} == good
    texts = {i: t for i, t, *_ in rows}
    first = {}
    for i in sorted(good):
        first.setdefault(texts[i], i)
    assert {r.doc_id for r in seen["near_dedup"]} == set(first.values())
    assert all("@" not in r.text and r.n_chars == len(r.text) for r in seen["personal_data"])
    assert {r.doc_id for r in seen["mixing"]} <= {r.doc_id for r in seen["personal_data"]}
    packed = {}
    for r in seen["packing"]:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    want = {}
    for r in seen["mixing"]:
        want[r.doc_id] = want.get(r.doc_id, 0) + len(r.text.split())
    assert packed == want
    assert P.run(spark, str(tmp_path)).count() == len(seen["packing"])


def test_stages_take_nulls_repeats_long_texts_and_clashing_columns(spark, tmp_path):
    rows, labels = tables(spark, tmp_path)
    more = "epoch string, mix_cut string, host int, n long, copies string, block int, spans string, n_tokens string"
    own = ("e", "m", 5, 9, "c", 3, "s", "t")
    odd = [(None, "some words without an id", "en", "src1", 5), (None, None, None, None, None), (900, None, "en", "src2", 0), (901, "", None, None, 0),
           (902, rows[5][1], "en", "src5", 1), (902, rows[5][1], "en", "src5", 1), (903, " ".join(w for r in rows[1:4] for w in r[1].split()) * 60, "de", "src1", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + more
    docs = spark.createDataFrame([(*r, *own) for r in rows[:40] + odd], schema)
    columns = docs.columns
    for name, stage in P.STAGES:
        out = f"{tmp_path}/odd-{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        if name != "packing":
            assert docs.columns == columns and docs.where("epoch <> 'e' or mix_cut <> 'm' or host <> 5 or n <> 9 or copies <> 'c' or block <> 3 or spans <> 's' or n_tokens <> 't'").isEmpty()
            assert docs.count() <= before.count() * (2 if name == "mixing" else 1)
        if name == "near_dedup":
            assert docs.where("doc_id = 902").count() == 0  # a copy of document 5
    empty = spark.createDataFrame([], schema)
    for name, stage in P.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def test_a_stage_leaves_nothing_behind(spark, tmp_path):
    from pathlib import Path

    from arbordf.llm.common import shared_root

    tables(spark, tmp_path)
    root = Path(shared_root(spark).removeprefix("file://"))
    before = set(root.iterdir())
    P.run(spark, str(tmp_path)).count()
    left = set(root.iterdir()) - before
    assert len(left) == 1 and [p.name.split("-")[1] for p in next(iter(left)).iterdir()] == ["packing"]
