import random
from pathlib import Path

import numpy as np
import pytest

from arbordf.llm import binpack, token_packing
from arbordf.llm.common import shared_root


@pytest.mark.parametrize("seed", range(5))
def test_best_fit(seed):
    r = random.Random(seed)
    sizes = sorted((min(8192, int(r.paretovariate(0.9) * 40)) for _ in range(800)), reverse=True)
    at, offset, caps = binpack.pack(sizes)
    used = [0] * len(caps)
    for s, b, o in zip(sizes, at, offset):
        assert o == used[b]
        used[b] += s
    assert all(u <= c and c in binpack.LENGTHS and not any(u <= x < c for x in binpack.LENGTHS) for u, c in zip(used, caps))
    assert sum(used) / sum(caps) > 0.9


def test_one_length_is_best_fit_decreasing():
    r = random.Random(3)
    sizes = sorted((r.randint(1, 100) for _ in range(300)), reverse=True)
    rooms, want = [], []
    for s in sizes:
        fit = [(x, i) for i, x in enumerate(rooms) if x >= s]
        if fit:
            least = min(fit)[0]
            want.append(least)
            i = next(i for x, i in fit if x == least)
        else:
            rooms.append(100)
            i = len(rooms) - 1
            want.append(100)
        rooms[i] -= s
    at, offset, caps = binpack.pack(sizes, (100,), 0)
    assert len(caps) == len(rooms) and [100 - o for o in offset] == want


def test_rooms():
    rooms, kept, r = binpack.Rooms(50), [], random.Random(1)
    for i in range(2000):
        if kept and r.random() < 0.5:
            least = r.randint(1, 50)
            fit = [x for x in kept if x[0] >= least]
            got = rooms.take(least)
            assert (got is None) == (not fit)
            if got:
                assert got[0] == min(fit)[0]
                kept.remove(got)
        else:
            kept.append((r.randint(1, 50), i))
            rooms.add(*kept[-1])


SCHEMA = "doc_id long, n_tokens long, bin_id string"


def test_packed(spark):
    r = random.Random(2)
    rows = [(i, r.choice([0, 1, 50, 900, 8192, 30_000]), "x") for i in range(300)] + [(None, 10, "x"), (7, None, "x"), (8, -4, "x")]
    out = binpack.packed(spark.createDataFrame(rows, SCHEMA), block_rows=60).collect()
    by, bins = {}, {}
    for x in out:
        by.setdefault(x.doc_id, []).append((x.start, x.length))
        if x.bin_id is not None:
            bins.setdefault((x.bin_id, x.bin_length), []).append((x.offset, x.length))
        else:
            assert x.length == 0
    for i, n, _ in rows[:300]:
        pieces = sorted(p for p in by[i] if p[1])
        assert sum(p[1] for p in pieces) == n and all(a + b == c for (a, b), (c, _) in zip(pieces, pieces[1:]))
    for (_, cap), p in bins.items():
        p.sort()
        assert p[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(p, p[1:])) and p[-1][0] + p[-1][1] <= cap
    assert len({b for b, _ in bins}) == len(bins)
    assert binpack.packed(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_id_for_all_rows(spark):
    out = binpack.packed(spark.createDataFrame([(1, 100, "")] * 500, SCHEMA), block_rows=50)
    assert out.agg({"length": "sum"}).first()[0] == 50_000 and out.count() == 500


needs_vocabulary = pytest.mark.skipif(not Path(token_packing.VOCABULARY).exists(), reason="no vocabulary file")


@needs_vocabulary
def test_token_rows_round_trip(spark):
    texts = {1: "Hello wörld, " * 400, 2: "", 3: None, 4: "short <|endoftext|> text", 5: "日本語 " * 30, 6: "x" * 20_000}
    df = spark.createDataFrame([(i, t, "n") for i, t in texts.items()] + [(None, "no id", "n")], "doc_id long, text string, ids string")
    rows = token_packing.token_rows(df, row=256, block_tokens=900)
    enc = token_packing.encoder(token_packing.read_vocabulary(token_packing.VOCABULARY))
    got = {}
    for x in rows.collect():
        ids = np.frombuffer(x.ids, "<u2")
        assert len(ids) == 256 and x.n_tokens == x.cu_seqlens[-1] <= 256 and x.resets == x.cu_seqlens[:-1] and (ids[x.n_tokens :] == token_packing.END_ID).all()
        for d, s, a, b in zip(x.doc_ids, x.starts, x.cu_seqlens, x.cu_seqlens[1:]):
            got.setdefault(d, []).append((s, ids[a:b].tolist()))
        pos = token_packing.position_ids(x.cu_seqlens, 256)
        assert all((pos[a:b] == np.arange(b - a)).all() for a, b in zip(x.cu_seqlens, x.cu_seqlens[1:]))
    for d, t in [*texts.items(), (None, "no id")]:
        ids = [i for _, part in sorted(got[d]) for i in part]
        assert ids[-1] == token_packing.END_ID and enc.decode(ids[:-1]) == (t or "")
    folder = shared_root(spark) + "/tokens"
    files = token_packing.write_token_files(rows, folder, 5).collect()
    assert sum(f.rows for f in files) == rows.count() and max(f.rows for f in files) == 5
    for f in files:
        base = f.path.removeprefix("file://")
        assert np.fromfile(base + ".ids", "<u2").shape == (f.rows * 256,)
        cu, pos = (np.fromfile(f"{base}.{e}", "<i4") for e in ("cu", "pos"))
        assert len(cu) == len(pos) + f.rows
    back = token_packing.round_trip(df, row=256, block_tokens=900)
    key = lambda x: (x.row_id, x.n_tokens)
    assert back.schema == rows.schema and sorted(back.collect(), key=key) == sorted(rows.collect(), key=key)
    assert token_packing.token_rows(df.where("false")).count() == 0 == token_packing.round_trip(df.where("false")).count()


@needs_vocabulary
def test_one_id_for_all_documents_is_no_hot_key(spark):
    df = spark.createDataFrame([(None, f"text {i} " * 20) for i in range(400)] + [(1, "again and again")] * 30, "doc_id long, text string")
    rows = token_packing.token_rows(df, row=128, block_chars=2000).collect()
    blocks = {x.row_id >> 32 for x in rows}
    assert len(blocks) > 20 and sum(len([s for s in x.starts if s == 0]) for x in rows) == 430


def plain_pack(sizes, lengths, overhead):
    """The rule, written out: (bins as lists of sizes, lengths opened)."""
    bins, stamp = [], 0
    for k, s in enumerate(sizes):
        fit = [(b["room"], -b["stamp"], i) for i, b in enumerate(bins) if b["room"] >= s]
        stamp += 1
        if fit:
            b = bins[min(fit)[2]]
        else:
            rest = sizes[k + 1 :]
            cost = lambda c: (c + overhead) / (s + min(c - s, sum(x for x in rest if x <= c - s)))  # noqa: B023, E731
            c = min((c for c in sorted(lengths) if c >= s), key=cost)
            bins.append(b := {"room": c, "stamp": 0, "sizes": []})
        b["room"] -= s
        b["stamp"] = stamp
        b["sizes"].append(s)
    return sorted(b["sizes"] for b in bins), sorted(min(c for c in lengths if c >= sum(b["sizes"])) for b in bins)


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]]


@pytest.mark.parametrize("seed", range(4))
def test_several_lengths_follow_the_rule_and_come_close_to_the_best(seed):
    r, lengths, overhead = random.Random(seed), (4, 8, 16), 1
    total = least = 0
    for _ in range(60):
        sizes = sorted((r.randint(1, 16) for _ in range(r.randint(1, 7))), reverse=True)
        at, _, caps = binpack.pack(sizes, lengths, overhead)
        bins = [[s for s, b in zip(sizes, at) if b == i] for i in range(len(caps))]
        assert (sorted(bins), sorted(caps)) == plain_pack(sizes, lengths, overhead)
        cost = lambda p: sum(min(c for c in lengths if c >= sum(b)) + overhead for b in p)
        best = min(cost(p) for p in partitions(sizes) if all(sum(b) <= 16 for b in p))
        got = sum(caps) + overhead * len(caps)
        assert best <= got <= 1.6 * best
        total, least = total + got, least + best
    assert total <= 1.08 * least


def test_equal_sizes_and_hot_ids(spark):
    at, _, caps = binpack.pack([100] * 5000, (1000,), 0)
    assert len(caps) == 500
    out = binpack.packed(spark.createDataFrame([(None, 100, "")] * 30_000 + [(i, 100, "") for i in range(3000)], SCHEMA), block_rows=1000)
    assert out.count() == 33_000 and out.select("bin_id").where("doc_id is null").selectExpr("count(distinct bin_id >> 32) AS n").first().n > 20
