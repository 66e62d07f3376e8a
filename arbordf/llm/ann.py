"""Approximate nearest neighbours by a robust-pruned directed graph over shards.

Vectors are dealt to shards by a hash of their content. In each shard a graph is built by batches: a greedy
beam search over the graph so far proposes a new point's neighbours, and pruning with a relaxed distance rule
keeps diverse edges: of the candidates in order of distance one is kept unless alpha times its distance to
an edge already kept is no more than its distance to the point. Edges are added in both directions and
over-full nodes pruned again. A query runs a beam search in every shard and the shards' best are merged.

Since every query visits every shard, shards grow with the table and not in number: there are FEW of them for any
table but the smallest, up to MOST for building on more cores, and more only where a shard would exceed
SHARD_MB. Beams widen with the square root of a shard's rows beyond FULL, which keeps recall.

Largest inner product becomes least distance by one more coordinate, sqrt(M^2 - |x|^2) with M the shard's
largest norm, which puts all points on one sphere; the graph is built on points scaled to that sphere, scores are
taken in double precision from the vectors as they are. Equal vectors are one point with its ids: a query
needs no more than its k + 1 least ids, so a very common vector costs a point, and no result is lost.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, n_partitions, opened

DEGREE, ALPHA, BUILD_BEAM, BEAM = 48, 1.2, 96, 192
#: Least rows of a shard, shards that a table of FEW * SHARD rows and more has, shards at most by rows, rows a shard at
#: which their number rises above FEW, and the size of a shard's vectors and graph that is never exceeded.
SHARD, FEW, MOST, FULL, SHARD_MB = 1024, 8, 64, 8192, 512
#: Queries that travel together.
BLOCK = 512
WIDE = 4  # nodes a beam expands at a time
#: Marks of visited nodes that a search holds at most: queries times points.
VISITS = 1 << 26


def beam_search(points: np.ndarray, graph: np.ndarray, start: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities (rows by falling similarity, -1 where fewer) of the ``beam`` nearest points found
    for each query; queries advance together, each expanding its WIDE best unexpanded nodes."""
    q, n = len(queries), len(points)
    if q * n > VISITS and q > 1:
        step = max(1, VISITS // n)
        parts = [beam_search(points, graph, start, queries[i : i + step], beam) for i in range(0, q, step)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True
    ids = np.full((q, beam), n)
    sims = np.full((q, beam), -np.inf, np.float32)
    start = start[:beam]
    ids[:, : len(start)], sims[:, : len(start)] = start, queries @ points[start].T
    seen[:, start] = True
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    old = ids == n
    while True:
        live = np.flatnonzero(~old.all(1))
        if not len(live):
            break
        o = old[live]
        pick = np.argsort(o, axis=1, kind="stable")[:, :WIDE]
        fresh = ~np.take_along_axis(o, pick, 1)
        node = np.where(fresh, np.take_along_axis(ids[live], pick, 1), n)
        np.put_along_axis(o, pick, True, 1)
        near = graph[node].reshape(len(live), -1)
        near = np.sort(near, axis=1)
        new = ~seen[live[:, None], near]
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[live[:, None], near] = True
        near = np.where(new, near, n)
        s = np.where(new, np.matmul(points[np.minimum(near, n - 1)], queries[live][:, :, None])[:, :, 0], -np.inf).astype(np.float32)
        all_ids, all_sims = np.concatenate((ids[live], near), 1), np.concatenate((sims[live], s), 1)
        all_old = np.concatenate((o, ~new), 1)
        top = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[live], sims[live] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_sims, top, 1)
        old[live] = np.take_along_axis(all_old, top, 1) | (ids[live] == n)
    return np.where(ids == n, -1, ids), sims


def robust_prune(points: np.ndarray, at: np.ndarray, cands: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours kept for each point ``at[i]`` of the candidates ``cands[i]`` (-1: none, repeats allowed)."""
    n = len(points)
    cands = np.sort(np.where(cands == at[:, None], -1, cands), axis=1)
    cands[:, 1:][cands[:, 1:] == cands[:, :-1]] = -1
    vec = points[np.maximum(cands, 0)]
    d = np.maximum(((vec - points[at][:, None, :]) ** 2).sum(2), 0)
    d[cands < 0] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    d, cands, vec = np.take_along_axis(d, order, 1), np.take_along_axis(cands, order, 1), np.take_along_axis(vec, order[:, :, None], 1)
    sq = (vec**2).sum(2)
    out, alive, rows = np.full((len(at), degree), n), np.isfinite(d), np.arange(len(at))
    for r in range(degree):
        pick = alive.argmax(1)
        some = alive[rows, pick]
        if not some.any():
            break
        out[some, r] = cands[rows, pick][some]
        kept = vec[rows, pick]
        gap = np.maximum(sq + sq[rows, pick][:, None] - 2 * np.matmul(vec, kept[:, :, None])[:, :, 0], 0)
        alive &= ~some[:, None] | (alpha * alpha * gap > d)
        alive[rows, pick] = False
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(graph, start points): graph row i has the neighbours of i, padded with n; row n is padding."""
    n = len(points)
    graph = np.full((n + 1, degree), n)
    order = np.random.default_rng(seed).permutation(n)
    mean = points.mean(0)
    order = np.concatenate((m := [int(((points - mean) ** 2).sum(1).argmin())], order[order != m[0]]))
    done = 1
    while done < n:
        batch = order[done : done + max(64, min(512, done))]
        cand = np.full((len(batch), 0), -1)
        if done > 1:
            cand = beam_search(points, graph, order[:1], points[batch], beam)[0]
        own = points[batch] @ points[batch].T
        np.fill_diagonal(own, -np.inf)
        close = np.argsort(-own, axis=1)[:, :16] if len(batch) > 1 else np.zeros((1, 0), int)
        cand = np.concatenate((cand, batch[close], np.full((len(batch), 1), order[0])), 1)
        graph[batch] = robust_prune(points, batch, cand, degree, alpha)
        src, dst = np.repeat(batch, degree), graph[batch].ravel()
        src, dst = src[dst < n], dst[dst < n]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        to, first, count = np.unique(dst, return_index=True, return_counts=True)
        for lo in range(0, len(to), 512):
            part = slice(lo, lo + 512)
            extra = np.full((len(to[part]), int(count[part].max())), -1)
            k = np.arange(extra.shape[1])
            fill = k[None, :] < count[part][:, None]
            extra[fill] = src[(first[part][:, None] + k[None, :])[fill]]
            both = np.concatenate((np.where(graph[to[part]] == n, -1, graph[to[part]]), extra), 1)
            graph[to[part]] = robust_prune(points, to[part], both, degree, alpha)
        done += len(batch)
    return graph, order[:1]


def on_sphere(vectors: np.ndarray) -> np.ndarray:
    """Points of norm 1 in one more dimension whose nearness is the inner product's order."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(initial=0) or 1.0
    sq = (x**2).sum(1)
    most = sq.max(initial=0) or 1.0
    return np.concatenate((x / np.sqrt(most), np.sqrt(np.maximum(1 - sq / most, 0))[:, None]), 1).astype(np.float32)


def directions(queries: np.ndarray) -> np.ndarray:
    """Queries as directions in the points' space."""
    x = queries.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    return np.concatenate((x, np.zeros((len(x), 1))), 1).astype(np.float32)


def usable(df: DataFrame, dim: int | None = None) -> DataFrame:
    """(vec_id, embedding) of the rows that take part: an id and a vector that is neither null nor zero, has
    only finite components and the table's most frequent dimension (or ``dim``). Float components stay float, all
    other numbers become double."""
    kind = "float" if df.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    v = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding")).where("vec_id is not null and embedding is not null")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = v.where(fine)
    if dim is None:
        most = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
        dim = most[0].d if most else 0
    return v.where(F.size("embedding") == dim)


def n_shards(rows: int, row_bytes: int, shard_mb: int = SHARD_MB) -> int:
    by_rows = min(max(FEW, -(-rows // FULL)), MOST, max(1, -(-rows // SHARD)))
    return max(by_rows, -(-rows * row_bytes // (shard_mb << 20)), 1)


def widened(beam: int, rows: int) -> int:
    return int(np.ceil(beam * max(1.0, rows / FULL) ** 0.5))


def spread(begins: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The numbers begins[i] to begins[i + 1] - 1 of each i of ``which``, one after another."""
    size = begins[which + 1] - begins[which]
    return np.repeat(begins[which] - np.cumsum(size) + size, size) + np.arange(size.sum())


def matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def build_index(vectors: DataFrame, ws: Workspace, k: int, shards: int | None = None) -> tuple[DataFrame, int]:
    """(table of shard and path, number of shards): a file for each shard with its points, their ids, graph and start, in the shared
    folder. vectors: as ``usable`` gives them. Every vector is indexed."""
    by = Window.partitionBy("embedding").orderBy("vec_id")
    same = vectors.withColumn("r", F.dense_rank().over(by)).where(F.col("r") <= k + 1)
    distinct = ws.written(same.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "points")
    if shards is None:
        size = distinct.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
        shards = n_shards(size.n, 8 * (size.d or 0) + 4 * (size.d or 0) + 4 * DEGREE + 32)
    rows = distinct.withColumn("shard", F.expr(f"int(pmod(xxhash64(embedding), {shards}))"))
    rows = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", F.col("ids")[0])
    folder = ws.folder("shards")

    def one(shard, points, ids):
        x = np.concatenate(points)
        # vectors that are one point at the graph's precision share a node
        nodes, node_of = np.unique(on_sphere(x), axis=0, return_inverse=True)
        order = np.argsort(node_of.ravel(), kind="stable")
        x, ids = x[order], [ids[i] for i in order]
        graph, start = build_graph(nodes)
        flat = np.array([v for i in ids for v in i], np.int64)
        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)
        name = f"{shard}-{uuid.uuid4().hex}.npz"
        with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
            np.savez(f, nodes=nodes, members=np.bincount(node_of.ravel()), points=x, ids=flat, counts=np.array([len(i) for i in ids]), graph=graph.astype(np.int32), start=start.astype(np.int32))
        return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{folder}/{name}"]})

    def run(batches):
        at, points, ids = None, [], []
        for batch in batches:
            x, shard, own = matrix(batch.column("embedding")), batch.column("shard").to_numpy(), batch.column("ids").to_pylist()
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if at is not None and shard[lo] != at:
                    yield one(at, points, ids)
                    points, ids = [], []
                at = int(shard[lo])
                points.append(x[lo:hi].copy())
                ids += own[lo:hi]
        if points:
            yield one(at, points, ids)

    return ws.written(rows.select("shard", "embedding", "ids").mapInArrow(run, "shard int, path string"), "index"), shards


def search(index: DataFrame, shards: int, queries: DataFrame, ws: Workspace, k: int = 20, beam: int = BEAM) -> DataFrame:
    """The ``k`` nearest found for each query row (vec_id, embedding), its own row left out: query_id, rank (from
    1), vec_id, score; by falling score in double precision, ties to the smaller vec_id. Queries travel in
    blocks as their tasks read them; a task loads each shard it searches once."""

    def blocked(batches):
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                flat = part.column(1).flatten()
                qid, qv = (pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (part.column(0), flat))
                yield pa.RecordBatch.from_arrays([qid, qv], names=["qid", "qv"])

    kind = queries.schema["embedding"].dataType.simpleString()
    # written, so that a repeated task finds the same blocks
    blocks = ws.written(queries.select("vec_id", "embedding").mapInArrow(blocked, f"qid array<long>, qv {kind}"), "queries")
    work = blocks.withColumn("salt", F.xxhash64("qid")).withColumn("shard", F.explode(F.expr(f"sequence(0, {shards - 1})")))
    # a row of a name and a number for each shard: at most MOST, or one for each SHARD_MB
    work = work.join(F.broadcast(index), "shard")
    parts = n_partitions(queries.sparkSession)
    work = work.repartition(parts, "shard", F.pmod("salt", F.lit(max(1, -(-parts // shards))))).sortWithinPartitions("shard")

    def run(batches):
        at = index = None
        for batch in batches:
            for r in range(len(batch)):
                path = batch.column("path")[r].as_py()
                if path != at:
                    fs, base = opened(path)
                    with fs.open_input_file(base) as f:
                        index = dict(np.load(f))
                    at, x, flat = path, index["points"], index["ids"]
                    # of each node its points, of each point its ids
                    of_node, of_point = (np.concatenate(([0], np.cumsum(index[c]))) for c in ("members", "counts"))
                qid = batch.column("qid")[r].values.to_numpy()
                q = batch.column("qv")[r].values.to_numpy().reshape(len(qid), -1)
                found, _ = beam_search(index["nodes"], index["graph"], index["start"], directions(q), max(widened(beam, len(x)), k + 1))
                out_q, out_n, out_v, out_s = [], [], [], []
                for i in range(len(q)):
                    at_points = spread(of_node, found[i][found[i] >= 0][: 2 * k + 1])
                    score = (x[at_points].astype(np.float64) * q[i].astype(np.float64)).sum(1)
                    ids, size = flat[spread(of_point, at_points)], of_point[at_points + 1] - of_point[at_points]
                    others = (ids != qid[i]) | ~np.repeat((x[at_points] == q[i]).all(1), size)
                    ids, score = ids[others], np.repeat(score, size)[others]
                    best = np.lexsort((ids, -score))[:k]
                    out_q += [qid[i]] * len(best)
                    out_n += [i] * len(best)
                    out_v += ids[best].tolist()
                    out_s += score[best].tolist()
                salt = pa.array(np.full(len(out_q), batch.column("salt")[r].as_py()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), salt, pa.array(out_n, pa.int32()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())], names=["query_id", "salt", "n", "vec_id", "score"])

    near = work.select("qid", "qv", "path", "salt").mapInArrow(run, "query_id long, salt long, n int, vec_id long, score double")
    # rows that share an id are queries of their own, told by their place in a block
    best = Window.partitionBy("query_id", "salt", "n").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, every: int = 20, k: int = 20, shards: int | None = None, beam: int = BEAM) -> DataFrame:
    """Search ``df`` (vec_id, embedding; other columns are ignored) for the k nearest rows of each row whose
    vec_id is divisible by ``every``. Rows that take no part are those ``usable`` leaves out; rows that
    repeat an id and a vector count once, rows that repeat an id with another vector are queries and
    candidates of their own. An empty table gives no rows. ``shards``: see ``n_shards``."""
    ws = Workspace(df.sparkSession, "ann")
    v = ws.written(usable(df), "vectors")
    index, shards = build_index(v, ws, k, shards)
    return search(index, shards, v.where(F.col("vec_id") % every == 0).dropDuplicates(), ws, k, beam)
