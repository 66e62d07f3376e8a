"""MinHash near-dedup by SuperMinHash.

Every document's set of word shingles gets a SuperMinHash signature: each shingle draws a random
permutation of the slots together with ranks that grow along it, so the ranks of one shingle are
correlated over the slots and the estimate varies less than with independent hash functions. Drawing
stops for a document as soon as its slots are all filled, since later draws have larger ranks.

Signatures are cut into bands. Documents with equal sets are one representative, told by the set's digest. In each bucket of a
band every member is verified on the full sets against the bucket's least member; the links found are
contracted to components. In buckets that still hold several components the members of different
components are compared on full sets, in blocks of bounded size, and a link per two components comes
out; no bucket is capped or left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import Workspace, semi_join
from .components import connected_components

U = np.uint64
GOLDEN, M1, M2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
EMPTY = U(0xFFFFFFFFFFFFFFFF)


def mix(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    z = (z ^ (z >> U(30))) * M1
    z = (z ^ (z >> U(27))) * M2
    return z ^ (z >> U(31))


class WordHashes(dict):
    """64-bit hashes of words, computed once for each word of a batch."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return h


def shingle_sets(texts: list[str | None], k: int, words: WordHashes) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of ``k`` words; A-Z count as a-z.
    A text of fewer words has its whole word sequence as one; one without words has the empty set."""
    out = []
    with np.errstate(over="ignore"):
        mult = [mix(U(i + 1) * GOLDEN) | U(1) for i in range(k)]
        for t in texts:
            w = t.encode("utf-8", "surrogatepass").lower().split() if t else ()
            if not w:
                out.append(np.empty(0, U))
                continue
            h = np.fromiter(map(words.__getitem__, w), U, len(w))
            n = len(w) - k + 1
            if n < 1:
                s = np.array([len(w)], U)
                for i in range(len(w)):
                    s = mix(s + h[i : i + 1] * mult[i])
                out.append(s)
                continue
            s = h[:n] * mult[0]
            for i in range(1, k):
                s += h[i : i + n] * mult[i]
            s = mix(s)
            s.sort()
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if n > 1 else s)
    return out


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures, a row of ``m`` (at most 255) for each set. A slot's value has the draw's
    number j in its top byte and 56 random bits below, so that comparing integers compares j + r.
    Empty sets keep EMPTY everywhere."""
    d = len(sets)
    sig = np.full(d * m, EMPTY, U)
    sizes = np.array([len(s) for s in sets])
    if not sizes.sum():
        return sig.reshape(d, m)
    owner, state = np.repeat(np.arange(d), sizes), np.concatenate(sets)
    perm = np.tile(np.arange(m, dtype=np.uint8), (len(state), 1))
    base, row = owner * m, np.arange(len(state))
    with np.errstate(over="ignore"):
        for j in range(m):
            state = state + GOLDEN
            z = mix(state)
            k = j + ((mix(z ^ M1) >> U(32)) * U(m - j) >> U(32)).astype(np.int64)
            p = perm[row, k]
            perm[row, k] = perm[row, j]
            np.minimum.at(sig, base + p, (U(j) << U(56)) | (z >> U(8)))
            if j < 8 or j % 8 == 0:
                live = (sig.reshape(d, m) == EMPTY).any(1)[owner]
                if not live.all():
                    owner, base, row, state = owner[live], base[live], row[live], state[live]
                    if not len(row):
                        break
    return sig.reshape(d, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        part = sig[:, : bands * rows].reshape(len(sig), bands, rows)
        key = np.broadcast_to(mix(np.arange(1, bands + 1).astype(U) * GOLDEN), part.shape[:2]).copy()
        for i in range(rows):
            key = mix(key * GOLDEN + part[:, :, i])
    return key


def chunks(sets: list[np.ndarray], most: int = 150_000) -> Iterator[slice]:
    """Slices of about ``most`` shingles; a longer single set is a slice of its own."""
    at = n = 0
    for i, s in enumerate(sets):
        if n and n + len(s) > most:
            yield slice(at, i)
            at, n = i, 0
        n += len(s)
    if at < len(sets):
        yield slice(at, len(sets))


def lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int64)))


def digests(sets: list[bytes]) -> np.ndarray:
    """128-bit digests of sets given as bytes, as rows of two numbers."""
    return np.frombuffer(b"".join(blake2b(s, digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, keys): set size, a 128-bit digest of the set, bucket keys."""

    def run(batches):
        words = WordHashes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(ids), 1000):
                part = shingle_sets(texts.slice(at, 1000).to_pylist(), k, words)
                keys = np.concatenate([band_keys(superminhash(part[c], bands * rows), bands, rows) for c in chunks(part)])
                has = np.array([len(s) > 0 for s in part])
                digest = digests([s.tobytes() for s in part])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, 1000), pa.array([len(s) for s in part], pa.int64()), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), lists(keys[has].ravel(), np.concatenate(([0], np.cumsum(has * bands))))],
                    names=["doc_id", "n_shingles", "h1", "h2", "keys"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(h1, h2, sh): the digest of each row's set, as in ``signatures``, and its sorted shingle hashes as bytes."""

    def run(batches):
        words = WordHashes()
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = shingle_sets(batch.column(0).slice(at, 500).to_pylist(), k, words)
                raw = [s.tobytes() for s in part]
                digest = digests(raw)
                yield pa.RecordBatch.from_arrays([pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array(raw, pa.binary())], names=["h1", "h2", "sh"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "h1 long, h2 long, sh binary")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those (a, b) with den * intersection >= num * union."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                if den * min(len(x), len(y)) < num * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(den * inter >= num * (len(x) + len(y) - inter))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a, b = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def overlaps(sets: list[np.ndarray], xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Intersection sizes of the sets numbered xs[i], ys[i]: pair by pair if they are few, else by products
    of 0/1 matrices over the shingles that occur more than once."""
    if len(xs) <= 2000:
        out = np.zeros(len(xs), np.int64)
        for i, (x, y) in enumerate(zip(xs, ys, strict=True)):
            both = np.concatenate((sets[x], sets[y]))
            both.sort(kind="stable")
            out[i] = (both[1:] == both[:-1]).sum()
        return out
    used, at = np.unique(np.concatenate((xs, ys)), return_inverse=True)
    flat = np.concatenate([sets[u] for u in used])
    row = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    new = np.cumsum(count > 1) - 1
    row, col = row[count[col] > 1], new[col[count[col] > 1]]
    total = np.zeros((len(used), len(used)), np.float32)
    for lo in range(0, int(col.max(initial=-1)) + 1, 8192):
        part = (col >= lo) & (col < lo + 8192)
        m = np.zeros((len(used), 8192), np.float32)
        m[row[part], col[part] - lo] = 1
        total += m @ m.T
    return total[at[: len(xs)], at[len(xs) :]].astype(np.int64)


def bucket_links(key: int, block: np.ndarray, comp: np.ndarray, keys: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Row numbers of one verified link for each two components of a bucket that have one. Pairs that an
    earlier band has together are that band's; rows of two blocks are paired across only."""
    band = int(np.flatnonzero(keys[0] == key)[0])
    order = np.argsort(comp, kind="stable")
    size = np.array([len(s) for s in sets])
    across, found, step = len(np.unique(block)) > 1, {}, 256
    for i in range(0, len(order), step):
        for j in range(i, len(order), step):
            x, y = order[i : i + step], order[j : j + step]
            todo = comp[x][:, None] < comp[y][None, :]
            if across:
                todo &= block[x][:, None] != block[y][None, :]
            if not todo.any():
                continue
            sx, sy = size[x][:, None], size[y][None, :]
            todo &= den * np.minimum(sx, sy) >= num * np.maximum(sx, sy)
            for b in range(band):
                todo &= keys[x, b][:, None] != keys[y, b][None, :]
            px, py = np.nonzero(todo)
            if not len(px):
                continue
            px, py = x[px], y[py]
            inter = overlaps(sets, px, py)
            for k in np.flatnonzero(den * inter >= num * (size[px] + size[py] - inter)):
                found[comp[px[k]], comp[py[k]]] = (int(px[k]), int(py[k]))
    return list(found.values())


def dealt(rows: DataFrame, block_rows: int, block_mb: int) -> DataFrame:
    """``rows`` (key, comp, rep, sh and any others), each once for every block its own is to meet: with block, lo, hi.

    A bucket's components of more than a block have blocks of their own, which need not meet each other; all other
    members share blocks. So a bucket with one large component of n members and m others comes to some
    2 n m / block_rows rows, and not to n^2 / block_rows."""
    blocks = F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("bytes") / (block_mb * 2**20))).cast("int")
    per = rows.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum(F.length("sh")).alias("bytes")).withColumn("own", F.when(blocks > 1, F.col("comp")))
    groups = per.groupBy("key", "own").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).select("key", F.col("own").alias("g"), blocks.alias("nb"))
    upto = Window.partitionBy("key").orderBy(F.col("g").asc_nulls_first())
    groups = groups.withColumn("first", F.sum("nb").over(upto).cast("int") - F.col("nb")).withColumn("total", F.sum("nb").over(Window.partitionBy("key")).cast("int"))
    per = per.select("key", "comp", "own").join(groups.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & F.col("own").eqNullSafe(F.col("g"))).drop("k", "g")
    rows = rows.join(per, ["key", "comp"]).withColumn("block", F.expr("first + int(pmod(xxhash64(rep), nb))"))
    rows = rows.withColumn("other", F.explode(F.expr("filter(sequence(0, total - 1), o -> own IS NULL OR o < first OR o >= first + nb)")))
    return rows.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("own", "nb", "first", "total", "other")


def resolved(rows: DataFrame, num: int, den: int, block_rows: int = 2048, block_mb: int = 32) -> DataFrame:
    """Links (a, b) between components inside buckets, losing none. rows: (key, rep, comp, keys, sh). A
    bucket over ``block_rows`` rows or ``block_mb`` is dealt in blocks, and two blocks meet in one task unless both
    are of one component."""
    rows = dealt(rows, block_rows, block_mb).repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "rep")

    def run(batches):
        at, held = None, []

        def flush():
            if len(held) < 2 or len({r[3] for r in held}) < 2:
                return
            ids, blocks = np.array([r[1] for r in held]), np.array([r[2] for r in held])
            links = bucket_links(at[0], blocks, np.array([r[3] for r in held]), np.array([r[4] for r in held]), [np.frombuffer(r[5], U) for r in held], num, den)
            if links:
                x, y = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y])], names=["a", "b"])

        for batch in batches:
            keys = batch.column("keys").flatten().to_numpy().reshape(len(batch), -1)
            cols = [batch.column(c).to_pylist() for c in ("key", "lo", "hi", "rep", "block", "comp", "sh")]
            for n, (key, lo, hi, rep, block, comp, sh) in enumerate(zip(*cols, strict=True)):
                if at != (key, lo, hi):
                    yield from flush()
                    at, held = (key, lo, hi), []
                held.append((n, rep, block, comp, keys[n].copy(), sh))
        yield from flush()

    return rows.select("key", "lo", "hi", "rep", "block", "comp", "keys", "sh").mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, ws: Workspace, shingle: int, num: int, den: int, bands: int, rows: int, small: int = 250_000) -> tuple[DataFrame, DataFrame]:
    """(signatures as written, groups). A group row (h1, h2, comp, label) is a distinct set that several
    documents have or that links with another: its component and the least doc_id in it. Buckets of several sets
    are broadcast when a count shows at most ``small`` (28 MB), else joined by a shuffle."""
    docs = docs.select("doc_id", "text")
    sig = ws.written(signatures(docs, shingle, bands, rows), "sig")
    some = sig.where("doc_id is not null and n_shingles > 0")
    same = some.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "keys")).alias("m"), F.max("doc_id").alias("hi"))
    # a set's number: any will do that no other set has, and once written it stays
    reps = ws.written(same.select("h1", "h2", F.monotonically_increasing_id().alias("rep"), F.col("m.doc_id").alias("low"), "hi", F.col("m.keys").alias("keys")), "reps")
    buckets = reps.select("rep", F.posexplode("keys").alias("band", "key"))
    leaders = ws.written(buckets.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader"), "leaders")
    # where few buckets have several members, these need no shuffle, and a very large bucket is no single task
    members = ws.written(buckets.join(F.broadcast(leaders) if leaders.count() <= small else leaders, "key").select("key", "band", "rep", "leader"), "members")

    ids = ws.written(members.select("rep").distinct().join(reps.select("rep", "low", "h1", "h2"), "rep"), "ids")
    some_docs = semi_join(docs.withColumn("low", F.col("doc_id").cast("long")), ws.written(ids.select("low").distinct(), "lows"), "low")
    sets = full_sets(some_docs, shingle).join(ids.select("h1", "h2", "rep"), ["h1", "h2"]).dropDuplicates(["h1", "h2"])
    sets = ws.written(sets.select(F.col("rep").alias("id"), "sh"), "sets")
    first = members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    links = ws.written(verified(first, sets, num, den), "links")
    comps = connected_components(links, ws)
    label = ids.select(F.col("rep").alias("id")).join(comps.select(F.col("node").alias("id"), "comp"), "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
    of = members.join(label.withColumnRenamed("id", "rep"), "rep")
    # of buckets with the same members (by two hashes and their number) the first band's serves for all
    same_members = [F.bit_xor(F.xxhash64("rep", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    spans = of.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *same_members, F.count("*").alias("m"), F.min("band").alias("band"))
    open_keys = spans.where("lo <> hi").groupBy("x1", "x2", "m").agg(F.min(F.struct("band", "key")).alias("k")).select("k.key")
    rest = ws.written(of.join(open_keys, "key", "left_semi").select("key", "rep", "comp"), "open")
    if not rest.isEmpty():
        full = rest.join(reps.select("rep", "keys"), "rep").join(sets.withColumnRenamed("id", "rep"), "rep")
        links = ws.written(links.unionByName(resolved(full, num, den)), "links")
        comps = connected_components(links, ws)

    of = reps.select("h1", "h2", "rep", "low", "hi").join(comps.select(F.col("node").alias("rep"), "comp"), "rep", "left")
    of = of.where("comp is not null or hi > low").select("h1", "h2", F.coalesce("comp", "rep").alias("comp"), "low")
    groups = ws.written(of.join(of.groupBy("comp").agg(F.min("low").alias("label")), "comp").select("h1", "h2", "comp", "label"), "groups")
    ws.drop(reps, leaders, members, ids, sets, links, rest)
    return sig, groups


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, bands: int = 36, rows: int = 5) -> DataFrame:
    """Group the rows of ``docs`` (doc_id, text; other columns are ignored) whose word-shingle sets have
    a Jaccard similarity of at least num / den, directly or through others.

    Returns a row for each input row: doc_id, n_shingles, component_id (least doc_id reachable),
    kept (doc_id = component_id). With 36 bands of 5 a pair at similarity 0.8 shares no bucket with
    probability 6e-7; every link is confirmed on full sets. Shingles are told apart by 64-bit hashes, sets
    by digests of 128 bits.

    Null or empty texts have the empty set and link with nothing. Rows with a null doc_id link with
    nothing, have a null component_id and are kept. Rows that share a doc_id are documents of their own:
    each links by its own text alone, so that two of them may be in different groups with one
    component_id. An empty table gives an empty result."""
    ws = Workspace(docs.sparkSession, "minhash")
    sig, groups = grouped(docs, ws, shingle, num, den, bands, rows)
    return labelled(sig, groups).select("doc_id", "n_shingles", "component_id", "kept")


def labelled(sig: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``sig`` with component_id and kept."""
    out = sig.select("doc_id", "n_shingles", "h1", "h2").join(groups.select("h1", "h2", "label"), ["h1", "h2"], "left")
    comp = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("label", "doc_id")).otherwise(F.col("doc_id"))
    return out.withColumn("component_id", comp).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: Columns with a row's digest, between passes only.
DIGEST = ("__set_digest_1", "__set_digest_2")


def with_digest(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        words = WordHashes()
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                digest = digests([s.tobytes() for s in shingle_sets(part.column("text").to_pylist(), k, words)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy())], names=[*part.schema.names, *DIGEST])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in DIGEST)]))


def deduplicated(docs: DataFrame, small: int = 1_000_000, shingle: int = 5, num: int = 80, den: int = 100, bands: int = 36, rows: int = 5) -> DataFrame:
    """The rows of ``docs`` with one document of each group of near_duplicates left, that with the least doc_id.
    Rows with a null doc_id stay. Of a group's rows that share its least doc_id the one with the least text
    stays (of equal texts the one whose columns come first as JSON), and so does one of the rows that repeat
    a doc_id without any word; rows of one doc_id in different groups stay apart. The ids to drop are
    broadcast when a count shows at most ``small`` (16 MB), else joined by a shuffle."""
    ws = Workspace(docs.sparkSession, "dedup")
    sig, groups = grouped(docs, ws, shingle, num, den, bands, rows)
    again = ws.written(sig.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    few = lambda ids: F.broadcast(ids) if ids.count() <= small else ids
    found = labelled(sig, groups).where("not kept").select("doc_id")
    if again.isEmpty():
        return docs.join(few(ws.written(found, "drop")), "doc_id", "left_anti").select(*docs.columns)
    # repeated ids are decided by row, all others by id
    drop = ws.written(found.join(again, "doc_id", "left_anti").unionByName(again), "drop")
    once = docs.join(few(drop), "doc_id", "left_anti").select(*docs.columns)
    twice = with_digest(docs.join(few(again), "doc_id", "left_semi").select(*docs.columns), shingle)
    of = groups.toDF(*DIGEST, "__comp", "__label")
    twice = twice.join(of, list(DIGEST), "left").where(F.coalesce("__label", "doc_id") == F.col("doc_id"))
    alone = F.when(F.col("__comp").isNull(), F.struct(*DIGEST))
    first = Window.partitionBy("doc_id", "__comp", alone).orderBy(F.col("text").asc_nulls_first(), F.to_json(F.struct(*docs.columns)))
    twice = twice.withColumn("__first", F.row_number().over(first)).where("__first = 1")
    return once.unionByName(twice.select(*docs.columns))
