"""Document fingerprints by I-Match with randomised lexicons.

The lexicon holds the terms of the whole collection whose document frequency lies in a band, which is a
band of inverse document frequency; of copies and near copies one is counted. Where a text's rarer terms
outnumber its lexicon terms they join these, and its commoner ones where both are few. A text's distinct
lexicon terms are sorted and hashed, all of them and once for each of many random subsets of the lexicon: a
subset of level l keeps a term with probability 2^-(l+1), and one of level l + 1 is part of it. Of the levels a
fingerprint holds the thinnest at which half the subsets keep a term, and all thinner ones: long texts are
compared by thin subsets, short ones by thick ones, and after an edit some subsets still hold the same terms.

Words are split and hashed by arrays, many texts at a time.
"""

from __future__ import annotations

import zlib
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, n_partitions, pieces, small_batches
from .minhash import GOLDEN, U, mix

LEVELS, SUBSETS = 32, 16
#: A-Z as a-z; ASCII control characters and punctuation as blanks.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SALTS = mix(np.arange(1, SUBSETS + 1).astype(U) * U(0x632BE59BD9B4E019)) | U(1)
#: Factors of a word's bytes by value and by place (places repeat after PLACES).
PLACES = 4096
BYTE_FACTORS = mix(np.arange(1, 257).astype(U) * U(0x9FB21C651E98DF25))
PLACE_FACTORS = mix(np.arange(1, PLACES + 1).astype(U) * U(0xD6E8FEB86659FD93))
#: Bytes that are hashed at a time.
SLICE_BYTES = 1 << 20

#: Where a null id stands: before all others.
FIRST = -(2**63)
#: Near copies share a band of BAND_ROWS least hashes of runs of SHINGLE words.
BANDS, BAND_ROWS, SHINGLE = 12, 3, 4
RUN_MULTS = mix(np.arange(1, SHINGLE + 1).astype(U) * GOLDEN) | U(1)
#: Where the bins of run hashes begin; a bin's least hash is a slot, or the next bin's where it is empty.
BINS = np.arange(BANDS * BAND_ROWS).astype(U) * U(2**64 // (BANDS * BAND_ROWS))
#: Candidate terms that are broadcast at most.
MOST_TERMS = 1 << 20
#: Classes of terms.
LEXICON, RARE, COMMON = 1, 2, 3


def hashed_slice(raw: bytes) -> np.ndarray:
    """64-bit hashes of the blank-separated words of folded bytes, in order."""
    x = np.frombuffer(raw, np.uint8)
    solid = x != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).view(np.int8)))
    size = edge[1::2] - edge[::2]
    if not len(size):
        return np.empty(0, U)
    first = np.cumsum(size) - size
    x = x[solid]
    place = (np.arange(len(x)) - np.repeat(first, size)) % PLACES
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(BYTE_FACTORS[x] * PLACE_FACTORS[place], first) + size.astype(U) * GOLDEN)


def hashed_words(raw: bytes) -> np.ndarray:
    """The same for any length, in slices that end at blanks."""
    out, at = [], 0
    while at < len(raw):
        end = at + SLICE_BYTES
        if end < len(raw):
            cut = raw.rfind(b" ", at, end)
            cut = cut if cut > at else raw.find(b" ", end)
            end = len(raw) if cut < 0 else cut
        out.append(hashed_slice(raw[at:end]))
        at = end
    return np.concatenate(out) if out else np.empty(0, U)


def term_sequences(texts: list[str]) -> list[np.ndarray]:
    """For each text the hashes of its terms, in order."""
    out, held, size = [], [], 0

    def flush():
        raw = b" ".join(held)
        ends = np.cumsum([len(h) + 1 for h in held])
        x = np.frombuffer(raw, np.uint8) != 32
        # words that begin before each text's end
        begins = np.flatnonzero(x & ~np.concatenate(([False], x[:-1])))
        bounds = [0, *np.searchsorted(begins, ends).tolist()]
        h = hashed_words(raw)
        return [h[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    for t in texts:
        raw = t.encode("utf-8", "surrogatepass").translate(FOLD)
        if held and size + len(raw) > SLICE_BYTES:
            out += flush()
            held, size = [], 0
        held.append(raw)
        size += len(raw) + 1
    return out + flush() if held else out


def digest_of(seq: np.ndarray) -> int:
    return int.from_bytes(blake2b(seq.tobytes(), digest_size=8).digest(), "little", signed=True)


def band_keys(seq: np.ndarray) -> np.ndarray:
    """Keys by band; near copies share one of them. One permutation serves all slots: a slot is the least
    hash of a run of words in its bin, or of the next one that has any."""
    k = min(SHINGLE, len(seq))
    with np.errstate(over="ignore"):
        runs = np.zeros(len(seq) - k + 1, U)
        for i in range(k):
            runs += seq[i : len(seq) - k + 1 + i] * RUN_MULTS[i]
        runs = mix(runs)
        runs.sort()
        least = runs[np.searchsorted(runs, BINS) % len(runs)]
        keys = np.arange(1, BANDS + 1).astype(U)
        for column in least.reshape(BANDS, BAND_ROWS).T:
            keys = mix(keys * GOLDEN + column)
        return keys


def is_in(t: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of ``t`` are in the sorted array ``among``."""
    return among[np.minimum(np.searchsorted(among, t), len(among) - 1)] == t if len(among) else np.zeros(len(t), bool)


def chosen(seqs: list[np.ndarray], lexicon: np.ndarray, common: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct terms that each text is hashed by: those of the lexicon; with its rarer terms if these
    are more; with its common ones if those are less than a quarter of these. An edit that tips a balance
    leaves the smaller choice within the larger one."""
    terms = [np.unique(q) for q in seqs]
    flat = np.concatenate(terms) if terms else np.empty(0, U)
    kinds = np.where(is_in(flat, lexicon), LEXICON, np.where(is_in(flat, common), COMMON, RARE)).astype(np.int8)
    out, at = [], 0
    for t in terms:
        kind = kinds[at : at + len(t)]
        at += len(t)
        n = np.bincount(kind, minlength=4).tolist()
        keep = kind == LEXICON
        if n[RARE] > n[LEXICON]:
            keep |= kind == RARE
        if 4 * (n[LEXICON] + n[RARE] * (n[RARE] > n[LEXICON])) < n[COMMON]:
            keep |= kind == COMMON
        out.append(t[keep])
    return out


def set_hash(t: np.ndarray) -> int:
    """A 64-bit hash of sorted terms."""
    return int.from_bytes(blake2b(t.tobytes(), digest_size=8).digest(), "big")


def subset_hashes(t: np.ndarray) -> tuple[int, dict[tuple[int, int], int]] | None:
    """(hash of all terms, hashes of the terms in each subset that keeps any, by level and subset) of sorted
    distinct terms; None for none. Levels thicker than the text's own (the thinnest at which half of its
    subsets keep a term) are left out."""
    if not len(t):
        return None
    with np.errstate(over="ignore"):
        u = t[:, None] * SALTS[None, :]
    # a subset keeps terms up to the level that the leading zero bits of its least value allow
    deepest = sorted((64 - int(v).bit_length() for v in u.min(0)), reverse=True)
    own = max(0, min(deepest[SUBSETS // 2 - 1], LEVELS) - 1)
    rows, subsets = np.nonzero(u < U(1 << (63 - own)))
    held: dict[tuple[int, int], list[int]] = {}
    for i, s, v in zip(rows.tolist(), subsets.tolist(), u[rows, subsets].tolist(), strict=True):
        for level in range(own, min(64 - v.bit_length(), LEVELS)):
            held.setdefault((level, s), []).append(i)
    return set_hash(t), {k: set_hash(t[i]) for k, i in held.items()}


Hashes = tuple[int, dict[tuple[int, int], int]]


def likeness(a: Hashes | None, b: Hashes | None, same: bool) -> float:
    """Share of equal hashes among the subsets that keep a term of either text, at the thinnest level where at
    least half the subsets do; 0 to 1, and 1 for equal fingerprints."""
    if same:
        return 1.0
    if a is None or b is None:
        return 0.0
    by_level: dict[int, list[int]] = {}
    for k in a[1].keys() | b[1].keys():
        n = by_level.setdefault(k[0], [0, 0])
        n[0] += 1
        n[1] += a[1].get(k) == b[1].get(k)
    level = max((v for v, n in by_level.items() if 2 * n[0] >= SUBSETS), default=0)
    n, equal = by_level.get(level, (0, 0))
    return equal / n if n else 0.0


def written_out(text: str, hashes: Hashes | None) -> str:
    """The fingerprint: the hash of all terms, then of each subset its level, number and hash, in hex digits, by
    commas; for a text without terms "=" and a hash of its characters instead."""
    if hashes is None:
        return "=" + blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
    return ",".join([f"{hashes[0]:016x}", *(f"{level:02x}{s:x}{h:016x}" for (level, s), h in sorted(hashes[1].items()))])


def bands_of(docs: DataFrame, low: float = 0.001, high: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the terms that between ``low`` and ``high`` of all documents have (and at least
    two), and of those that more have. Of copies and near copies only such count as have the least digest
    in each of their bands' buckets: one of each group at least, and more of it only by chance. Texts without
    terms don't count.

    There are at most (mean number of distinct terms a document) / low such terms, whatever the number of
    documents, so they fit the driver and a broadcast."""
    spark = docs.sparkSession
    work = Workspace(spark, "imatch")
    texts = docs.select(F.col("text").cast("string"))

    def sketched(batches):
        for batch in pieces(batches):
            seqs = [q for q in term_sequences([t for t in batch.column(0).to_pylist() if t]) if len(q)]
            if seqs:
                t, n = np.unique(np.concatenate([np.unique(q) for q in seqs]), return_counts=True)
                slot = np.concatenate([np.zeros(len(t), np.int32), np.tile(np.arange(1, BANDS + 1, dtype=np.int32), len(seqs))])
                key = np.concatenate([t, *map(band_keys, seqs)]).view(np.int64)
                digest = np.concatenate([np.zeros(len(t), np.int64), np.repeat(np.array([digest_of(q) for q in seqs]), BANDS)])
                n = np.concatenate([n, np.ones(len(seqs) * BANDS, np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(key), pa.array(n), pa.array(digest)], names=["slot", "key", "n", "digest"])

    rows = texts.mapInArrow(sketched, "slot int, key long, n long, digest long").groupBy("slot", "key").agg(F.sum("n").alias("n"), F.min("digest").alias("digest"))
    is_term = F.col("slot") == 0
    rows = work.written(rows.where(~is_term | (F.col("n") > 1)).select(F.when(is_term, F.col("key")).alias("term"), F.when(is_term, F.col("n")).alias("n"), F.when(~is_term, F.col("digest")).alias("digest")), "sketches")
    firsts = work.written(rows.where("digest is not null").groupBy("digest").count().where(F.col("count") == BANDS).select("digest"), "firsts")
    n = firsts.count()
    often = rows.where(F.col("n") >= max(2, low * n)).select("term")
    names = np.sort(often.toArrow().column(0).to_numpy().astype(np.int64).view(U)) if often.count() <= MOST_TERMS else None
    kind = np.dtype(np.uint64 if names is None else np.uint16 if len(names) < 1 << 16 else np.uint32)
    named = None if names is None else spark.sparkContext.broadcast(names)

    def listed(batches):
        seen = set()
        for batch in pieces(batches):
            digest, terms = [], []
            for q in term_sequences([t for t in batch.column(0).to_pylist() if t]):
                if not len(q) or (d := digest_of(q)) in seen:
                    continue
                if len(seen) > 300_000:
                    seen.clear()
                seen.add(d)
                q = np.unique(q)
                if named is not None:
                    q = np.searchsorted(named.value, q[is_in(q, named.value)]).astype(kind)
                digest.append(d)
                terms.append(q.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.int64()), pa.array(terms, pa.binary())], names=["digest", "terms"])

    def counts(batches):
        for batch in pieces(batches):
            t, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), return_counts=True)
            t = (t if named is None else named.value[t]).astype(U).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n)], names=["term", "n"])

    once = texts.mapInArrow(listed, "digest long, terms binary").join(firsts, "digest", "left_semi").dropDuplicates(["digest"])
    df = once.select("terms").mapInArrow(counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))
    kept = df.where(F.col("df") >= max(2, low * n)).select("term", (F.col("df") > max(2, high * n)).alias("common")).toArrow()
    work.drop_all()
    t, common = kept.column(0).to_numpy().astype(np.int64).view(U), kept.column(1).to_numpy().astype(bool)
    return np.sort(t[~common]), np.sort(t[common])


def lexicon_of(docs: DataFrame, low: float = 0.001, high: float = 0.05) -> np.ndarray:
    """The terms within the band alone."""
    return bands_of(docs, low, high)[0]


def with_next(docs: DataFrame, run, schema: str) -> DataFrame:
    """Apply ``run`` to iterators of batches (doc_id, z, copy, pid), z the text's bytes by zlib, in which each
    range (pid) of the order by id, then hash of the text is in ascending order and ends with a copy of the row
    that follows it in the whole order (after the last row: the first). One shuffle of the compressed rows; the
    driver holds two numbers for each range, of which there are four for each shuffle partition. An id that
    very many rows share, as null may be, is split by the hash."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("k", F.coalesce(F.col("doc_id"), F.lit(FIRST))).withColumn("t", F.xxhash64("text"))
    parts = n_partitions(spark)
    ranges = 4 * parts
    cuts = docs.approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.25 / ranges)
    cut_k, times = np.unique(np.array(cuts, np.float64).astype(np.int64), return_counts=True)
    # a key that several quantiles fall on is cut as often, evenly over the hashes
    cut_t = np.concatenate([np.array([FIRST + (j << 64) // n for j in range(n)], np.int64) for n in times.tolist()]) if len(cut_k) else np.empty(0, np.int64)
    cut_k, hot = np.repeat(cut_k, times), cut_k[times > 1]

    def range_of(k: np.ndarray, t: np.ndarray) -> pa.Array:
        at = np.searchsorted(cut_k, k, "right")
        for h in hot[is_in(hot, np.unique(k))]:
            lo, hi, own = *np.searchsorted(cut_k, [h, h + 1]), k == h
            at[own] = lo + np.searchsorted(cut_t[lo:hi], t[own], "right")
        return pa.array(at.astype(np.int32))

    def keyed(batches):
        for batch in batches:
            k, t = batch.columns
            yield pa.RecordBatch.from_arrays([k, t, range_of(k.to_numpy(), t.to_numpy())], names=["k", "t", "pid"])

    def zipped(batches):
        for batch in pieces(batches):
            doc_id, text, k, t = batch.columns
            z = [zlib.compress(x.encode("utf-8", "surrogatepass"), 1) for x in text.to_pylist()]
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(z, pa.binary()), k, t, range_of(k.to_numpy(), t.to_numpy())], names=["doc_id", "z", "k", "t", "pid"])

    firsts = docs.select("k", "t").mapInArrow(keyed, "k long, t long, pid int").groupBy("pid").agg(F.min(F.struct("k", "t")).alias("head"))
    heads = sorted((r.pid, r.head.k, r.head.t) for r in firsts.collect())
    back = spark.createDataFrame([(k, t, heads[i - 1][0]) for i, (_, k, t) in enumerate(heads)], "k long, t long, before int")
    at = F.explode(F.filter(F.array(F.struct(F.col("pid"), F.lit(False).alias("copy")), F.struct(F.col("before").alias("pid"), F.lit(True).alias("copy"))), lambda s: s["pid"].isNotNull())).alias("at")
    rows = docs.select("doc_id", "text", "k", "t").mapInArrow(zipped, "doc_id long, z binary, k long, t long, pid int")
    rows = rows.join(F.broadcast(back), ["k", "t"], "left").select("doc_id", "z", "k", "t", at).select("doc_id", "z", "k", "t", "at.*")
    rows = rows.repartition(parts, "pid").sortWithinPartitions("pid", "copy", "k", "t", "z")
    return rows.select("doc_id", "z", "copy", "pid").mapInArrow(run, schema)


def fingerprints(docs: DataFrame, low: float = 0.001, high: float = 0.05) -> DataFrame:
    """Fingerprints of each row's text and of its edited text, for every row of ``docs`` (doc_id, text; other
    columns are ignored; a null text counts as empty; null ids come first; the order of rows with equal ids
    depends on their texts alone).

    The edited text has its last floor(n_chars / 4) code points replaced by as many first ones (or all)
    of the next row's text. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next. The next row of a lone row is itself. An empty table gives no rows."""
    small_batches(docs.sparkSession)
    lexicon = docs.sparkSession.sparkContext.broadcast(bands_of(docs, low, high))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def printed(texts: list[str]) -> list[tuple[str, Hashes | None]]:
        hashes = [subset_hashes(t) for t in chosen(term_sequences(texts), *lexicon.value)]
        return [(written_out(t, h), h) for t, h in zip(texts, hashes, strict=True)]

    def run(batches):
        before = None  # (doc_id, text, pid, copy, fingerprint and hashes) of the row before
        for batch in pieces(batches, 500):
            rows = [] if before is None else [before]
            ids, zs, copies, pids = (c.to_pylist() for c in batch.columns)
            texts = [zlib.decompress(z).decode("utf-8", "surrogatepass") for z in zs]
            rows += zip(ids, texts, pids, copies, printed(texts), strict=True)
            before = rows[-1] if rows else None
            pairs = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if x[2] == y[2] and not x[3]]
            edited = [x[1][: len(x[1]) - len(x[1]) // 4] + y[1][: len(x[1]) // 4] for x, y in pairs]
            out = []
            for (x, y), e, (ef, eh) in zip(pairs, edited, printed(edited), strict=True):
                (f, h), (nf, nh) = x[4], y[4]
                out.append((x[0], len(x[1]), sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), f, ef, likeness(h, eh, f == ef), likeness(h, nh, f == nf)))
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return with_next(docs.select("doc_id", "text"), run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
