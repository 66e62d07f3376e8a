"""Best-fit packing with several permitted sequence lengths.

Pieces are taken by falling length. Each goes to the open bin with the least room that still holds it,
found by a search in a segment tree over room sizes. Where none does, a bin of the least-cost permitted
length is opened: the one whose cost per token is least when filled, as far as pieces yet to come can
fill it. At the end every bin is downsized to the shortest permitted length for its contents. Pieces longer
than the longest length are cut without loss.

Documents are dealt to blocks of bounded size by a hash, and each block is packed by itself, so that the
work is spread and no list of all documents exists anywhere. Rows alike (one id, or none, for very many
documents of one length) are counted first and dealt by the thousand.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_partitions

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Tokens that opening a sequence costs besides its length.
OVERHEAD = 64
BLOCK_ROWS = 100_000
#: Rows alike in id and count that travel as one row.
COPIES = 1000


class Rooms:
    """Bins by room left: a segment tree whose leaves count the bins of each room size."""

    def __init__(self, most: int):
        self.size = 1 << max(1, most).bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, b: int) -> None:
        self.bins[room].append(b)
        if len(self.bins[room]) == 1:
            i = self.size + room
            while i:
                self.count[i] += 1
                i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (room, bin) with the least room that is at least ``least``."""
        i = self.size + least
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        b = self.bins[room].pop()
        if not self.bins[room]:
            while i:
                self.count[i] -= 1
                i >>= 1
        return room, b


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Pack pieces, given by falling size (each between 1 and the longest length). Returns each piece's bin
    and offset in it, and the bins' lengths."""
    lengths = tuple(sorted(lengths))
    rooms = Rooms(lengths[-1])
    up = sizes[::-1]
    below = [0]
    for s in up:
        below.append(below[-1] + s)
    at, offset, used, cap = [], [], [], []
    for k, s in enumerate(sizes):
        found = rooms.take(s)
        if found is None:
            b, best = len(used), None
            todo = len(sizes) - k - 1
            for c in lengths[bisect_left(lengths, s) :]:
                # what pieces still to come, each short enough for the rest of the bin, can add
                fit = min(todo, bisect_left(up, c - s + 1))
                cost = (c + overhead) / (s + min(c - s, below[fit]))
                if best is None or cost < best[0]:
                    best = (cost, c)
            used.append(0)
            cap.append(best[1])
            room = best[1]
        else:
            room, b = found
        at.append(b)
        offset.append(used[b])
        used[b] += s
        if room > s:
            rooms.add(room - s, b)
    return at, offset, [lengths[bisect_left(lengths, u)] for u in used]


def cut(n: int, longest: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    for start in range(0, n, longest):
        yield start, min(longest, n - start)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("bin_id", pa.int64()), ("bin_length", pa.int32()), ("offset", pa.int32())])


def packed(docs: DataFrame, tokens: str = "n_tokens", lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pack documents (doc_id and a token count in column ``tokens``; other columns are ignored). A row for
    each piece: doc_id, piece (from 0), start and length in the document's tokens, bin_id, bin_length
    (permitted length of the bin), offset of the piece in the bin.

    A document without tokens (or with a null or negative count) has one row of length 0 and no bin. Null
    and repeated doc_ids are packed like others. A block over twice ``block_rows`` rows is packed in parts.
    An empty table gives no rows."""
    longest = max(lengths)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    blocks = max(1, -(-docs.select("doc_id").count() // block_rows))
    alike = docs.groupBy("doc_id", "n").agg(F.count("*").alias("c")).withColumn("part", F.explode(F.expr(f"sequence(0L, (c - 1) div {COPIES})")))
    rows = alike.select("doc_id", "n", "part", F.expr(f"int(least({COPIES}L, c - part * {COPIES}))").alias("copies"), F.expr(f"int(pmod(xxhash64(doc_id, n, part), {blocks}))").alias("block"))
    rows = rows.repartitionById(min(blocks, 4 * n_partitions(docs.sparkSession)), "block").sortWithinPartitions("block", "doc_id", "n", "part")

    def done(block: int, first: int, held: list[tuple[int | None, int]]):
        pieces = sorted(((size, -i, j, start) for i, (_, n) in enumerate(held) for j, (start, size) in enumerate(cut(n, longest))), key=lambda p: (-p[0], -p[1], p[2]))
        at, offset, caps = pack([p[0] for p in pieces], lengths, overhead)
        base = (block << 32) + first
        cols = [[held[-p[1]][0] for p in pieces], [p[2] for p in pieces], [p[3] for p in pieces], [p[0] for p in pieces], [base + b for b in at], [caps[b] for b in at], offset]
        none = [d for d, n in held if not n]
        for c, v in zip(cols, (None, 0, 0, 0, None, None, None), strict=True):
            c += none if c is cols[0] else [v] * len(none)
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SCHEMA, strict=True)], schema=SCHEMA)
        return batch, first + len(caps)

    def run(batches):
        at, first, held = None, 0, []
        for batch in batches:
            for doc_id, n, copies, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (block != at or len(held) >= 2 * block_rows):
                    out, first = done(at, first, held)
                    yield out
                    held = []
                if block != at:
                    at, first = block, 0
                held += [(doc_id, n)] * copies
        if held:
            yield done(at, first, held)[0]

    return rows.select("doc_id", "n", "copies", "block").mapInArrow(run, "doc_id long, piece int, start long, length long, bin_id long, bin_length int, offset int")
