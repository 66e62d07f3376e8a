"""Token-id output: documents as rows of a fixed number of ids, packed by best-fit decreasing.

Texts are encoded with a public byte-level vocabulary and closed by an end id. Documents longer than a row
are cut without loss. Within a block of documents the pieces are placed by falling length, each in the row
with the least room that holds it (found by a search in a segment tree over room sizes). A row comes
with its cumulative segment lengths and the offsets where positions start again from 0.

Blocks are formed by a hash of document id and text and closed at a fixed number of tokens, so a task holds one
block at a time however large the table is, an id (or none) that very many documents share is no hot key,
and the same documents give the same rows.

Rows are written as binary files: id matrices, cumulative segment lengths, positions with their resets, and
the documents behind the segments. Reading them gives the rows back.
"""

from __future__ import annotations

import base64
import uuid
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .binpack import cut, pack
from .common import Workspace, n_partitions, opened, small_batches

#: Where the public vocabularies lie on this box; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the public pre-tokenizer pattern that goes with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_ID = 50256
ROW = 2048
BLOCK_TOKENS = 4_000_000
#: Characters of text that make a block of documents on average.
BLOCK_CHARS = 8_000_000


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file's bytes, read where the driver runs; tasks get them with their closure."""
    with open(path, "rb") as f:
        return f.read()


def encoder(vocabulary: bytes, pattern: str = PATTERN):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pack_block(docs: list[tuple[int | None, np.ndarray]], row: int, end_id: int) -> list[tuple]:
    """Rows of one block: (ids, n_tokens, cu_seqlens, doc_ids, starts). Free places hold ``end_id``."""
    pieces = sorted(((size, i, start) for i, (_, ids) in enumerate(docs) for start, size in cut(len(ids), row)), key=lambda p: (-p[0], p[1], p[2]))
    at, offset, bins = pack([p[0] for p in pieces], (row,), 0)
    ids = np.full((len(bins), row), end_id, np.uint32)
    parts: list[list[tuple[int, int, int, int]]] = [[] for _ in bins]
    for (size, i, start), b, o in zip(pieces, at, offset, strict=True):
        ids[b, o : o + size] = docs[i][1][start : start + size]
        parts[b].append((o, size, i, start))
    out = []
    for b, p in enumerate(parts):
        p.sort()
        ends = [x[0] + x[1] for x in p]
        out.append((ids[b], ends[-1], [0, *ends], [docs[x[2]][0] for x in p], [x[3] for x in p]))
    return out


def position_ids(cu_seqlens: list[int], row: int = ROW) -> np.ndarray:
    """Positions of a row's ids: counted from 0 in each segment, 0 in free places."""
    cu = np.asarray(cu_seqlens)
    out = np.zeros(row, np.int32)
    out[: cu[-1]] = np.arange(cu[-1]) - np.repeat(cu[:-1], np.diff(cu))
    return out


def token_rows(docs: DataFrame, vocabulary: str = VOCABULARY, row: int = ROW, end_id: int = END_ID, pattern: str = PATTERN, block_tokens: int = BLOCK_TOKENS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Packed rows of ``docs`` (doc_id, text; other columns are ignored): row_id, ids (``row`` ids as bytes,
    little-endian, 2 bytes each if the vocabulary allows, else 4), id_bytes, n_tokens, cu_seqlens (from 0),
    resets (offsets where positions start at 0), doc_ids and starts (each segment's document and the place
    of its first id in the document).

    Null and empty texts are a single end id. Null doc_ids stay null; repeated rows are packed each. An
    empty table gives no rows."""
    data = read_vocabulary(vocabulary)
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(chars) // block_chars))
    rows = docs.withColumn("block", F.expr(f"int(pmod(xxhash64(doc_id, text), {blocks}))"))
    rows = rows.repartitionById(min(blocks, 4 * n_partitions(docs.sparkSession)), "block").sortWithinPartitions("block", "doc_id", "text")
    width = 2 if end_id < 65536 and data.count(b"\n") <= 65536 else 4
    kind = np.dtype("<u2" if width == 2 else "<u4")

    def run(batches):
        enc = encoder(data, pattern)
        at, first, held, total = None, 0, [], 0

        def done():
            packed = pack_block(held, row, end_id)
            for lo in range(0, len(packed), 500):
                part = packed[lo : lo + 500]
                cols = [[(at << 32) + first + lo + i for i in range(len(part))], [p[0].astype(kind).tobytes() for p in part], [width] * len(part), [p[1] for p in part], [p[2] for p in part], [p[2][:-1] for p in part], [p[3] for p in part], [p[4] for p in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SCHEMA, strict=True)], schema=SCHEMA)
            return len(packed)

        for batch in batches:
            for doc_id, text, block in zip(*batch.columns, strict=True):
                block = block.as_py()
                if held and (block != at or total >= block_tokens):
                    n = yield from done()
                    first, held, total = first + n, [], 0
                if block != at:
                    at, first = block, 0
                ids = np.array([*enc.encode_ordinary(text.as_py()), end_id], np.uint32)
                held.append((doc_id.as_py(), ids))
                total += len(ids)
        if held:
            yield from done()

    return rows.select("doc_id", "text", "block").mapInArrow(run, ROWS)


#: Columns of packed rows.
SCHEMA = pa.schema([("row_id", pa.int64()), ("ids", pa.binary()), ("id_bytes", pa.int32()), ("n_tokens", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())), ("resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))])
ROWS = "row_id long, ids binary, id_bytes int, n_tokens int, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, starts array<long>"
#: Files by ending: the id matrix, row after row; for each row its number of segments and the cumulative lengths from 0
#: (int32); for each row its number of resets and the offsets where positions start again from 0 (int32); for each row
#: its id, then for each segment whether it has a document id, that id, and where it starts in the document (int64).
FILES = ("ids", "cu", "pos", "doc")
FILE_ROWS = 65_536


def write_token_files(rows: DataFrame, folder: str, file_rows: int = FILE_ROWS) -> DataFrame:
    """Write packed rows as binary files (see FILES) below ``folder``, which all executors reach. Returns (path
    without ending, rows, row, id_bytes). A task names its files afresh at every attempt; only files
    named there count, so a repeated task leaves at most unread ones."""

    def run(batches):
        fs, base = opened(folder)
        files = name = None
        n = shape = 0

        def close():
            files.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "rows": [n], **dict(zip(("row", "id_bytes"), ([v] for v in shape), strict=True))}, SUMMARY)

        for batch in batches:
            for row_id, ids, width, cu, resets, docs, starts in zip(*(batch.column(c).to_pylist() for c in ("row_id", "ids", "id_bytes", "cu_seqlens", "resets", "doc_ids", "starts")), strict=True):
                row = len(ids) // width
                if files is None:
                    fs.create_dir(base, recursive=True)
                    name, n, shape, files = uuid.uuid4().hex, 0, (row, width), ExitStack()
                    out = {e: files.enter_context(fs.open_output_stream(f"{base}/{name}.{e}", compression=None)) for e in FILES}
                out["ids"].write(ids)
                out["pos"].write(np.array([len(resets), *resets], "<i4").tobytes())
                out["cu"].write(np.array([len(cu) - 1, *cu], "<i4").tobytes())
                out["doc"].write(np.array([row_id, *(x for d, s in zip(docs, starts, strict=True) for x in (d is not None, d or 0, s))], "<i8").tobytes())
                n += 1
                if n == file_rows:
                    yield close()
                    files = None
        if files is not None:
            yield close()

    return rows.select("row_id", "ids", "id_bytes", "cu_seqlens", "resets", "doc_ids", "starts").mapInArrow(run, "path string, rows long, row int, id_bytes int")


SUMMARY = pa.schema([("path", pa.string()), ("rows", pa.int64()), ("row", pa.int32()), ("id_bytes", pa.int32())])


def read_token_files(files: DataFrame, batch_rows: int = 256) -> DataFrame:
    """The packed rows of the files that ``files`` names, read back. Resets and cumulative lengths in
    the files must agree, or reading raises."""

    def run(batches):
        for batch in batches:
            for path, n, row, width in zip(*(batch.column(c).to_pylist() for c in SUMMARY.names), strict=True):
                fs, base = opened(path)
                with ExitStack() as stack:
                    ids, cus, poss, docs = (stack.enter_context(fs.open_input_stream(f"{base}.{e}", compression=None, buffer_size=1 << 20)) for e in FILES)
                    for at in range(0, n, batch_rows):
                        cols = [[] for _ in SCHEMA]
                        for _ in range(min(batch_rows, n - at)):
                            k, resets = int.from_bytes(cus.read(4), "little"), np.frombuffer(poss.read(4 * int.from_bytes(poss.read(4), "little")), "<i4")
                            cu = np.frombuffer(cus.read(4 * (k + 1)), "<i4")
                            doc = np.frombuffer(docs.read(8 * (1 + 3 * k)), "<i8")
                            if not np.array_equal(resets, cu[:-1]):
                                raise ValueError(f"positions and segment lengths of row {doc[0]} in {path} differ")
                            seg = doc[1:].reshape(k, 3)
                            values = (doc[0], ids.read(row * width), width, cu[-1], cu, resets, [d if has else None for has, d, _ in seg.tolist()], seg[:, 2])
                            for c, v in zip(cols, values, strict=True):
                                c.append(v)
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SCHEMA, strict=True)], schema=SCHEMA)

    spread = files.repartition(n_partitions(files.sparkSession), "path")
    return spread.select(*SUMMARY.names).mapInArrow(run, ROWS)


def round_trip(docs: DataFrame, folder: str | None = None, **how) -> DataFrame:
    """Pack ``docs`` (see token_rows, which takes ``how``), write the binary files and read them back: the rows."""
    ws = Workspace(docs.sparkSession, "tokens")
    files = ws.written(write_token_files(token_rows(docs, **how), folder or ws.folder("files")), "files")
    return read_token_files(files)
