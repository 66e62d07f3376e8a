"""WARC archives: writer, monolithic gzip normaliser and indexed reader.

The writer makes archives that are one gzip stream each, the form in which many crawls arrive. Such a file
can't be entered in the middle. The normaliser inflates each stream once, rewrites every record as a gzip
member of its own and leaves a sidecar index of offsets beside it, by which the reader fetches records.

Files go to a folder that driver and executors share, through Arrow's file systems. A task names its
files afresh at every attempt and a file counts only once its name is in the table the stage wrote, so
a lost executor or a repeated task leaves at most an unread file.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, n_partitions, opened, remove

CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
GZIP = 31  # zlib's window bits for a gzip wrapper
INDEX = "archive string, offset long, length long, record_id string, record_type string, page_id long, url string"


def headed(lines: list[tuple[str, object]], first: str) -> bytes:
    safe = [(k, str(v).replace("\r", "%0D").replace("\n", "%0A")) for k, v in lines if v is not None]
    return "".join([first, "\r\n", *(f"{k}: {v}\r\n" for k, v in safe), "\r\n"]).encode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, first_id: int | None, date: str = DATE) -> bytes:
    """A response record, or, where ``first_id`` is given, a revisit of that page's equal payload."""
    digest = sha256(payload).hexdigest()
    head = [("WARC-Type", "response" if first_id is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", len(payload)), ("X-Page-Id", page_id)]
    block = headed([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))], "HTTP/1.1 200 OK")
    if first_id is None:
        block += payload
    else:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first_id, digest)), ("X-Refers-To-Page-Id", first_id)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return headed(head, "WARC/1.1") + block + CRLF + CRLF


def fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; continuation lines are joined on."""
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, v = line.partition(":")
            last = last.strip().lower()
            out[last] = v.strip()
    return out


class Inflater:
    """Reads a gzip file of one or more members front to back, holding no more than asked for."""

    def __init__(self, raw, step: int = 1 << 18):
        self.raw, self.step, self.z, self.buf, self.rest = raw, step, zlib.decompressobj(GZIP), bytearray(), b""

    def more(self) -> bool:
        if self.z.eof:
            self.rest = self.z.unused_data or self.raw.read(self.step)
            if not self.rest:
                return False
            self.z = zlib.decompressobj(GZIP)
        data = self.rest or self.z.unconsumed_tail or self.raw.read(self.step)
        self.rest = b""
        if not data:
            raise EOFError("truncated gzip stream")
        self.buf += self.z.decompress(data, 4 * self.step)
        return True

    def head(self) -> bytes | None:
        at = 0
        while (i := self.buf.find(b"\r\n\r\n", max(0, at - 3))) < 0:
            at = len(self.buf)
            if not self.more():
                if self.buf:
                    raise EOFError("truncated record header")
                return None
        out = bytes(self.buf[: i + 4])
        del self.buf[: i + 4]
        return out

    def body(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buf and not self.more():
                raise EOFError("truncated record")
            part = bytes(self.buf[:n])
            del self.buf[:n]
            n -= len(part)
            yield part


def normalise(source: str, target: str, level: int = 1) -> Iterator[tuple]:
    """Rewrite the archive ``source`` to ``target`` with a member for each record, and its index to
    ``target`` + ".idx" (a JSON line a record). Yields the index rows."""
    fs, path = opened(source)
    to_fs, to = opened(target)
    offset = 0
    with fs.open_input_stream(path, compression=None) as raw, to_fs.open_output_stream(to, compression=None) as out, to_fs.open_output_stream(to + ".idx", compression=None) as idx:
        inflater = Inflater(raw)
        while (head := inflater.head()) is not None:
            h = fields(head)
            z = zlib.compressobj(level, zlib.DEFLATED, GZIP)
            start = offset
            for piece in chain([head], inflater.body(int(h["content-length"]) + 4)):
                if data := z.compress(piece):
                    out.write(data)
            out.write(z.flush())
            offset = out.tell()
            row = (target, start, offset - start, h.get("warc-record-id"), h.get("warc-type"), int(h["x-page-id"]) if "x-page-id" in h else None, h.get("warc-target-uri"))
            idx.write(json.dumps(dict(zip(("archive", "offset", "length", "record_id", "record_type", "page_id", "url"), (target.rsplit("/", 1)[-1], *row[1:]), strict=True))).encode() + b"\n")
            yield row


def fetch(raw, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Header fields and HTTP payload of the member at ``offset``."""
    raw.seek(offset)
    data = zlib.decompress(raw.read(length), GZIP)
    head, _, rest = data.partition(b"\r\n\r\n")
    h = fields(head)
    return h, rest[: int(h["content-length"])].partition(b"\r\n\r\n")[2]


def arrays(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def write_archives(pages: DataFrame, folder: str, ws: Workspace, min_revisit: int = 100, max_bytes: int = 1 << 30, level: int = 1, small: int = 200_000) -> DataFrame:
    """Write (page_id, url, html) as monolithic gzip WARC files below ``folder``; returns (path, records).
    Payloads of at least ``min_revisit`` bytes that several pages share are stored once. Their digests are
    broadcast if a count shows at most ``small`` of them (10 MB), else joined by a shuffle."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.unhex(F.sha2("html", 256)))
    long_ones = pages.where(F.octet_length("html") >= min_revisit)
    shared = ws.written(long_ones.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "shared")
    rows = pages.join(F.broadcast(shared) if shared.count() <= small else shared, "digest", "left")
    rows = rows.select("page_id", "url", "html", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("first"))
    done = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def run(batches):
        fs, base = opened(folder)
        out = z = uri = None
        n = size = 0

        def close():
            out.write(z.flush())
            out.close()
            return arrays([(uri, n)], done)

        for batch in batches:
            for page_id, url, html, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    uri, n, size = f"{folder}/{name}", 0, 0
                    out, z = fs.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, GZIP)
                piece = z.compress(record(page_id, url, html.encode("utf-8", "surrogatepass"), first))
                n, size = n + 1, size + len(piece)
                if piece:
                    out.write(piece)
                if size >= max_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return ws.written(rows.mapInArrow(run, "path string, records long"), "archives")


def normalise_archives(archives: DataFrame, folder: str, ws: Workspace, level: int = 1) -> DataFrame:
    """Normalise the gzip archives named in ``archives`` (path); returns the index of all their records."""
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string())])

    def run(batches):
        fs, base = opened(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs.create_dir(base, recursive=True)
                rows = []
                for row in normalise(path, f"{folder}/{path.rsplit('/', 1)[-1].removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.warc.gz", level):
                    rows.append(row)
                    if len(rows) == 5000:
                        yield arrays(rows, schema)
                        rows = []
                yield arrays(rows, schema)

    spread = archives.select("path").repartition(n_partitions(archives.sparkSession), "path")
    return ws.written(spread.mapInArrow(run, INDEX), "index")


def read_records(index: DataFrame) -> DataFrame:
    """The records of an index, read back: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, html (null for revisits). A payload that doesn't fit its digest raises."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())])

    def run(batches):
        at = raw = None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if archive != at:
                    if raw is not None:
                        raw.close()
                    fs, path = opened(archive)
                    at, raw = archive, fs.open_input_file(path)
                h, payload = fetch(raw, offset, length)
                digest, kind = h["warc-payload-digest"].removeprefix("sha256:"), h["warc-type"]
                if kind == "response" and (sha256(payload).hexdigest() != digest or len(payload) != int(h["x-payload-length"])):
                    raise ValueError(f"payload of {h['warc-record-id']} in {archive} differs from its digest")
                whole = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
                rows.append((whole("x-page-id"), h.get("warc-target-uri"), whole("x-payload-length"), digest, kind, whole("x-refers-to-page-id"), payload.decode("utf-8", "surrogatepass") if kind == "response" else None))
                if len(rows) == 500:
                    yield arrays(rows, schema)
                    rows = []
            yield arrays(rows, schema)
        if raw is not None:
            raw.close()

    return index.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def round_trip(pages: DataFrame, folder: str | None = None, keep_monolithic: bool = False) -> DataFrame:
    """Write ``pages`` (page_id, url, html; other columns are ignored), normalise, read back: a row a page.

    A null html counts as the empty payload. Of equal payloads of at least 100 bytes the row with the
    least page_id is the response and the others revisit it; rows repeating that page_id are responses
    too. Null page_ids stay null and revisit an equal page that has an id. No rows: no archives."""
    ws = Workspace(pages.sparkSession, "warc")
    folder = folder or ws.folder("files")
    archives = write_archives(pages, folder + "/monolithic", ws)
    index = normalise_archives(archives, folder + "/records", ws)
    if not keep_monolithic:
        remove(pages.sparkSession, folder + "/monolithic")
    return read_records(index)
