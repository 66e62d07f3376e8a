import gzip
import hashlib
import json
from pathlib import Path

import pytest

from arbordf.llm import warc
from arbordf.llm.common import Workspace

SCHEMA = "page_id long, url string, html string, digest string"


def pages(spark):
    big, small = "é" * 80, "short"
    rows = [(5, "http://a/5", big, "x"), (2, "http://a/2", big, "x"), (9, None, small, None), (8, "http://a/8", small, None), (7, "http://a/7", None, None), (3, "u\r\nX: y", "<p>" + "z" * 300_000, None), (None, "http://n", big, None), (4, "", "", None)]
    return spark.createDataFrame(rows, SCHEMA), big


@pytest.mark.parametrize("small", [0, 1000])
def test_round_trip(spark, small):
    df, big = pages(spark)
    ws = Workspace(spark, "t")
    folder = ws.folder("files")
    archives = warc.write_archives(df.repartition(3), folder + "/m", ws, small=small, max_bytes=1000)
    index = warc.normalise_archives(archives, folder + "/r", ws)
    got = {r.page_id: r for r in warc.read_records(index).collect()}
    assert len(got) == 8
    for r in df.collect():
        b = (r.html or "").encode()
        assert got[r.page_id].payload_bytes == len(b) and got[r.page_id].payload_digest == hashlib.sha256(b).hexdigest()
        assert got[r.page_id].html == (None if r.page_id in (5, None) else r.html or "")
    assert [(i, got[i].record_type, got[i].refers_to) for i in (2, 5, 8, 9, None)] == [(2, "response", None), (5, "revisit", 2), (8, "response", None), (9, "response", None), (None, "revisit", 2)]
    # each record is a gzip member of its own and the sidecar says where
    for path in {r.archive for r in index.collect()}:
        file = Path(path.removeprefix("file://"))
        data = file.read_bytes()
        lines = [json.loads(x) for x in Path(str(file) + ".idx").read_text().splitlines()]
        assert [x["offset"] for x in lines] == sorted(x["offset"] for x in lines) and sum(x["length"] for x in lines) == len(data)
        for x in lines:
            assert gzip.decompress(data[x["offset"] : x["offset"] + x["length"]]).startswith(b"WARC/1.1\r\n")


def test_normaliser_reads_any_gzip_layout(tmp_path):
    records = [warc.record(i, f"http://x/{i}", bytes(range(256)) * i, None) for i in range(1, 6)]
    for name, data in (("one", gzip.compress(b"".join(records))), ("many", b"".join(map(gzip.compress, records)))):
        src, dst = tmp_path / f"{name}.warc.gz", tmp_path / f"{name}-out.warc.gz"
        src.write_bytes(data)
        rows = list(warc.normalise(f"file://{src}", f"file://{dst}"))
        assert [r[5] for r in rows] == [1, 2, 3, 4, 5]
        with dst.open("rb") as raw:
            assert [warc.fetch(raw, r[1], r[2])[1] for r in rows] == [bytes(range(256)) * i for i in range(1, 6)]


def test_truncated_archive_raises(tmp_path):
    data = gzip.compress(warc.record(1, "u", b"x" * 10_000, None))
    (tmp_path / "t.warc.gz").write_bytes(data[:-40])
    with pytest.raises(EOFError):
        list(warc.normalise(f"file://{tmp_path}/t.warc.gz", f"file://{tmp_path}/o.warc.gz"))


def test_empty_table_and_repeats(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = spark.createDataFrame([(1, "u", "y" * 200, None)] * 2 + [(2, "u", "y" * 200, None)], SCHEMA)
    assert sorted(r.record_type for r in warc.round_trip(twice).collect()) == ["response", "response", "revisit"]
