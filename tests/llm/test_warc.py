import gzip
import hashlib
import io

import pytest

from quernel.llm.warc import ORACLE, archive_pages, chunked, op4_warc, parse, read_archives, records, write_archives

SCHEMA = "page_id long, url string, html string"
LONG = "é<p>\r\nWARC/1.1\r\n\r\n</p>\n" * 20


def pages():
    return [
        (3, "http://a/", LONG),
        (1, "http://b/ c\n", LONG),
        (2, None, LONG + "x"),
        (4, "http://d/", "short"),
        (5, "http://e/", "short"),
        (6, "http://f/", None),
        (7, "http://g/", ""),
        (8, "http://h/", "y" * 100),
        (9, "http://i/", "y" * 100),
        (9, "http://i/", "y" * 100),
        (8, "http://i/", "y" * 100),
        (10, "http://j/", "y" * 99),
        (11, "http://j/", "y" * 99),
        (None, "http://k/", LONG),
        (12, "http://l/", "z" * 300_000),
    ]


def expected(rows):
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(first.get(data, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = data in first and first[data] != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[data] if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = pages()
    got = op4_warc(spark.createDataFrame(rows, SCHEMA)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)


@pytest.mark.parametrize("compress", [True, False])
def test_chunks_and_running_digests(spark, tmp_path, compress):
    df = spark.createDataFrame(pages(), SCHEMA)
    manifest = archive_pages(df, str(tmp_path / "w"), compress)
    rows = read_archives(spark, manifest, chunk_bytes=1000).collect()
    whole = {}
    for r in sorted((r for r in rows if r.record_id == 12), key=lambda r: r.chunk_no):
        whole[r.chunk_no] = bytes(r.chunk)
        assert r.chunk_end == sum(map(len, whole.values()))
        assert r.running_sha256 == hashlib.sha256(b"".join(whole.values())).hexdigest()
        assert r.is_last == (r.chunk_end == 300_000)
    assert b"".join(whole.values()) == b"z" * 300_000 and len(whole) == 300
    # offsets of the manifest stand at records
    for m in manifest.collect():
        data = open(m.archive, "rb").read()[m.archive_offset :]
        first = next(parse(io.BufferedReader(gzip.open(io.BytesIO(data)) if compress else io.BytesIO(data))))
        assert first[0] == m.record_id and first[1] == m.record_type


def test_writer_chunks_are_bounded(spark):
    rows = chunked(records(spark.createDataFrame(pages(), SCHEMA)), chunk_bytes=64).selectExpr("max(length(chunk)) m", "sum(length(chunk)) s").first()
    assert rows.m == 64
    # revisits carry nothing
    assert rows.s == sum(size for _, size, _, kind, _ in expected(pages()) if kind == "response")


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert op4_warc(empty).collect() == []
    assert write_archives(chunked(records(empty)), str(tmp_path)).collect() == []
    assert "first_id" in ORACLE


def test_clashing_columns(spark):
    rows = [(1, "u", "x" * 200, "a", 5), (2, "u", "x" * 200, "b", 6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, record_id int")
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in op4_warc(df).collect()) == [(1, "response", None), (2, "revisit", 1)]
