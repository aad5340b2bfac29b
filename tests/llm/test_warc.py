"""WARC archives: the query against SQL, segments, framing, revisits and damage."""

import gzip
import hashlib
import io

import duckdb
import pytest
from holdline.llm import common, queries, warc


def test_op9(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    out = con.sql(queries.ORACLES["op9_warc"])
    got = queries.op9_warc(spark, sf_dir)
    assert got.columns == out.columns
    assert sorted(map(tuple, got.collect())) == sorted(out.fetchall())


ROWS = [
    (1, "http://a/1", "x" * 99), (2, "http://a/2", "x" * 99), (3, None, "é" * 60), (4, "http://a/4\r\n", "é" * 60),
    (5, "u", None), (6, "u", ""), (7, "u", "long " * 30_000), (8, "u", "long " * 30_000), (9, "u", "other " * 20_000),
    (9, "u", "other " * 20_000), (None, "u", "y" * 200), (10, "u", "y" * 200), (11, "u", "z" * 16_000), (3, "v", "second"),
    (12, "u", "\r\n0\r\n\r\nWARC/1.1\r\n" * 3000),
]


def pages(spark):
    rows = [(*r, "b", 1) for r in ROWS]
    return spark.createDataFrame(rows, "page_id long, url string, html string, body string, record_id int")


def expected():
    keeper = {}
    for i, _, html in ROWS:
        if i is not None and len((html or "").encode()) >= 100:
            keeper[html] = min(i, keeper.get(html, i))
    out = []
    for i, _, html in ROWS:
        data = (html or "").encode()
        first = keeper.get(html)
        own = i is None or first is None or i == first
        row = (i, len(data), hashlib.sha256(data).hexdigest())
        out.append((*row, "response" if own else "revisit", None if own else first))
    return sorted(out, key=str)


def test_odd_pages(spark, folder):
    got = warc.page_summary(spark, pages(spark), folder)
    assert sorted(map(tuple, got.collect()), key=str) == expected()
    manifest = spark.read.parquet(f"{folder}/manifest")
    assert manifest.filter("segmented").count() and manifest.filter("NOT segmented").count()
    assert warc.page_summary(spark, pages(spark).limit(0), folder + "2").count() == 0


def test_payloads_come_back(spark, folder):
    manifest = warc.write_archives(pages(spark), folder)
    bodies = {r["page_id"]: bytes(r["body"]) for r in warc.read_archives(manifest).filter("record_type = 'response'").collect()}
    for i, _, html in ROWS:
        if i in (1, 2, 5, 6, 7, 9, 11, 12):
            assert bodies[i] == (html or "").encode()


def test_files_are_plain_warc(spark, folder):
    manifest = warc.write_archives(pages(spark), folder)
    kinds = []
    for row in manifest.collect():
        with gzip.open(row["path"].removeprefix("file:")) as f:
            found = list(warc.records_in(io.BytesIO(f.read())))  # as an archive that is not gzipped
        assert len(found) == row["n_records"]
        kinds += [h["warc-type"] for h, _ in found]
        assert all(len(b) <= warc.SEGMENT_BYTES for _, b in found)
    assert set(kinds) == {"response", "revisit", "continuation"} and kinds.count("revisit") == 2


@pytest.mark.parametrize("fault", ["none", "missing", "total", "digest", "chunk"])
def test_damage_is_reported(spark, folder, fault):
    body = b"some body " * 4000
    records = warc.page_records(1, "u", body, hashlib.sha256(body).hexdigest(), None)
    assert len(records) > 2
    plain = [gzip.decompress(r) for r in records]
    if fault == "missing":
        del records[1]
    elif fault == "total":
        records[-1] = gzip.compress(plain[-1].replace(b"Total-Length: ", b"Total-Length: 1"))
    elif fault == "digest":
        records[1] = gzip.compress(plain[1].replace(b"some", b"same"))
    elif fault == "chunk":
        records[0] = gzip.compress(plain[0].replace(b"\r\n1000\r\n", b"\r\n0fff\r\n", 1))
    with open(str(folder) + ".warc.gz", "wb") as f:
        f.write(b"".join(reversed(records)))  # in any order
    manifest = spark.createDataFrame([(str(folder) + ".warc.gz", True)], "path string, segmented boolean")
    (row,) = warc.read_archives(manifest).collect()
    assert (row["problem"] is None) == (fault == "none")
    if fault == "none":
        assert bytes(row["body"]) == body and row["page_id"] == 1


def test_chunks():
    for body in (b"", b"a", b"x" * 5000, b"\r\n0\r\n\r\n"):
        assert warc.dechunked(warc.chunked(body)) == body
    assert warc.dechunked(b"3;a=b\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n")
    message = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(b"text")
    assert warc.http_body(message) == b"text"
