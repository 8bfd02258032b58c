import gzip
import hashlib
import io

import duckdb

from framerank.llm import _common as C
from framerank.llm import queries, warc

BIG = "é" * 700


def brute(rows):
    out = []
    for page_id, html in rows:
        b = (html or "").encode()
        ids = [i for i, h in rows if (h or "").encode() == b and i is not None]
        first = max(ids) if ids and len(b) >= 1000 and sum((h or "").encode() == b for _, h in rows) > 1 else None
        refers = None if first is None or first == page_id else first
        out.append((page_id, len(b), hashlib.sha1(b).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


PAGES = [(1, BIG), (5, BIG), (3, BIG), (7, "x"), (8, "x"), (9, None), (10, ""), (11, "z" * 5_000_000), (None, BIG), (20, "q" * 1000), (20, "q" * 1000), (12, "\r\n\r\nWARC/1.1\r\n" * 300)]


def test_matches_brute_force(spark):
    pages = spark.createDataFrame([(i, f"http://a b.example/{i}", h, "x") for i, h in PAGES], "page_id long, url string, html string, sha1 string")
    assert sorted(map(tuple, warc.digest(pages).collect()), key=str) == brute(PAGES)


def test_round_trip_in_chunks(spark):
    pages = spark.createDataFrame([(i, None, h) for i, h in PAGES], "page_id long, url string, html string")
    manifest = warc.write(pages, C.fresh_path(spark, "warc"), chunk=1000)
    rows = warc.read(spark, manifest, chunk=777).orderBy("page_id", "chunk").collect()
    assert max(len(r.data) for r in rows) <= 777
    for page_id, html in PAGES:
        own = [r for r in rows if r.page_id == page_id and r.record_type == "response"]
        if page_id in (1, 3, None, 20):
            continue
        assert b"".join(r.data for r in own) == (html or "").encode()
        at = 0
        for r in own:
            at += len(r.data)
            assert (r.bytes_so_far, r.sha1_so_far) == (at, hashlib.sha1((html or "").encode()[:at]).hexdigest())
    file = manifest.first().file.removeprefix("file://")
    text = gzip.open(file).read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: re")
    assert len(list(warc.records(io.BytesIO(open(file, "rb").read())))) >= manifest.first().records


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.digest(pages).count() == 0


def test_sql(spark, small):
    got = sorted(map(tuple, queries.op6_warc(spark, small).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{small}/pages.parquet'")
    assert got == sorted(con.execute(queries.ORACLE["op6_warc"]).fetchall(), key=str)
