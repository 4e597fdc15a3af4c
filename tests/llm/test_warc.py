import base64
import gzip
import hashlib
import os
import zlib

import duckdb
import pytest

from netloom.llm import warc

ROWS = [(1, "http://a", "<p>é</p>"), (2, None, None), (3, "http://c\r\nX: y", ""), (4, "u", "<p>é</p>"), (5, "u", "x" * 300_000), (6, "u", "WARC/1.1\r\n\x1f"), (6, "u", "twice"), (6, "u", "twice"), (None, "u", "none"), (None, "u", "twice")]


def expected(rows):
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        ids = [x for x, _, g in rows if (g or "") == (h or "") and x is not None]
        to = max(ids) if ids and max(ids) != i else None
        out.append((str(i), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def got(df):
    return sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.where("kind = 'record'").collect()), key=str)


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, 9) for r in ROWS], "page_id long, url string, html string, sha int")
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages, path)
    read = warc.read_archives(spark, path)
    assert got(read) == expected(ROWS)
    assert read.where("kind = 'gap'").count() == 0
    full = {(r.page_id, bytes(r.payload)) for r in read.where("record_type = 'response'").collect()}
    assert (5, b"x" * 300_000) in full and (3, b"") in full
    for f in os.listdir(tmp_path / "w"):
        if f.startswith("part"):
            gzip.decompress((tmp_path / "w" / f).read_bytes())  # any gzip reader takes the files


def test_minimum_for_revisits(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    warc.write_archives(pages, f"file://{tmp_path}/w", revisit_bytes=3)
    kinds = {r.page_id: r.record_type for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_empty_table(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    assert warc.read_archives(spark, f"file://{tmp_path}/w").count() == 0


def members():
    return [warc.record(i, "http://x", b"payload %d " % i * 50, "response", None) for i in range(5)]


@pytest.mark.parametrize("how", ["flip", "cut", "junk", "lost head", "bad digest"])
def test_salvage(how):
    m = members()
    if how == "flip":
        m[2] = m[2][:60] + bytes([m[2][60] ^ 255]) + m[2][61:]
    elif how == "cut":
        m[2] = m[2][:40]
    elif how == "junk":
        m[2] = b"junk \x1f\x8b\x08 junk" * 3
    elif how == "lost head":
        m[2] = m[2][5:]
    else:
        raw = gzip.decompress(m[2]).replace(b"payload 2", b"payload X")
        m[2] = gzip.compress(raw)
    data = b"".join(m)
    out = list(warc.salvage(data))
    assert [x[3]["page_id"] for x in out if x[0] == "record"] == [0, 1, 3, 4]
    assert [(s, e) for k, s, e, _ in out if k == "gap"] == [(len(m[0] + m[1]), len(m[0] + m[1] + m[2]))]
    assert all(w for k, _, _, w in out if k == "gap")


def test_salvage_plain_records_and_damaged_ends():
    raw = [gzip.decompress(x) for x in members()]
    data = b"???" + raw[0] + raw[1][:-30] + raw[2] + members()[3] + raw[4][:50]
    out = list(warc.salvage(data))
    assert [x[3]["page_id"] for x in out if x[0] == "record"] == [0, 2, 3]
    covered = sorted((s, e) for _, s, e, _ in out)
    assert covered[0][0] == 0 and covered[-1][1] == len(data)
    assert all(a[1] == b[0] for a, b in zip(covered, covered[1:]))
    assert list(warc.salvage(b"")) == [] and zlib


def test_sql_agrees(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    want = sorted(map(tuple, con.execute(warc.WARC_SQL).fetchall()), key=str)
    assert sorted(map(tuple, warc.op3_warc(spark, d).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == want


def test_records_of_other_writers():
    """Any kind is recovered; a digest is held against the block, or what follows the HTTP headers in it, only where one is given."""
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nhello"
    cases = [
        ("warcinfo", b"software: x\r\n", {}, True),
        ("request", b"GET / HTTP/1.1\r\n\r\n", {"WARC-Payload-Digest": "sha1:" + warc.digest(b"other")}, True),
        ("response", body, {}, True),
        ("response", body, {"WARC-Payload-Digest": "sha1:" + warc.digest(b"hello").lower()}, True),
        ("response", body, {"WARC-Payload-Digest": "md5:0"}, True),
        ("response", body, {"WARC-Payload-Digest": "sha1:" + warc.digest(b"other")}, False),
        ("response", b"x", {"WARC-Payload-Digest": "sha1:" + warc.digest(b"")}, False),
        ("metadata", b"m", {"WARC-Block-Digest": "sha1:" + warc.digest(b"n")}, False),
    ]
    data, bounds = b"", []
    for kind, block, more, _ in cases:
        head = {"WARC-Type": kind, "Content-Length": len(block), **more}
        data += b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"
        bounds.append(len(data))
    found = {end: r for what, _, end, r in warc.salvage(data) if what == "record"}
    assert [end in found for end in bounds] == [good for *_, good in cases]
    assert [found[e]["record_type"] for e in bounds[:3]] == ["warcinfo", "request", "response"]
    assert found[bounds[2]]["payload_digest"] == warc.digest(body)
