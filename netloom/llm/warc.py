"""WARC: a writer of archives of compressed records, and a salvage reader.

Writing: of records with equal payloads the one with the largest page_id is a response, the others are revisits of it.
Equal payloads meet by digest alone: only digests and ids are grouped, and only digests that occur more than once join
the pages again. Each record is a gzip member of its own. Spark's text writer puts the members in the files, with an
empty gzip member as the line separator, so that files can be in any store that Spark writes to and are valid
throughout.

Reading: a member must inflate with the right CRC and its record, of any kind, must have a version line, a length that fits and, where
they are given as SHA-1, digests that match its block and, for responses and resources, its payload. After a failed check the reader searches for the next gzip magic or
version line from which a whole record can be read, goes on there, and logs the bytes between as a quarantined gap.

Cases: a null payload is empty; rows that repeat the largest id of equal payloads are each a response; an empty table
writes no records; null ids are kept (they count as the smallest; without any id all are responses); further columns
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VERSION = b"WARC/1.1"
MEMBER = b"\x1f\x8b\x08"
#: An empty gzip member, as Latin-1 text: what stands between records in a file.
SEPARATOR = (MEMBER + bytes(5) + b"\x00\x03" + b"\x03\x00" + bytes(8)).decode("latin-1")
#: Payloads from this size on are written once.
REVISIT_BYTES = 0
LEVEL = 1
#: Bytes that inflate at once.
STEP = 1 << 20

_RECORD = pa.schema([("value", pa.binary())])
_READ = pa.schema(
    [
        ("file", pa.string()),
        ("kind", pa.string()),
        ("start", pa.int64()),
        ("end", pa.int64()),
        ("why", pa.string()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
    ]
)
READ_DDL = "file string, kind string, start long, end long, why string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit has no block; its headers give the digest and the size of the payload."""
    block = b"" if kind == "revisit" else payload
    name = "" if page_id is None else page_id
    head = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url or ""),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head.insert(2, f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>")
    raw = VERSION + b"\r\n" + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _inflate(data: memoryview, at: int) -> tuple[bytes, int] | str:
    """The content of the member at this byte and the byte after it, or what failed."""
    engine, out, i = zlib.decompressobj(31), [], at
    try:
        while not engine.eof:
            if i >= len(data):
                return "the member is cut off"
            out.append(engine.decompress(data[i : i + STEP]))
            i += STEP
    except zlib.error as e:
        return f"the member doesn't inflate: {e}"
    return b"".join(out), min(i, len(data)) - len(engine.unused_data)


_HEADER = re.compile(rb"WARC/\d\.\d\r\n((?:[^\r\n]+\r\n)*)\r\n")
#: A digest that can be checked here; others are taken as they are.
_SHA1 = re.compile(r"(?:sha1:)?([A-Z2-7]{32})", re.I)
_ID = re.compile(r"<urn:page:(-?\d*)>")


def _fits(data: bytes, said: str | None) -> bool:
    known = _SHA1.fullmatch(said or "")
    return not known or digest(data) == known[1].upper()


def _parse(raw: bytes | memoryview, at: int = 0) -> tuple[dict, int] | str:
    """The record whose version line is at this byte and the byte after it, or what failed."""
    head = _HEADER.match(raw, at)
    if not head:
        return "no version line and headers"
    fields = {}
    for line in head[1].decode("utf-8", "replace").split("\r\n")[:-1]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    size, kind = fields.get("content-length", ""), fields.get("warc-type")
    if not size.isdigit() or not kind:
        return "no length or kind"
    start = head.end()
    end = start + int(size)
    if bytes(raw[end : end + 4]) != b"\r\n\r\n":
        return "the length doesn't fit"
    block, said = bytes(raw[start:end]), fields.get("warc-payload-digest")
    if not _fits(block, fields.get("warc-block-digest")):
        return "the block doesn't match its digest"
    # A payload is the block, or what follows the headers of an HTTP message in it. A revisit has none here.
    _, gap, body = block.partition(b"\r\n\r\n")
    if kind in ("response", "resource") and not _fits(block, said) and not (gap and _fits(body, said)):
        return "the payload doesn't match its digest"
    number = lambda x: int(m[1]) if (m := _ID.fullmatch(x or "")) and m[1] else None
    full = fields.get("warc-payload-length", "")
    return {
        "page_id": number(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "payload_bytes": int(full) if full.isdigit() else len(block),
        "payload_digest": digest(block) if said is None else said.removeprefix("sha1:"),
        "refers_to": number(fields.get("warc-refers-to")),
        "payload": block,
    }, end + 4


_MARK = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r\n")


def salvage(data: bytes):
    """Yields (kind, start, end, record or reason): kind is record or gap."""
    view, at, bad, why = memoryview(data), 0, None, ""
    while at < len(data):
        found, reason = None, "neither a member nor a version line"
        if data[at : at + 3] == MEMBER:
            got = _inflate(view, at)
            if isinstance(got, str):
                reason = got
            elif not got[0]:
                found = None, got[1]
            else:
                inner = _parse(got[0])
                if isinstance(inner, str):
                    reason = inner
                elif inner[1] != len(got[0]):
                    reason = "bytes after the record"
                else:
                    found = inner[0], got[1]
        elif data[at : at + 5] == b"WARC/":
            got = _parse(data, at)
            if isinstance(got, str):
                reason = got
            else:
                found = got
        if found:
            if bad is not None:
                yield "gap", bad, at, why
                bad = None
            if found[0]:
                yield "record", at, found[1], found[0]
            at = found[1]
        else:
            if bad is None:
                bad, why = at, reason
            mark = _MARK.search(data, at + 1)
            at = mark.start() if mark else len(data)
    if bad is not None:
        yield "gap", bad, len(data), why


def _write_rows(rows):
    for batch in common.batches(rows):
        out = []
        for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            payload = (html or "").encode("utf-8", "surrogatepass")
            out.append(record(page_id, url, payload, "revisit" if revisit else "response", refers_to))
        yield common.arrow(_RECORD, value=out)


def _read_rows(payloads: bool):
    def run(rows):
        for batch in common.batches(rows, 1):
            name, data = batch.column(0)[0].as_py(), batch.column(1)[0].as_buffer().to_pybytes()
            out = []
            for kind, start, end, what in salvage(data):
                if kind == "gap":
                    what = dict.fromkeys(_READ.names[5:]) | {"why": what}
                out.append({"why": None} | what | {"file": name, "kind": kind, "start": start, "end": end} | ({} if payloads else {"payload": None}))
                if len(out) == 256:
                    yield pa.RecordBatch.from_pylist(out, _READ)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, _READ)

    return run


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, id_col="page_id", url_col="url", html_col="html") -> None:
    """Writes the archives as files of about the advisory partition size in the folder path."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    payload = F.coalesce("html", F.lit(""))
    rows = rows.withColumn("sha", F.when(F.octet_length(payload) >= revisit_bytes, F.sha1(F.encode(payload, "UTF-8"))))
    # Narrow: digests and ids. What Spark broadcasts, if anything, is under its threshold by the size of the files read back.
    equal = rows.groupBy("sha").agg(F.count("*").alias("copies"), F.max("page_id").alias("largest")).where("copies > 1 AND sha IS NOT NULL AND largest IS NOT NULL")
    equal = common.materialize(equal.select("sha", "largest"), "equal")
    out = rows.join(equal, "sha", "left").withColumn("revisit", F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest")))
    out = out.select("page_id", "url", "html", F.when(F.col("revisit"), F.col("largest")).alias("refers_to"), "revisit")
    out = out.hint("rebalance").mapInArrow(_write_rows, "value binary")
    out.select(F.col("value").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("encoding", "ISO-8859-1").text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record (kind record) and per quarantined byte range (kind gap, with why)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read_rows(payloads), READ_DDL)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "warc")
    write_archives(common.table(spark, sf_dir, "pages"), path)
    read = read_archives(spark, path, payloads=False).where("kind = 'record'")
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, hex,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
      ((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31) + 1 AS INT), 1)), '') AS payload_digest
  FROM p),
m AS (SELECT hex, max(page_id) AS largest FROM d GROUP BY hex)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS DISTINCT FROM largest AND largest IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM d JOIN m USING (hex)
"""
