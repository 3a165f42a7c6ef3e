"""Operator 6, WARC from legacy ARC archives.

``parse_arc`` reads the version block of an ARC file and then, by the header line of that version (1 or
2) and its declared length, record after record.  ``to_warc`` synthesises an equivalent WARC 1.1
record: identifier, timestamp, type and digests.  Archives are written and read through Spark's own
sinks and sources (text files whose rows are gzip members, one a record; binaryFile), so they
can be in any store that Spark reaches.  Files hold records of one partition and a bounded number of bytes;
readers hold one compressed file and one record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm.common import bounded, shared_dir, table, tidy

#: The header fields of the two ARC versions.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes of records in a row of the sink, rows of a file, and pages of one legacy archive in memory.
ROW_BYTES, ROWS_PER_FILE, ARC_BYTES = 4 << 20, 16, 8 << 20
#: Compression of records: on members of some kilobytes level 6 takes more than twice the time of level 1 and saves 6 % of the bytes.
LEVEL = 1
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:karst:warc")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(url: str | None) -> str:
    """A URL without white space and control characters, which would break a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "about:blank"


def arc_bytes(records: list[dict], version: int = 1, name: str = "pages.arc", date: str = "20240101000000") -> bytes:
    """An uncompressed ARC file of records (url, ip, date, type, block: the HTTP response)."""
    fields = " ".join(ARC_FIELDS[version])
    body = f"{version} 0 karst\n{fields}\n\n".encode()
    tail = ["text/plain", *(["200", "-", "-", "0", name] if version == 2 else []), str(len(body))]
    out = [" ".join([f"filedesc://{name}", "0.0.0.0", date, *tail]).encode() + b"\n", body, b"\n"]
    at = sum(map(len, out))
    for r in records:
        block = r["block"]
        more = ["200", base32_sha1(block), "-", str(at), name] if version == 2 else []
        line = " ".join([_clean(r["url"]), r.get("ip") or "0.0.0.0", r.get("date") or date, r.get("type") or "text/html", *more, str(len(block))]).encode() + b"\n"
        out += [line, block, b"\n"]
        at += len(line) + len(block) + 1
    return b"".join(out)


def parse_arc(stream: BinaryIO) -> Iterator[dict]:
    """Records (field names in lower case, ``block`` the content) of an ARC file; broken headers or short contents raise ValueError."""

    def one(fields: list[str]) -> dict | None:
        line = stream.readline()
        while line in (b"\n", b"\r\n"):
            line = stream.readline()
        if not line:
            return None
        parts = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(fields) - 1)
        if len(parts) != len(fields) or not parts[-1].isdigit():
            raise ValueError(f"not an ARC header: {line[:200]!r}")
        out = {f.lower(): p for f, p in zip(fields, parts, strict=True)}
        out["block"] = stream.read(int(parts[-1]))
        if len(out["block"]) != int(parts[-1]):
            raise ValueError("an ARC record is shorter than it declares")
        return out

    first = stream.readline()
    if not first:
        return
    length = first.rstrip().rsplit(b" ", 1)[-1]
    if not first.startswith(b"filedesc://") or not length.isdigit():
        raise ValueError("an ARC file begins with its filedesc line")
    version = stream.read(int(length)).split(b"\n", 1)[0].split(b" ")[0]
    if version not in (b"1", b"2"):
        raise ValueError(f"ARC version {version!r} is not known")
    while (record := one(ARC_FIELDS[int(version)])) is not None:
        yield record


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower case) and payload of an HTTP response; a block without a status line is all payload."""
    if not block.startswith(b"HTTP/"):
        return {}, block
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        head, _, payload = block.partition(b"\n\n")
    lines = head.decode("latin-1").splitlines()[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def iso_date(arc_date: str) -> str:
    """ARC's yyyymmddhhmmss (or a prefix of it) as a WARC timestamp."""
    d = (re.sub("[^0-9]", "", arc_date)[:14] or "1970").ljust(4, "0")
    d += "0101000000"[len(d) - 4 :] if len(d) < 14 else ""
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(key: str) -> str:
    """The identifier that a record gets, from what names it: the same in every run and on every machine."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, key)}>"


def to_warc(arc: dict, *, key: str | None = None, refers_to: str | None = None, extra: dict[str, str] | None = None) -> bytes:
    """The WARC record of an ARC record, without the closing CRLF CRLF.

    refers_to: the key of the record that this one revisits; then the payload is left out and its
    digest and HTTP headers stay.  A block that is no HTTP response becomes a resource record.
    """
    block = arc["block"]
    http, payload = split_http(block)
    kind = "revisit" if refers_to is not None else "response" if http or block.startswith(b"HTTP/") else "resource"
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(key or f"{arc['url']} {arc['archive-date']} {base32_sha1(block)}"),
        "WARC-Date": iso_date(arc["archive-date"]),
        "WARC-Target-URI": arc["url"],
        "WARC-IP-Address": arc["ip-address"],
        "WARC-Payload-Digest": "sha1:" + base32_sha1(payload),
    }
    if kind == "revisit":
        block = block[: len(block) - len(payload)]
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to)}
    head |= {"WARC-Block-Digest": "sha1:" + base32_sha1(block)}
    head |= {"Content-Type": "application/http;msgtype=response" if kind != "resource" else arc["content-type"]}
    head |= (extra or {}) | {"Content-Length": str(len(block))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block


def warcinfo(name: str, date: str) -> bytes:
    body = b"software: karst\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(name)}\r\nWARC-Date: {iso_date(date)}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body


def parse_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of the records of a WARC file."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:200]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        block = stream.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]):
            raise ValueError("a WARC record is shorter than it declares")
        yield head, block


def convert_archives(archives: DataFrame, content_col: str = "content") -> DataFrame:
    """record (binary): the WARC records of a table of whole ARC files, such as ``binaryFile`` reads; gzip or plain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                raw = value.as_py() or b""
                for arc in parse_arc(gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)):
                    yield pa.RecordBatch.from_arrays([pa.array([to_warc(arc)], pa.binary())], names=["record"])

    return archives.select(content_col).mapInArrow(tidy(run), "record binary")


def _member(raw: bytes) -> bytes:
    """A gzip member that is the same on every machine: without a time."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """record -> members: gzip members, one a record, some bytes of them to a row."""
    held, size = [], 0
    for batch in batches:
        for value in batch.column(0):
            held.append(_member((value.as_py() or b"") + b"\r\n\r\n"))
            size += len(held[-1])
            if size >= ROW_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["members"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["members"])


def write_warc(records: DataFrame, path: str) -> None:
    """Writes a binary column ``record`` as WARC files of one gzip member a record, bounded by bytes (a larger record is a row of its own).

    Spark's text sink puts a line separator after each row; here that is an empty gzip member, so a file is members from end to end.
    """
    rows = records.select("record").mapInArrow(tidy(_members), "members binary").select(F.col("members").cast("string"))
    sink = rows.write.option("lineSep", _member(b"").decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none")
    sink.option("maxRecordsPerFile", ROWS_PER_FILE).text(path)


def _through_arc(version: int, date: str):
    """page_id, url, html, first -> records: pages become a legacy archive, which is parsed and converted."""

    def convert(rows: list[tuple]) -> list[bytes]:
        arcs, firsts = [], []
        for page, url, html, first in rows:
            payload = (html or "").encode("utf-8", "surrogatepass")
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {'' if page is None else page}\r\n\r\n"
            arcs.append({"url": url, "date": date, "block": head.encode() + payload})
            firsts.append(first)
        out = []
        for arc, first in zip(parse_arc(io.BytesIO(arc_bytes(arcs, version, date=date))), firsts, strict=True):
            page = split_http(arc["block"])[0]["x-page-id"]
            revisit = first is not None and str(first) != page
            extra = {"X-Page-Id": page} | ({"X-Refers-To-Page-Id": str(first)} if revisit else {})
            out.append(to_warc(arc, key=f"page {page}", refers_to=f"page {first}" if revisit else None, extra=extra))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([warcinfo("karst", date)], pa.binary())], names=["record"])
        for batch in batches:
            rows, size = [], 0
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                rows.append(row)
                size += len(row[2] or "")
                if size > ARC_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(convert(rows), pa.binary())], names=["record"])
                    rows, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(convert(rows), pa.binary())], names=["record"])

    return tidy(run)


def archive_pages(pages: DataFrame, path: str, *, version: int = 1, date: str = "20240101000000", least_bytes: int = 0) -> None:
    """Writes pages (page_id, url, html) as WARC files under path, converted from ARC of the given version.

    Of pages with equal payloads of at least ``least_bytes`` bytes that with the smallest id is a
    response, the others revisit it.  Null html is an empty payload, a null url about:blank.  Rows that repeat
    an id are all what the id is; null ids come after all others.  An empty table gives files
    without pages.  Only digests are grouped, with map-side minima; of the groups, those with
    several pages are joined back, and the planner splits a hot payload's rows.
    """
    bounded(pages)
    html = F.coalesce("html", F.lit(""))
    digest = F.unhex(F.sha1(html.cast("binary")))
    size = F.octet_length(html)
    page = pages.select("page_id", "url", "html", digest.alias("_digest"), size.alias("_size"))
    groups = page.where(F.col("_size") >= least_bytes).groupBy("_digest", "_size").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    groups = groups.where("_n > 1").select(F.col("_digest").alias("_d"), F.col("_size").alias("_s"), "_first")
    told = page.join(groups, F.expr("_digest = _d AND _size = _s"), "left").select("page_id", "url", "html", "_first")
    write_warc(told.mapInArrow(_through_arc(version, date), "record binary"), path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for value in batch.column(0):
            rows: list[tuple] = []
            for head, block in parse_warc(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(value.as_py())), 1 << 16)):
                if head["warc-type"] not in ("response", "revisit"):
                    continue
                http, payload = split_http(block)
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                if head["warc-type"] == "response" and base32_sha1(payload) != digest:
                    raise ValueError("a payload does not have its digest")
                number = lambda k: int(head[k]) if head.get(k) else None  # noqa: B023, E731
                size = len(payload) if head["warc-type"] == "response" else int(http["content-length"])
                rows.append((number("x-page-id"), head["warc-target-uri"], size, digest, head["warc-type"], number("x-refers-to-page-id"), head["warc-record-id"], head["warc-date"], payload.decode("utf-8", "surrogatepass")))
                if len(rows) == 500:
                    yield _table(rows)
                    rows = []
            if rows:
                yield _table(rows)


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, date string, html string"


def _table(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split(" ")[0] for x in _READ.split(", ")])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The page records of WARC files: page_id, url, payload_bytes, payload_digest, record_type, refers_to, record_id, date, html (of revisits empty)."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(tidy(_read), _READ)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    archive_pages(table(spark, sf_dir, "pages"), path)
    return read_pages(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base 32 from the hexadecimal digest: each five hexadecimal digits are four characters.
OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
d AS (
  SELECT page_id, h, x, array_to_string(list_transform(range(0, 8), lambda i:
    array_to_string(list_transform([15, 10, 5, 0], lambda s:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, i * 5 + 1, 5) AS INTEGER) >> s) & 31 AS BIGINT) + 1, 1)), '')), '') AS digest,
    min(page_id) OVER (PARTITION BY h) AS first_page
  FROM p
)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_page THEN first_page END AS refers_to
FROM d
"""
