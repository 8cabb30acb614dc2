"""Legacy archive converter: ARC to WARC (operator 4).

An ARC file starts with a version block (``filedesc://`` record) whose second
line names the version. Each record then has one header line and a declared
number of bytes:

    version 1: URL IP-address Archive-date Content-type Archive-length
    version 2: URL IP-address Archive-date Content-type Result-code Checksum
               Location Offset Filename Archive-length

Records are cut by the declared length, never by looking for a delimiter. The
converter gives each record what WARC asks for and ARC lacks: an identifier
(a UUID of the archive's name and the record's offset, so a retry gives the
same), an ISO timestamp from the 14-digit one, a type, and SHA-1 digests of
block and payload. Of records with equal payloads of ``min_revisit`` bytes or
more, the one with the largest key is a response and the others revisit it.

WARC files are written by Spark's text writer, with the blank lines that end a
record as separator, into the folder that the cluster shares, and are read
back with its binary reader and cut by Content-Length."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes of an archive made by ``write_arc``, about
ARCHIVE_BYTES = 4 << 20
_NAMES = {1: "URL IP-address Archive-date Content-type Archive-length",
          2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
_FIELDS = {v: len(n.split()) for v, n in _NAMES.items()}
_DATE = "20010203040506"
RECORDS = ("archive string, offset long, version int, url string, ip string, date string, mime string, status string, "
           "truncated boolean, key long, head binary, payload binary, payload_bytes long, sha1 string, record_id string")


# ------------------------------------------------------------------ writing ARC

def _header_line(version: int, name: str, offset: int, url: str, mime: str, length: int) -> bytes:
    if version == 1:
        return f"{url} 0.0.0.0 {_DATE} {mime} {length}\n".encode()
    return f"{url} 0.0.0.0 {_DATE} {mime} 200 - - {offset} {name} {length}\n".encode()


def write_arc(pages: DataFrame) -> DataFrame:
    """(archive, content): ARC files that hold ``pages`` (page_id, url, html),
    version 1 and 2 in turn. The page's id is a header of the archived HTTP
    response. Null html is an empty payload; a null url is ``urn:page:id``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, parts, size = "", [], 0
        for b in batches:
            for page, part, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "part", "url", "html"))):
                if not parts:
                    version = 1 + (page or 0) % 2
                    name = f"legacy-{part}-{page}.arc"
                    about = f"{version} 0 pages\n{_NAMES[version]}\n".encode()
                    parts = [_header_line(version, name, 0, f"filedesc://{name}", "text/plain", len(about)) + about]
                    size = len(parts[0])
                body = (html or "").encode()
                uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or f"urn:page:{page}")
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"" if page is None else b"X-Page-Id: %d\r\n" % page) + b"\r\n"
                record = b"\n" + _header_line(version, name, size + 1, uri, "text/html", len(head) + len(body)) + head + body
                parts.append(record)
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts)], pa.large_binary())], ["archive", "content"])
                    parts = []
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts)], pa.large_binary())], ["archive", "content"])

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.spark_partition_id().alias("part"),
                          F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return narrow.mapInArrow(run, "archive string, content binary")


# ------------------------------------------------------------------ parsing ARC

def parse_arc(content: bytes) -> Iterator[tuple[int, int, list[str], bytes, bool]]:
    """(offset, version, header fields, block, truncated) of the records of an
    ARC file, gzipped or not; the version block is not given. A declared
    length beyond the end cuts the block there and marks it; a header line
    with too few fields or no length ends the file."""
    if content[:2] == b"\x1f\x8b":
        content = _gunzip(content)
    at, version = 0, 1
    while at < len(content):
        while content[at:at + 1] in (b"\n", b"\r"):
            at += 1
        end = content.find(b"\n", at)
        if end < 0:
            return
        line = content[at:end].rstrip(b"\r").decode("utf-8", "replace")
        about = line.startswith("filedesc://")
        fields = line.rsplit(" ", _FIELDS[version] - 1)  # a URL may hold spaces
        if not fields[-1].isdigit():
            return
        start, stop = end + 1, end + 1 + int(fields[-1])
        block = content[start:stop]
        if about:
            version = 2 if block.lstrip()[:2] == b"2 " else 1
        elif len(fields) == _FIELDS[version]:
            yield at, version, fields, block, stop > len(content)
        else:
            return
        at = stop


def _gunzip(content: bytes) -> bytes:
    out = []
    while content:  # members one after the other
        d = zlib.decompressobj(31)
        out.append(d.decompress(content))
        content = d.unused_data if d.eof else b""
    return b"".join(out)


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head with its blank line, and payload; a block that is no HTTP response
    is all payload."""
    if block[:5] != b"HTTP/":
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[:end + 4], block[end + 4:])


def _key(head: bytes) -> int | None:
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.lower() == b"x-page-id" and value.strip().lstrip(b"-").isdigit():
            return int(value)
    return None


def arc_records(archives: DataFrame) -> DataFrame:
    """Records (schema ``RECORDS``) of ARC files given as (archive, content),
    such as Spark's binaryFile reader gives under ``path`` and ``content``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("archive"), b.column("content")):
                rows, size, name = [], 0, name.as_py() or ""
                for offset, version, f, block, cut in parse_arc(content.as_py() or b""):
                    head, payload = _split_http(block)
                    record = uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{offset}")
                    rows.append((name, offset, version, f[0], f[1], f[2], f[3], f[4] if version == 2 else None, cut, _key(head),
                                 head, payload, len(payload), hashlib.sha1(payload).hexdigest(), f"<urn:uuid:{record}>"))
                    size += len(block)
                    if size > ARCHIVE_BYTES:
                        yield _records(rows)
                        rows, size = [], 0
                if rows:
                    yield _records(rows)
    return archives.select("archive", "content").mapInArrow(run, RECORDS)


_ARROW = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("version", pa.int32()), ("url", pa.string()), ("ip", pa.string()),
                    ("date", pa.string()), ("mime", pa.string()), ("status", pa.string()), ("truncated", pa.bool_()), ("key", pa.int64()),
                    ("head", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("sha1", pa.string()), ("record_id", pa.string())])


def _records(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


# --------------------------------------------------------------- converting

def with_types(records: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """Records with refers (the response that a revisit repeats, else null):
    of equal payloads of ``min_revisit`` bytes or more the largest key is the
    response. Records that tie for the largest key are all responses, and all
    are where no record of the group has a key."""
    what = F.struct("key", "record_id", "url", "date")
    first = (records.where(F.col("payload_bytes") >= min_revisit).groupBy("sha1", "payload_bytes")
             .agg(F.max(F.when(F.col("key").isNotNull(), what)).alias("response")))
    joined = records.join(first, ["sha1", "payload_bytes"], "left")
    again = F.col("response").isNotNull() & ~F.col("key").eqNullSafe(F.col("response.key"))
    return joined.withColumn("refers", F.when(again, F.col("response"))).drop("response")


def _iso(date: str) -> str:
    d = (date + "00000101000000"[len(date):])[:14] if date.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(r: dict) -> bytes:
    """The record without the blank lines that end it."""
    refers, head, payload = r["refers"], r["head"], r["payload"]
    block = head if refers else head + payload
    fields = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", _iso(r["date"])),
              ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"]),
              ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(r["sha1"])).decode()), ("WARC-Block-Digest", _sha1(block)),
              ("X-Payload-Length", r["payload_bytes"]), ("X-Converted-From", f"ARC/{r['version']} {r['archive']} {r['offset']}")]
    if refers:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To", refers["record_id"]),
                   ("WARC-Refers-To-Target-URI", refers["url"]), ("WARC-Refers-To-Date", _iso(refers["date"])), ("X-Refers-To-Key", refers["key"])]
    if r["key"] is not None:
        fields.append(("X-Key", r["key"]))
    if r["truncated"]:
        fields.append(("WARC-Truncated", "length"))
    fields += [("Content-Type", "application/http; msgtype=response" if head else r["mime"]), ("Content-Length", len(block))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block


def write_warc(typed: DataFrame, path: str) -> None:
    """Write records of ``with_types`` as gzipped WARC files in ``path``, one
    for each partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                rows = b.slice(k, 256).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([warc_record(r) for r in rows], pa.binary())], ["record"])

    (typed.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path))


# ------------------------------------------------------------------ reading WARC

def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of a WARC file."""
    if content[:2] == b"\x1f\x8b":
        content = _gunzip(content)
    at = 0
    while content.startswith(b"WARC/", at):
        end = content.index(b"\r\n\r\n", at)
        fields = {}
        for line in content[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            fields[k.strip().lower()] = v.strip()
        start = end + 4
        stop = start + int(fields["content-length"])
        yield fields, content[start:stop]
        at = stop + 4
    if at < len(content):
        raise ValueError(f"no WARC record at byte {at}")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to,
    record_id, url, date) of each record of the WARC files in ``path``. The
    digest of a response is computed from the payload that was read and must
    equal the stated one."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, date string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows = []
                for f, block in parse_warc(content.as_py()):
                    digest = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if f["warc-type"] == "response":
                        payload = _split_http(block)[1]
                        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(f["x-payload-length"]):
                            raise ValueError(f"record {f['warc-record-id']}: the payload is not the stated one")
                    key, refers = f.get("x-key"), f.get("x-refers-to-key")
                    rows.append((key and int(key), int(f["x-payload-length"]), digest, f["warc-type"], refers and int(refers),
                                 f["warc-record-id"], f["warc-target-uri"], f["warc-date"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string()] * 3)],
                                                     ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "date"])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, schema)


def pages_to_warc(pages: DataFrame, path: str, min_revisit: int = 1000) -> DataFrame:
    """Pages go into ARC files, those are converted to WARC files in ``path``,
    and the result is what ``read_warc`` reads there. One row per row of
    ``pages`` (page_id, url, html); repeated rows are records of their own, a
    null page_id stays null. No pages: no rows."""
    records = arc_records(write_arc(pages))
    write_warc(with_types(records, min_revisit), path)
    return read_warc(pages.sparkSession, path)
