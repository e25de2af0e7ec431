"""Operator 10: web archives packaged in ZIP files, written by tasks and read by ranges.

A package holds ``archive/data.warc.gz`` and ``indexes/index.jsonl`` as stored members.
Each record is a gzip member of its own, so a record is a byte range of the package.
The reader parses the end record, its ZIP64 form where there is one, and the central
directory; finds each stored member behind its local header; and reads the index and
the records by range. Nothing is extracted and no package is read whole.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmaps import bits_for, collect_bitmap, is_in, numbers_of
from .scratch import bounded_batches, materialise, scratch_dir

#: Bytes of compressed records after which a task begins the next package.
PACKAGE_BYTES = 16 << 20
#: Reading tasks for each shuffle partition of the session, at most; a task reads its packages one after the other.
PACKAGE_TASKS = 4
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
_EPOCH = "1970-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- records ------------------------------------------------------------------


def record_bytes(record_type: str, uri: str, record_id: str, payload: bytes, digest: str, full_length: int, refers_to: str | None = None, date: str = _EPOCH) -> bytes:
    """One WARC 1.1 record; a revisit has the HTTP head alone and names the record that holds its payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {full_length}\r\n\r\n".encode()
    block = head + (payload if record_type == "response" else b"")
    fields = [
        ("WARC-Type", record_type),
        ("WARC-Record-ID", record_id),
        ("WARC-Date", date),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), uri)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if record_type == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers_to or "")]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of one record; names in lower case."""
    top, _, rest = data.partition(b"\r\n\r\n")
    lines = top.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) < int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than it says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode("utf-8").split("\r\n")[1:])}, payload


# --- ZIP by ranges --------------------------------------------------------------


def zip_members(read, size: int) -> dict[str, tuple[int, int, int]]:
    """(local header offset, stored size, method) by name, from the central directory. ``read(offset, length)`` gives bytes."""
    tail_at = max(0, size - 22 - 65535)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("not a ZIP file: no end record")
    count, length, start = struct.unpack_from("<10xHII", tail, end)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = read(tail_at + end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("a ZIP64 file without its locator")
        wide = read(struct.unpack_from("<8xQ", locator)[0], 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("a ZIP64 file without its end record")
        count, length, start = struct.unpack_from("<32xQQQ", wide)
    directory, at, out = read(start, length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("a broken central directory")
        flags, method, packed, full, n, m, k, offset = struct.unpack_from("<8xHH8xIIHHH8xI", directory, at)
        name = directory[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, x = directory[at + 46 + n : at + 46 + n + m], 0
        while x + 4 <= len(extra):
            kind, size_of = struct.unpack_from("<HH", extra, x)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{size_of // 8}Q", extra, x + 4))
                full = next(values) if full == 0xFFFFFFFF else full
                packed = next(values) if packed == 0xFFFFFFFF else packed
                offset = next(values) if offset == 0xFFFFFFFF else offset
            x += 4 + size_of
        out[name] = (offset, packed, method)
        at += 46 + n + m + k
    return out


def stored_range(read, member: tuple[int, int, int]) -> tuple[int, int]:
    """(offset, length) of a stored member's bytes in the package."""
    offset, size, method = member
    if method:
        raise ValueError("the member is compressed, not stored")
    head = read(offset, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("a broken local header")
    n, m = struct.unpack_from("<26xHH", head)
    return offset + 30 + n + m, size


def _opened(path: str):
    where, name = fs.FileSystem.from_uri(path)
    return where, name


class Package:
    """A package opened for reads by range."""

    def __init__(self, path: str):
        where, name = _opened(path)
        self.file = where.open_input_file(name)
        self.members = zip_members(self.read, self.file.size())

    def read(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def range_of(self, name: str) -> tuple[int, int]:
        return stored_range(self.read, self.members[name])

    def lines(self, name: str, step: int = 1 << 20):
        """The lines of a stored member, read in steps."""
        offset, left = self.range_of(name)
        rest = b""
        while left:
            part = self.read(offset, min(step, left))
            offset, left = offset + len(part), left - len(part)
            *whole, rest = (rest + part).split(b"\n")
            yield from whole
        if rest:
            yield rest

    def close(self) -> None:
        self.file.close()


# --- Spark stages ---------------------------------------------------------------


def plan_records(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, n, url, html, record_type, refers_to, refers_n): of pages with equal payloads of at least ``least`` bytes the one with the largest id is the response.

    Payloads are equal when their lengths and SHA-256 are. Only digests are counted; a
    bitmap of the repeated ones tells which pages are written down to be told apart,
    all others stay where they are read. Such a page has a number ``n``, null for the
    others, which decides between rows that repeat an id and a payload: one of them is
    the response. A page without an id is the response only if its whole group has none.
    """
    text = F.coalesce(F.col(html_col), F.lit(""))
    rows = bounded_batches(pages).select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text.alias("html"), F.unhex(F.sha2(text, 256)).alias("key"), F.octet_length(text).alias("size"))
    again = rows.filter(F.col("size") >= least).groupBy("key", "size").agg(F.count("*").alias("copies")).filter("copies > 1").select("key")
    held = pages.sparkSession.sparkContext.broadcast(collect_bitmap(again, bits_for(pages.count())))

    @F.pandas_udf("boolean")
    def may_repeat(keys: pd.Series) -> pd.Series:
        return pd.Series(is_in(np.frombuffer(held.value, np.uint8), numbers_of(pa.array(keys, pa.binary()))))

    alone = rows.filter(~may_repeat("key")).select("id", F.lit(None).cast("long").alias("n"), "url", "html", F.lit("response").alias("record_type"), F.lit(None).cast(rows.schema["id"].dataType).alias("refers_to"), F.lit(None).cast("long").alias("refers_n"))
    numbered = materialise(rows.filter(may_repeat("key")).withColumn("n", F.monotonically_increasing_id()), "repeated")
    first = numbered.filter(F.col("size") >= least).groupBy("key", "size").agg(F.max(F.struct("id", "n")).alias("first"))
    joined = numbered.join(first, ["key", "size"], "left")
    later = F.col("first.n").isNotNull() & (F.col("n") != F.col("first.n"))
    known = joined.select("id", "n", "url", "html", F.when(later, "revisit").otherwise("response").alias("record_type"), F.when(later, F.col("first.id")).alias("refers_to"), F.when(later, F.col("first.n")).alias("refers_n"))
    return alone.union(known)


def _name(own, n, digest: str) -> str:
    """A record's name: its page's id, its payload's digest and, where payloads repeat, its number."""
    return f"urn:page:{'' if own is None else '=' + quote(str(own), safe='')}:{digest}" + (f":{n}" if n is not None else "")


def _id_of(name: str | None) -> str | None:
    own = (name or "<urn:page::>").split(":")[2]
    return unquote(own[1:]) if own else None


def write_packages(records: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write ``records`` (as from ``plan_records``) as packages under ``folder``; (path, records) a row per package.

    A package's name is new for every attempt at it and only packages named in the
    result count, so a task that runs twice leaves no record twice. A task holds one
    package at a time, and a record larger than a package has one of its own.
    """

    def run(batches):
        where, base = _opened(folder)
        where.create_dir(base, recursive=True)
        body, index, n = io.BytesIO(), io.BytesIO(), 0

        def flush():
            name = f"{uuid.uuid4().hex}.zip"
            with where.open_output_stream(f"{base}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                for member_name, data in ((ARCHIVE, body), (INDEX, index)):
                    with z.open(zipfile.ZipInfo(member_name), "w", force_zip64=True) as member:
                        member.write(data.getbuffer())
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([n], pa.int64())})

        for batch in batches:
            for r in batch.to_pylist():
                payload = r["html"].encode("utf-8", "surrogatepass")
                digest = base32_sha1(payload)
                name, revisit = _name(r["id"], r["n"], digest), r["record_type"] == "revisit"
                refers_to = f"<{_name(r['refers_to'], r['refers_n'], digest)}>" if revisit else None
                data = gzip.compress(record_bytes(r["record_type"], r["url"] or name, f"<{name}>", payload, digest, len(payload), refers_to), 6, mtime=0)
                entry = {"id": f"<{name}>", "url": r["url"], "offset": body.tell(), "length": len(data), "digest": digest, "type": r["record_type"]}
                index.write(json.dumps(entry).encode() + b"\n")
                body.write(data)
                n += 1
                if body.tell() >= package_bytes:
                    yield flush()
                    body, index, n = io.BytesIO(), io.BytesIO(), 0
        if n:
            yield flush()

    return records.mapInArrow(run, "path string, records long")


def read_packages(paths: DataFrame, id_type: str = "long") -> DataFrame:
    """A row per record of the packages in ``paths``.path: (path, id, url, payload_bytes, payload_digest, record_type, refers_to, payload).

    Each record is read by its own range, its url as it was given from the index. A
    revisit's length and digest are those of the full payload it stands for; its
    payload is null. A response whose bytes do not match its digest fails the read, and
    so does a record that isn't the one its index entry names.
    """
    ddl = "path string, id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"
    names = ["path", "id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                package, rows, held = Package(path), [], 0
                start, length = package.range_of(ARCHIVE)
                for line in package.lines(INDEX):
                    entry = json.loads(line)
                    if entry["offset"] + entry["length"] > length:
                        raise ValueError(f"{path}: the index leads past the archive")
                    fields, http, payload = parse_record(gzip.decompress(package.read(start + entry["offset"], entry["length"])))
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    whole = fields["warc-type"] == "response"
                    if fields["warc-record-id"] != entry["id"] or whole and base32_sha1(payload) != digest:
                        raise ValueError(f"{path}: record {entry['id']} does not match its digest or its index entry")
                    rows.append((path, _id_of(fields["warc-record-id"]), entry["url"], len(payload) if whole else int(http["content-length"]), digest, fields["warc-type"], _id_of(fields.get("warc-refers-to")), payload if whole else None))
                    held += len(payload)
                    if held > 8 << 20 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, held = [], 0
                package.close()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    found = paths.select("path").mapInArrow(run, ddl)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("id", "refers_to")})


def archive_pages(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all ``pages`` to packages in the shared folder and read them back; see ``read_packages``.

    Null html is an empty payload. Urls come back as given, null ones as null; in the
    record, white space in them is percent-encoded and a null one gives way to the
    record's own name. Ids may be of any type that casts from a string; pages without
    one are written and read with id null. Rows that repeat an id are records of their
    own; of those that repeat a payload too one is the response. An empty table makes no
    package. Other columns are not read.
    """
    written = materialise(write_packages(plan_records(pages, least), scratch_dir(spark, "warc")), "packages")
    tasks = min(written.count(), PACKAGE_TASKS * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read_packages(written.repartition(max(1, tasks)), dict(pages.dtypes)["page_id"])
