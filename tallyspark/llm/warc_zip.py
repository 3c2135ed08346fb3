"""Operator 7: WARC records in ZIP packages, read back by ranges.

An archive is a ZIP file whose members are stored, not compressed: archive/data.warc.gz (each record a gzip member of its own) and
indexes/index.cdxj (a line per record with its offset and length). The reader never extracts an archive: it reads the end of the
file, parses the end record, the ZIP64 end record and the central directory (with ZIP64 sizes and offsets), locates the stored
members by their local headers, reads the index, and deals out ranges of about SLICE_BYTES that begin and end with records. Tasks
read just their ranges.

Of pages with equal payloads of DEDUP_BYTES or more the smallest page_id is a response; others are revisits without a payload that
refer to it. Rows that repeat both page_id and payload are all what that page_id is. Null html is an empty payload; a null url
gives a record without a target. Files go to a folder on the shared file system under new names; only files that a finished task
reports are read, so what retries and lost executors leave behind is not. Very long payloads are written and read whole, one at a time. An
empty table gives no archive and no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, fitting, materialise, shared_dir, spread

DEDUP_BYTES = 0
ARCHIVE_BYTES, SLICE_BYTES = 64 << 20, 4 << 20
WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
COLUMNS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; file:, hdfs:, s3: and others that Arrow knows."""
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit of the response that holds the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        *([] if url is None else [f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url)}"]),
        *([] if refers_to is None else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]),
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", "",
    ]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _write_archive(uri: str, records: Iterator[tuple[bytes, dict]]) -> int:
    """Write records until the archive is full; how many there are."""
    system, path = store(uri)
    at, index = 0, []
    with system.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        with z.open(zipfile.ZipInfo(WARC), "w", force_zip64=True) as member:
            for raw, about in records:
                packed = zlib.compressobj(1, zlib.DEFLATED, 31)
                body = packed.compress(raw) + packed.flush()
                member.write(body)
                index.append(json.dumps(about | {"offset": at, "length": len(body)}))
                at += len(body)
                if at >= ARCHIVE_BYTES:
                    break
        z.writestr(zipfile.ZipInfo(INDEX), "".join(x + "\n" for x in index))
    return len(index)


def _writer(folder: str) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, dict]]:
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, sha1, refers_to = (c[i].as_py() for c in batch.columns)
                payload = (html or "").encode()
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                yield record(page_id, url, payload, digest, refers_to), {"page_id": page_id, "digest": digest}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = rows(batches)
        for first in source:
            uri = f"{folder}/{uuid.uuid4().hex}.zip"
            n = _write_archive(uri, chain([first], source))  # not a generator: left when the archive is full, that would close source and lose its rest
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n])], ["uri", "records"])

    return work


def write(pages: DataFrame, folder: str, dedup_bytes: int = DEDUP_BYTES) -> DataFrame:
    """Write archives of pages (page_id, url, html) into folder; (uri, records) of each archive."""
    bounded_batches(pages)
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha1"))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    several = rows.where(size >= dedup_bytes).groupBy("sha1").agg(F.count_distinct("page_id").alias("n"), F.min("page_id").alias("first")).where("n > 1").select("sha1", "first")
    marked = rows.join(fitting(several), "sha1", "left").select("page_id", "url", "html", "sha1", F.when((F.col("first") < F.col("page_id")) & (size >= dedup_bytes), F.col("first")).alias("refers_to"))
    system, path = store(folder)
    system.create_dir(path)
    return materialise(marked.mapInArrow(_writer(folder), "uri string, records long"))


def directory(f: pa.NativeFile) -> dict[str, tuple[int, int]]:
    """Name: (offset, length) of the stored members of a ZIP file, from its central directory."""
    size = f.size()
    tail_at = max(0, size - 22 - 65535 - 20)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP file: no end record")
    count, length, begin = struct.unpack("<HII", tail[end + 10 : end + 20])
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":  # the ZIP64 end record's locator
        (at,) = struct.unpack("<Q", tail[end - 12 : end - 4])
        f.seek(at)
        wide = f.read(56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record where its locator points")
        count, length, begin = struct.unpack("<QQQ", wide[32:56])
    f.seek(begin)
    raw, at, out = f.read(length), 0, {}
    for _ in range(count):
        sig, method, packed, full, names, extras, comments, local = struct.unpack("<4s6xH8xIIHHH8xI", raw[at : at + 46])
        if sig != b"PK\x01\x02":
            raise ValueError("bad entry in the central directory")
        name = raw[at + 46 : at + 46 + names].decode()
        extra = raw[at + 46 + names : at + 46 + names + extras]
        while len(extra) >= 4:
            tag, n = struct.unpack("<HH", extra[:4])
            if tag == 1:  # ZIP64: only those of the values that don't fit, in this order
                wide = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            extra = extra[4 + n :]
        at += 46 + names + extras + comments
        if method == 0:
            f.seek(local)
            head = f.read(30)
            n, m = struct.unpack("<HH", head[26:30])
            out[name] = (local + 30 + n + m, packed)
    return out


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of whole records of each archive: where each begins and how long its records are."""
    for batch in batches:
        for uri in batch.column("uri").to_pylist():
            system, path = store(uri)
            with system.open_input_file(path) as f:
                members = directory(f)
                base, _ = members[WARC]
                at, size = members[INDEX]
                f.seek(at)
                lines = [json.loads(x) for x in f.read(size).decode().splitlines()]
            offsets, sizes, total = [], [], SLICE_BYTES
            for x in lines:
                if total + x["length"] > SLICE_BYTES:
                    offsets.append(base + x["offset"])
                    sizes.append([])
                    total = 0
                sizes[-1].append(x["length"])
                total += x["length"]
            yield pa.RecordBatch.from_arrays([pa.array([uri] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.list_(pa.int64()))], ["uri", "offset", "sizes"])


def parsed(raw: bytes) -> dict:
    """Columns of one record; digest and length of a response come from the payload itself."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    kind, own, other = fields["WARC-Type"], fields["WARC-Record-ID"][10:-1], fields.get("WARC-Refers-To", "")[10:-1]
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
    if kind == "response":
        payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (found, len(payload)) != (digest, size):
            raise ValueError(f"record {own}: its payload doesn't match its digest")
    return {"page_id": int(own) if own else None, "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": int(other) if other else None}


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    for batch in batches:
        for uri, offset, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            system, path = store(uri)
            with system.open_input_file(path) as f:
                f.seek(offset)
                out = [parsed(zlib.decompress(f.read(n), 31)) for n in sizes]
            yield pa.RecordBatch.from_pylist(out, kinds)


def read(archives: DataFrame) -> DataFrame:
    """The records of archives (uri)."""
    ranges = spread(archives.select("uri"), "uri").mapInArrow(_planned, "uri string, offset long, sizes array<long>")
    return spread(ranges, "uri", "offset").mapInArrow(_ranges, COLUMNS)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages to new archives in the shared folder and read them back."""
    return read(write(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"))


ORACLE_SQL = """
with p as (
  select page_id, encode(coalesce(html, '')) as b from pages
), d as (
  select page_id, octet_length(b) as payload_bytes, sha1(b) as h from p
), f as (
  select *, min(page_id) over (partition by h) as first from d
)
select page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int + 1, 1)), '') as payload_digest,
  case when first < page_id then 'revisit' else 'response' end as record_type,
  case when first < page_id then first end as refers_to
from f
"""
