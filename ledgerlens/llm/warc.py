"""WARC archives: write with an index, then read selected records by coalesced byte ranges.

Writing yields one index row per record (file, offset, length, URL, digest).  Reading starts from index rows: they are
sorted by file and offset, neighbouring ranges are merged into larger reads, and each record is cut out of its range.
Every record is its own gzip member, so any range can be decompressed alone.  Files lie in the shared folder; a file
counts only through index rows, so what a failed or repeated task attempt has left is never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import agg_back, shuffle_partitions, small_batches, stored, values
from ledgerlens.sources.io import fresh_dir

INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string"
RECORD = ("page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, "
          "payload binary")
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
GAP_BYTES = 64 << 10
RANGE_BYTES = 8 << 20


def _filesystem(uri: str):
    import pyarrow.fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri)


def _record_uri(page_id) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'page:{page_id}'.encode()).digest())}>"


def _header_text(value: str) -> str:
    return "".join(c if ord(c) > 32 and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def warc_record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = HTTP_HEAD + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {_record_uri(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_text(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_record_uri(refers_to)}", f"X-Refers-To-Page: {refers_to}",
                 f"X-Payload-Length: {len(payload)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    return fields, block[len(HTTP_HEAD):]


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
               revisit_min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row below ``folder``; returns the stored index (one row per record).

    The payload is the body in UTF-8; a null body is empty.  Of records with equal payloads of at least
    ``revisit_min_bytes`` bytes the one with the smallest id is a response and the others are revisits of it; smaller
    payloads are all responses.  Rows repeating that smallest id are responses as well; rows without an id are
    responses.  A null URL leaves the header out.  An empty table writes nothing and has an empty index.
    """
    small_batches(pages.sparkSession)
    body = F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        body.alias("body"))
    keys = rows.where("page_id is not null").select("page_id", F.sha1("body").alias("sha"),
                                                    F.octet_length("body").cast("long").alias("n"))
    keys = keys.where(F.col("n") >= revisit_min_bytes)
    first = agg_back(keys, ["sha", "n"], {"first_id": ("min", F.col("page_id"))}, F.col("page_id"))
    later = first.where("page_id > first_id").select(F.col("page_id").alias("r_id"), F.col("sha").alias("r_sha"),
                                                     "first_id").distinct()
    linked = rows.withColumn("sha", F.sha1("body")).join(
        later, (F.col("page_id") == F.col("r_id")) & (F.col("sha") == F.col("r_sha")), "left")

    def write(batches):
        fs, root = _filesystem(folder)
        ctx = TaskContext.get()
        name = f"part-{ctx.partitionId():05d}-{ctx.taskAttemptId()}.warc.gz"
        out, at = None, 0
        try:
            for b in batches:
                index = []
                for page_id, url, payload, refers_to in zip(*map(values, b.columns), strict=True):
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    member = gzip.compress(warc_record(page_id, url, payload, refers_to, date), 4, mtime=0)
                    out.write(member)
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    index.append((page_id, url, name, at, len(member), digest,
                                  "response" if refers_to is None else "revisit"))
                    at += len(member)
                if index:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*index, strict=True), _INDEX_TYPES, strict=True)],
                        names=_INDEX_NAMES)
        finally:
            if out is not None:
                out.close()

    return stored(linked.select("page_id", "url", "body", "first_id").mapInArrow(write, INDEX), "warc-index")


_INDEX_NAMES = [c.split()[0] for c in INDEX.split(", ")]
_INDEX_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
_RECORD_NAMES = [c.split()[0] for c in RECORD.split(", ")]
_RECORD_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]


def coalesce_ranges(rows, gap: int = GAP_BYTES, most: int = RANGE_BYTES):
    """Group (file, offset, length, ...) rows sorted by file and offset into ranges read at once."""
    group: list = []
    end = 0
    for r in rows:
        if group and (r[0] != group[0][0] or r[1] > end + gap or r[1] + r[2] - group[0][1] > most):
            yield group
            group = []
        end = max(end, r[1] + r[2]) if group else r[1] + r[2]
        group.append(r)
    if group:
        yield group


def read_warc(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Read the records that the given index rows name: columns of ``RECORD``; digest and size are of the full payload.

    A response's digest is computed from the bytes read; a revisit has no payload (null) and reports what its header
    says of the payload it repeats.  An empty index gives no rows.
    """
    def read(batches):
        fs, root = _filesystem(folder)
        open_name, handle = None, None
        try:
            for b in batches:
                cols = [b.column(n).to_pylist() for n in ("file", "offset", "length")]
                for group in coalesce_ranges(zip(*cols, strict=True)):
                    if group[0][0] != open_name:
                        if handle is not None:
                            handle.close()
                        open_name, handle = group[0][0], fs.open_input_file(f"{root}/{group[0][0]}")
                    base = group[0][1]
                    handle.seek(base)
                    data = handle.read(max(o + n for _, o, n in group) - base)
                    yield _records(group, data, base, with_payload)
        finally:
            if handle is not None:
                handle.close()

    n = shuffle_partitions(index.sparkSession)
    dealt = index.select("file", "offset", "length").repartitionByRange(n, "file", "offset")
    return dealt.sortWithinPartitions("file", "offset").mapInArrow(read, RECORD)


def _records(group, data: bytes, base: int, with_payload: bool) -> pa.RecordBatch:
    rows = []
    for _, offset, length in group:
        f, payload = parse_record(zlib.decompress(data[offset - base:offset - base + length], 31))
        page_id = f.get("X-Page-Id")
        common = (None if page_id is None else int(page_id), f.get("WARC-Target-URI"), f["WARC-Type"])
        if f["WARC-Type"] == "response":
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if f["WARC-Payload-Digest"] != f"sha1:{digest}":
                raise ValueError(f"damaged record at {offset}: its payload does not have the digest of its header")
            rows.append((*common, None, digest, len(payload), payload if with_payload else None))
        else:
            rows.append((*common, int(f["X-Refers-To-Page"]), f["WARC-Payload-Digest"].removeprefix("sha1:"),
                         int(f["X-Payload-Length"]), None))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RECORD_TYPES, strict=True)],
                                      names=_RECORD_NAMES)


def archive_folder(spark) -> str:
    """A new folder for archives under the shared checkpoint location."""
    return fresh_dir(spark, "warc")
