"""WARC archives with an index written first, and reads by coalesced ranges.

Writing: records with equal payloads are found by their SHA-1, grouped before
any payload moves. The one with the smallest page id becomes a ``response``,
the others ``revisit`` records that refer to it. Each task writes gzip members,
one a record, into a file of its own name in the archive folder, and returns
for every record its file, offset, length, URL and digest. Those rows, stored
as a table, are the index. A file of a task that died is in no index row and so
is never read; the task's next attempt writes another file.

Reading: index rows, selected by any filter, are sorted by file and offset;
ranges that touch, or lie close, are fetched by one read, cut into members,
decoded, and checked against their digests.

The archive folder is reached through ``pyarrow.fs`` by its URI, so it may be
in any store that all executors reach.

Defined results: a null html is an empty payload. A null url is written as
``about:blank``; control characters and blanks in URLs are percent-encoded in
the record, not in the index. Of records with equal payloads and one page id
(repeated rows) each is a response if that id is the smallest. A record with a
null page id is a revisit if an equal payload has an id, else a response.
Payloads shorter than ``min_bytes`` are all responses. Other columns are not
read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.runtime import store_uri

from .common import materialize, read_table, scratch_path

DATE = "2024-01-01T00:00:00Z"
#: Bytes after which a task starts another file.
FILE_BYTES = 1 << 30
#: Gaps up to this many bytes are read over; a read stops growing at READ_BYTES.
GAP_BYTES = 1 << 16
READ_BYTES = 8 << 20
#: Bytes of an archive that one reading task takes, about.
STRETCH_BYTES = 8 << 20

INDEX = (
    "page_id long, url string, payload_digest string, payload_bytes long, record_type string, "
    "file string, offset long, length long"
)
RECORD = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
)


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record, uncompressed. A revisit has no payload."""
    body = payload if not revisit else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=_URL_SAFE) if url else 'about:blank'}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(http) + len(body)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(first, digest)}",
            f"X-Refers-To-Page: {first}",
            f"X-Payload-Length: {len(payload)}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


_URL_SAFE = "".join(chr(c) for c in range(33, 127))


def decode_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and the payload; raises on a malformed record."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    n = int(fields["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("record length does not match")
    return fields, rest[:n].partition(b"\r\n\r\n")[2]


def _gzip(raw: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _writer(folder: str, level: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, sha, kind, first in zip(*(batch.column(i) for i in range(6)), strict=True):
                    payload = html.as_py()
                    if isinstance(payload, str):
                        payload = payload.encode()
                    payload = payload or b""
                    digest = base32_sha1(sha.as_py())
                    page_id, url, kind = page_id.as_py(), url.as_py(), kind.as_py()
                    member = _gzip(encode_record(page_id, url, payload, digest, first.as_py(), kind == "revisit"), level)
                    if out is None or at + len(member) > file_bytes and at:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        fs.create_dir(root, recursive=True)
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(member)
                    rows.append((page_id, url, digest, len(payload), kind, name, at, len(member)))
                    at += len(member)
                if rows:
                    cols = list(zip(*rows, strict=True))
                    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.split()[0] for f in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return run


def write_archive(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
    level: int = 6,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write one record for each row; returns the stored index."""
    folder = store_uri(pages.sparkSession, folder)
    src = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("html"),
    )
    src = src.select("page_id", "url", "html", F.sha1("html").alias("sha"), F.octet_length("html").alias("n"))
    # Stored, the aggregate meets its pages in a join that Spark can split at a
    # hot payload; the narrow side builds the hash table, so no payload is sorted.
    first = materialize(src.groupBy("sha").agg(F.min("page_id").alias("first")), "warc-firsts")
    typed = src.join(first.hint("shuffle_hash"), "sha")
    revisit = (F.col("n") >= min_bytes) & F.col("first").isNotNull() & (F.coalesce("page_id", F.col("first") - 1) != F.col("first"))
    typed = typed.select(
        "page_id", "url", "html", "sha", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("first")
    )
    return materialize(typed.mapInArrow(_writer(folder, level, file_bytes), INDEX), "warc-index")


def coalesce_ranges(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, int, int]]:
    """Sorted (offset, length) into reads: (offset, length, first, last + 1)."""
    out: list[list[int]] = []
    for i, (at, n) in enumerate(ranges):
        if out and at <= out[-1][0] + out[-1][1] + gap and at + n - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], at + n - out[-1][0])
            out[-1][3] = i + 1
        else:
            out.append([at, n, i, i + 1])
    return [tuple(r) for r in out]


def _reader(folder: str, with_payload: bool):
    def decode(name: str, rows: list[tuple], fs, root: str) -> Iterator[tuple]:
        with fs.open_input_file(f"{root}/{name}") as f:
            for at, n, lo, hi in coalesce_ranges([(r[0], r[1]) for r in rows]):
                f.seek(at)
                piece = f.read(n)
                for off, length, url in rows[lo:hi]:
                    fields, payload = decode_record(zlib.decompress(piece[off - at : off - at + length], 31))
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = fields["WARC-Type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"payload digest does not match in {name} at {off}")
                    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
                    size = int(fields["X-Payload-Length"]) if kind == "revisit" else len(payload)
                    yield (
                        None if page is None else int(page),
                        url,
                        size,
                        digest,
                        kind,
                        None if refers is None else int(refers),
                        payload if with_payload else None,
                    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        names = [f.split()[0] for f in RECORD.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            by_file: dict[str, list[tuple]] = {}
            for name, off, length, url in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                by_file.setdefault(name, []).append((off, length, url))
            out, held = [], 0
            for name, rows in sorted(by_file.items()):
                for rec in decode(name, sorted(rows, key=lambda r: r[:2]), fs, root):
                    out.append(rec)
                    held += len(rec[6] or b"") + 64
                    if held > READ_BYTES:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                        out, held = [], 0
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return run


def read_archive(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records that the rows of ``index`` name, decoded and verified.

    Rows are dealt by file and stretch of the file and sorted within, so reads
    go forward and neighbours meet in one task; a large file is split. The
    payload of a revisit is empty: that of the response it refers to is its own.
    """
    folder = store_uri(index.sparkSession, folder)
    stretch = F.floor(F.col("offset") / F.lit(STRETCH_BYTES))
    dealt = index.select("file", "offset", "length", "url", stretch.alias("stretch"))
    # Index rows are small and what they name is not: the number of tasks goes
    # by the bytes to read, or Spark would merge them all into one.
    total = dealt.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, -(-total // STRETCH_BYTES))
    dealt = dealt.repartition(tasks, "file", "stretch").sortWithinPartitions("file", "offset")
    return dealt.select("file", "offset", "length", "url").mapInArrow(_reader(folder, with_payload), RECORD)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    index = write_archive(read_table(spark, sf_dir, "pages"), folder)
    return read_archive(index, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
