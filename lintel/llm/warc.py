"""WARC archives of pages: a writer with revisit records, and a reader that salvages what damaged archives still hold.

Writing: payloads are grouped by SHA-1; of equal payloads of at least `min_bytes` bytes the record with the largest page_id
is a response, others are revisits that refer to it; smaller payloads are all responses. Each record is one gzip member.
Archives roll over at `roll_bytes`, are written under a temporary name in the shared folder, renamed when whole, and count
only if the task that wrote them committed its rows of the manifest; a lost or repeated task leaves no trace in it.

Reading: a member (or, uncompressed, a record) must inflate with a right checksum, begin with a version line, have the length
its header gives and a block with the digest its header gives. If a check fails, the reader looks for the next gzip member that
starts with a version line (or the next version line), goes on from there and logs the bytes between as a quarantined gap. Whole
records at the beginning of a member that is cut off are returned; of one with wrong bits none are, as only its checksum guards headers. Behind a plain record whose block is damaged but ends where its
header says, reading goes on there, so that archives quoted in a payload are not taken for records.

Defined results: a null html is an empty payload; a null page_id gives a response unless another page has the same payload;
pages with the same id and payload are responses both; an empty table gives no archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.llm.common import fresh_path, staged

VERSION = b"WARC/1.1\r\n"
MAGIC = b"\x1f\x8b\x08"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, records long, bytes long"
RECORDS = "path string, start long, length long, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long"
GAPS = "path string, start long, length long, reason string"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, compress: bool = True) -> bytes:
    """One record: a response with its payload, or, if `refers_to` is given, a revisit with headers only."""
    head = HTTP % len(payload)
    revisit = refers_to is not None
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:x-page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "", safe="%/:=&?~#+!$,;'@()*[]")),
        ("WARC-Payload-Digest", f"sha1:{digest32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest32(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>")]
    raw = VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"
    if not compress:
        return raw
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class Damaged(ValueError):
    """A check failed. `resume`: where the damaged record's own header says that it ends, if it does; `whole`: what a member that is cut off inflated to."""

    def __init__(self, reason: str, resume: int | None = None, whole: bytes = b""):
        super().__init__(reason)
        self.resume, self.whole = resume, whole


def _record(raw: bytes, at: int) -> tuple[dict, int]:
    """The record at `at` of uncompressed bytes, and where it ends; Damaged if a check fails."""
    if raw[at : at + 5] != b"WARC/":
        raise Damaged("no version line")
    end = raw.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("header cut off")
    fields = {}
    for line in raw[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    if not size.isdecimal():
        raise Damaged("no content length")
    start, stop = end + 4, end + 4 + int(size)
    if raw[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("length does not match")
    block = raw[start:stop]
    # a block that is damaged but as long as its header says may quote archives: the next record is behind it
    after = stop + 4 if raw[stop + 4 : stop + 9] in (b"", b"WARC/") else None
    if fields.get("warc-block-digest", "").removeprefix("sha1:") not in ("", digest32(block)):
        raise Damaged("block digest does not match", after)
    head, _, payload = block.partition(b"\r\n\r\n")
    kind, declared = fields.get("warc-type", ""), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    length = re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)
    if kind == "response" and declared not in ("", digest32(payload)):
        raise Damaged("payload digest does not match", after)
    ident = lambda name: int(m[1]) if (m := re.search(r"urn:x-page:(-?\d+)", fields.get(name, ""))) else None
    return {
        "record_type": kind, "page_id": ident("warc-record-id"), "url": fields.get("warc-target-uri"),
        "payload_bytes": len(payload) if kind == "response" else int(length[1]) if length else None,
        "payload_digest": declared or digest32(payload), "refers_to": ident("warc-refers-to"), "payload": payload if kind == "response" else None,
    }, stop + 4


def _whole_records(raw: bytes) -> Iterator[dict]:
    """The records at the beginning of what a member that is cut off inflated to, each with more behind it."""
    at = 0
    while at < len(raw):
        try:
            fields, at = _record(raw, at)
        except Damaged:
            return
        if at < len(raw):
            yield fields


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """The gzip member at `at`, inflated, and where it ends; fed in steps, as what follows a member is handed back as a copy."""
    z, raw, view, step = zlib.decompressobj(31), [], memoryview(data), 1 << 14
    while not z.eof:
        if at >= len(data):
            raise Damaged("member cut off", whole=b"".join(raw))
        try:
            raw.append(z.decompress(view[at : at + step]))
        except zlib.error as e:
            raise Damaged(str(e)) from None
        at += step
    return b"".join(raw), min(at, len(data)) - len(z.unused_data)


def _starts_record(data: bytes, at: int) -> bool:
    try:
        return zlib.decompressobj(31).decompress(memoryview(data)[at : at + 512], 5) == b"WARC/"
    except zlib.error:
        return False


def _next_start(data: bytes, at: int) -> int:
    """The next place from `at` on where a member with a version line, or a bare version line, may begin; else the end."""
    for m in re.finditer(rb"\x1f\x8b\x08|WARC/\d\.\d\r\n", memoryview(data)[at:]):
        if m[0][:1] == b"W" or _starts_record(data, at + m.start()):
            return at + m.start()
    return len(data)


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict | str]]:
    """("record", start, length, fields) and ("gap", start, length, reason), in order, covering every byte of the archive."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        found = []
        try:
            if data[at : at + 3] == MAGIC:
                raw, end = _member(data, at)
                inner = 0
                while inner < len(raw):
                    fields, inner = _record(raw, inner)
                    found.append(fields)
            else:
                fields, end = _record(data, at)
                found.append(fields)
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            for fields in found or _whole_records(e.whole):  # whole records before the damage inside a member
                yield "record", at, 0, fields
            plain = data[at : at + 3] != MAGIC
            at = e.resume if plain and e.resume is not None else _next_start(data, at + 1)
            continue
        if gap is not None:
            yield "gap", gap, at - gap, reason
            gap = None
        for fields in found:
            yield "record", at, end - at, fields
        at = end
    if gap is not None:
        yield "gap", gap, at - gap, reason


def _store(uri: str):
    """A file system and a path in it, for any scheme that pyarrow knows; executors share what is behind it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: null for responses. Only digests of several pages are joined, so that pages move at most once, and
    not at all if such digests are few enough for Spark to broadcast them."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    sized = pages.select("page_id", F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("n")).where(F.col("n") >= min_bytes)
    last = sized.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("pages")).where("pages > 1").select("digest", "last")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("last")), F.col("last"))
    return rows.join(last, "digest", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def _qualified(spark: SparkSession, folder: str) -> str:
    """A folder with its scheme: one without is in the cluster's default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, roll_bytes: int = 32 << 20) -> DataFrame:
    """Write the archives; the manifest of those that count."""
    folder = _qualified(pages.sparkSession, folder)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        part, made, out, size, count, name = TaskContext.get().partitionId(), 0, None, 0, 0, ""

        def close():
            out.close()
            store.move(f"{base}/.{name}", f"{base}/{name}")
            return pd.DataFrame({"path": [f"{folder}/{name}"], "records": [count], "bytes": [size]})

        for pdf in batches:
            for page_id, url, html, refers in zip(pdf["page_id"].astype("Int64"), pdf["url"], pdf["html"], pdf["refers_to"].astype("Int64"), strict=True):
                if out is None:
                    name, size, count = f"part-{part:05d}-{made:04d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, made = store.open_output_stream(f"{base}/.{name}", compression=None), made + 1
                raw = record_bytes(None if pd.isna(page_id) else int(page_id), url, html.encode("utf-8", "replace"), None if pd.isna(refers) else int(refers))
                out.write(raw)
                size, count = size + len(raw), count + 1
                if size >= roll_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return staged(with_roles(pages, min_bytes).mapInPandas(write, MANIFEST), "manifest")


def _read(manifest: DataFrame, gaps: bool) -> DataFrame:
    columns = [c.split()[0] for c in (GAPS if gaps else RECORDS).split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri in pdf["path"]:
                store, path = _store(uri)
                with store.open_input_stream(path, compression=None) as f:
                    data = f.read()
                rows = []
                for kind, start, length, what in salvage(data):
                    if gaps and kind == "gap":
                        rows.append((uri, start, length, what))
                    elif not gaps and kind == "record":
                        rows.append((uri, start, length, *(what[c] for c in columns[3:])))
                    if len(rows) >= 5000:
                        yield _frame(rows, columns)
                        rows = []
                if rows:
                    yield _frame(rows, columns)

    tasks = manifest.select("path").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 2), F.xxhash64("path"))
    return tasks.mapInPandas(read, GAPS if gaps else RECORDS)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    for c in ("page_id", "payload_bytes", "refers_to"):
        if c in out:
            out[c] = out[c].astype("Int64")
    return out


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record that can be read, salvaged ones included."""
    return _read(manifest, gaps=False)


def quarantined(manifest: DataFrame) -> DataFrame:
    """The log of byte ranges that no record could be read from."""
    return _read(manifest, gaps=True)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_archives(pages, fresh_path(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
