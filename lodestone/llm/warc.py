"""WARC files: a sequential reader and the writer that feeds it.

A ``.warc.gz`` file holds one gzip member per record. The reader inflates a member as its bytes arrive
(``zlib.decompressobj``, at most ``CHUNK`` bytes more than are asked for, so a small member that inflates to a large one is never held whole before its time), frames the block by ``Content-Length``, checks ``WARC-Block-Digest`` over the block and
``WARC-Payload-Digest`` over the HTTP body behind its header, and starts a new inflater where a member ends. It keeps
the current record and one read buffer, never the file. Files without gzip are framed the same way.

Defined results. ``status`` is ``ok``; ``bad_block_digest`` or ``bad_payload_digest`` if a digest that the record gives
doesn't match (an absent digest is not checked and the flag is null); ``truncated`` if the file ends inside a record;
``bad_header`` if no version line or no valid ``Content-Length`` is there (the rest of that member, or of a file without
gzip, is skipped); ``bad_gzip`` if a member doesn't inflate (the reader goes on at the next gzip magic number). An empty
file has no rows. A null text is written as a record with an empty payload and the header ``X-Null: true`` and read
back as null; repeated rows are records of their own. Rows with a null id or url come back with nulls.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path

CHUNK = 1 << 16
#: The largest block that becomes a row; a column can hold no more than 2 GB.
MAX_BLOCK = 1 << 30
#: A shard is closed once it holds this many compressed bytes.
SHARD_BYTES = 128 << 20
SCHEMA = (
    "file string, record_offset bigint, record_type string, record_id string, target_uri string, warc_date string, content_type string, "
    "content_length bigint, http_status int, block_digest_ok boolean, payload_digest_ok boolean, status string, fields map<string,string>, payload binary"
)
_MAGIC = b"\x1f\x8b\x08"


def _digest(label: str, data: bytes) -> bool | None:
    """Whether ``data`` has the digest ``algorithm:value``, in base32 or hexadecimal; null for an unknown algorithm."""
    name, _, value = label.partition(":")
    try:
        found = hashlib.new(name.strip().lower().replace("-", ""), data).digest()
    except ValueError:
        return None
    value = value.strip()
    return value.lower() == found.hex() or value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


class _Source:
    """Bytes of a file in chunks, with room to put back what an inflater left over."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.back, self.at = raw, b"", 0

    def take(self) -> bytes:
        data, self.back = (self.back, b"") if self.back else (self.raw.read(CHUNK), b"")
        self.at += len(data)
        return data

    def give(self, data: bytes) -> None:
        self.back = data + self.back
        self.at -= len(data)


class _Member:
    """The inflated bytes of one gzip member, or all bytes of a file without gzip."""

    def __init__(self, source: _Source, gzipped: bool):
        self.source, self.z, self.buffer, self.ended, self.broken, self.cut, self.rest = source, zlib.decompressobj(31) if gzipped else None, bytearray(), False, False, False, b""

    def more(self) -> bool:
        if self.ended:
            return False
        data = self.rest or self.source.take()
        self.rest = b""
        if not data:
            self.ended, self.cut = True, self.z is not None
            return False
        if self.z is None:
            self.buffer += data
            return True
        try:
            self.buffer += self.z.decompress(data, CHUNK)
        except zlib.error:
            self.ended = self.broken = True
            self.source.give(data[1:])
            return False
        self.rest = self.z.unconsumed_tail
        if self.z.eof:
            self.ended = True
            self.source.give(self.z.unused_data)
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (i := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark) + 1)
            if not self.more():
                return None
        out = bytes(self.buffer[:i])
        del self.buffer[: i + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.buffer) < n and self.more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def over(self, n: int) -> int:
        """Pass ``n`` bytes over without holding them; how many there were."""
        left = n
        while left:
            if not self.buffer and not self.more():
                break
            own = min(left, len(self.buffer))
            del self.buffer[:own]
            left -= own
        return n - left

    def blank(self) -> None:
        """Skip the empty lines between records."""
        while True:
            while self.buffer[:1] in (b"\r", b"\n") and self.buffer:
                del self.buffer[:1]
            if self.buffer or not self.more():
                return

    def skip(self) -> None:
        self.buffer.clear()
        while self.more():
            self.buffer.clear()
        self.buffer.clear()


def _headers(text: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = ""
    for line in text.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.strip().decode("utf-8", "replace")
        elif b":" in line:
            name, _, value = line.partition(b":")
            last = name.strip().decode("utf-8", "replace").lower()
            out[last] = value.strip().decode("utf-8", "replace")
    return out


def _record(member: _Member, max_block: int) -> dict | None:
    member.blank()
    if not member.buffer:
        return {"status": "bad_gzip"} if member.broken else {"status": "truncated"} if member.cut else None
    head = member.until(b"\r\n\r\n")
    version = (head or b"").split(b"\r\n", 1)[0]
    fields = _headers((head or b"").partition(b"\r\n")[2])
    length = fields.get("content-length", "")
    if head is None or not version.startswith(b"WARC/") or not length.isascii() or not length.isdigit():
        status = "bad_gzip" if member.broken else "truncated" if head is None and (member.cut or member.buffer.startswith(b"WARC/")) else "bad_header"
        member.skip()
        member.cut = False
        return {"status": status, "fields": fields}
    row = {"fields": fields, "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "warc_date": fields.get("warc-date"), "content_type": fields.get("content-type"), "content_length": int(length)}
    if int(length) > max_block:
        whole = member.over(int(length)) == int(length)
        status, member.cut = "too_large" if whole else "bad_gzip" if member.broken else "truncated", member.cut and whole
        return row | {"status": status}
    block = member.exactly(int(length))
    if len(block) < int(length):
        status, member.cut = "bad_gzip" if member.broken else "truncated", False
        return row | {"status": status, "payload": block}
    payload = block
    if fields.get("content-type", "").lower().startswith("application/http"):
        first, _, payload = block.partition(b"\r\n\r\n")
        code = first.split(b" ", 2)[1:2]
        row["http_status"] = int(code[0]) if code and code[0].isdigit() and first.startswith(b"HTTP/") else None
    row["payload"] = payload
    row["block_digest_ok"] = _digest(fields["warc-block-digest"], block) if "warc-block-digest" in fields else None
    row["payload_digest_ok"] = _digest(fields["warc-payload-digest"], payload) if "warc-payload-digest" in fields else None
    row["status"] = "bad_block_digest" if row["block_digest_ok"] is False else "bad_payload_digest" if row["payload_digest_ok"] is False else "ok"
    return row


def read_records(raw: BinaryIO, max_block: int = MAX_BLOCK) -> Iterator[dict]:
    """The records of an open file, in order; ``record_offset`` is where the record's member begins in the file."""
    source = _Source(raw)
    start = source.take()
    source.give(start)
    if not start:
        return
    if not start.startswith(_MAGIC[:2]):
        member = _Member(source, False)
        while (row := _record(member, max_block)) is not None:
            yield row | {"record_offset": None}
        return
    while True:
        data = source.take()
        while (i := data.find(_MAGIC)) < 0:  # after a broken member: on to the next magic number
            more = source.take()
            if not more:
                return
            data = data[-2:] + more
        source.give(data[i:])
        at, member = source.at, _Member(source, True)
        while (row := _record(member, max_block)) is not None:
            yield row | {"record_offset": at}
            if row["status"] in ("bad_gzip", "truncated") and member.ended:
                break
        member.skip()


def _open(path: str) -> BinaryIO:
    where, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if not path.startswith("file:") else "file://" + path[5:])
    return where.open_input_stream(inner, compression=None)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("file", pa.string()), ("record_offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("content_type", pa.string()),
        ("content_length", pa.int64()), ("http_status", pa.int32()), ("block_digest_ok", pa.bool_()), ("payload_digest_ok", pa.bool_()), ("status", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
    ])
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows, held = [], 0
            with _open(path) as raw:
                for row in read_records(raw):
                    rows.append({k: row.get(k) for k in schema.names} | {"file": path, "fields": list(row.get("fields", {}).items())})
                    held += len(row.get("payload") or b"")
                    if held >= 4 << 20 or len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_warc(files: DataFrame) -> DataFrame:
    """Rows of ``SCHEMA`` for a DataFrame whose first column is paths or URIs: a task reads its files one by one."""
    return files.select(files.columns[0]).mapInArrow(_read, SCHEMA)


def record(payload: bytes, uri: str, record_id: str, fields: dict[str, str]) -> bytes:
    """One ``response`` record as a gzip member."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    label = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    head = {"WARC-Type": "response", "WARC-Record-ID": f"<urn:uuid:{record_id}>", "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": uri, "WARC-Block-Digest": label(body), "WARC-Payload-Digest": label(payload), "Content-Type": "application/http; msgtype=response", **fields, "Content-Length": str(len(body))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in head.items()) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(text.encode() + body + b"\r\n\r\n") + z.flush()


def _writer(folder: str, shard_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, inner = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
        where.create_dir(inner, recursive=True)
        out, size, paths = None, 0, []
        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    # a name of its own for each attempt: only files that a finished task returned are read
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    paths.append(f"{folder}/{name}")
                    out, size = where.open_output_stream(f"{inner}/{name}", compression=None), 0
                key, uri, text = (batch.column(c)[i].as_py() for c in range(3))
                fields = ({"X-Key": str(key)} if key is not None else {}) | ({"X-Null": "true"} if text is None else {}) | ({"X-Null-URI": "true"} if uri is None else {})
                seed = hashlib.md5(f"{key}|{uri}".encode()).hexdigest()
                data = record((text or "").encode(), uri or "", str(uuid.UUID(seed)), fields)
                out.write(data)
                size += len(data)
                if size >= shard_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    return write


def write_warc(pages: DataFrame, folder: str, key_col: str = "page_id", url_col: str = "url", body_col: str = "html", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write pages as WARC shards below ``folder``; the result lists the shards and is itself kept beside them.

    A shard belongs to one task; a task that is run again writes other files, and those of the failed one aren't listed.
    """
    rows = pages.select(F.col(key_col).cast("string").alias("k"), F.col(url_col).alias("u"), F.col(body_col).alias("b"))
    rows.mapInArrow(_writer(folder, shard_bytes), "path string").write.parquet(f"{folder}/listing")
    return pages.sparkSession.read.schema("path string").parquet(f"{folder}/listing")


def page_records(records: DataFrame) -> DataFrame:
    """(page_id, url, record_type, http_status, payload_bytes, block_digest_ok, payload_digest_ok, status, html)."""
    f = F.col("fields")
    return records.select(
        f["x-key"].cast("bigint").alias("page_id"),
        F.when(f["x-null-uri"].isNull(), F.col("target_uri")).alias("url"),
        "record_type", "http_status",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        "block_digest_ok", "payload_digest_ok", "status",
        F.when(f["x-null"].isNull(), F.col("payload").cast("string")).alias("html"),
    )


def warc_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages written as WARC shards in the shared folder and read back sequentially."""
    listing = write_warc(pages, scratch_path(spark, "warc"))
    n = max(1, listing.count())
    return page_records(read_warc(listing.repartition(n)))


def read_bytes(data: bytes, max_block: int = MAX_BLOCK) -> list[dict]:
    return list(read_records(io.BytesIO(data), max_block))


