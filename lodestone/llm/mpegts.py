"""Media columns: MPEG transport streams (ISO 13818-1) in a binary column, taken apart and put together.

The demultiplexer finds packet alignment, parses the program tables (PAT and PMT, with CRC) for the elementary streams
and their types, follows each stream's continuity counter, reassembles PES packets, and gives one row per access unit
with its 33-bit PTS and DTS and whether it is a random-access point.

Defined results. A null stream gives no rows; one without an aligned packet gives one row of status ``no_sync``. A unit is
``ok``; ``lost_packets`` if the counter jumped within it or just before it (without the discontinuity indicator);
``scrambled``; ``bad_header`` if it doesn't begin as a PES packet; ``truncated`` if fewer bytes came than its length says.
A packet that repeats the one before it (same counter, same bytes) is dropped as the standard allows. Packets with the
error indicator set count as lost. Streams that no valid program table lists are ignored; a table with a wrong CRC is too.
DTS is null where the stream gives only a PTS, and both are null where it gives none. Repeated rows each give their units.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

PACKET = 188
PMT_PID, DATA_PID, PRIVATE_DATA = 0x1000, 0x100, 0x06
CLOCK, FIRST_PTS, UNIT_TICKS, KEY_EVERY = 90_000, 6006, 3003, 8
UNITS = "program int, pid int, stream_type int, unit bigint, pts bigint, dts bigint, random_access boolean, lost_packets int, status string, payload binary"


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else c << 1
        table.append(c)
    return table


_CRC = _crc_table()


def crc32(data: bytes) -> int:
    """CRC-32/MPEG-2, as program tables carry it."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


# ---- multiplexer


def _packet(pid: int, start: bool, counter: int, payload: bytes, flags: int = 0, pcr: int | None = None) -> bytes:
    """One packet; ``payload`` must fit, and what it leaves free is stuffed through the adaptation field."""
    field = b""
    if flags or pcr is not None:
        field = bytes([flags | (0x10 if pcr is not None else 0)])
        if pcr is not None:
            field += struct.pack(">IH", (pcr >> 1) & 0xFFFFFFFF, (pcr & 1) << 15 | 0x7E00)
        field = bytes([len(field)]) + field
    free = 184 - len(payload) - len(field)
    if free:
        if not field:
            field = b"\x00" if free == 1 else bytes([free - 1, 0]) + b"\xff" * (free - 2)
        else:
            field = bytes([field[0] + free]) + field[1:] + b"\xff" * free
    return bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 0xFF, (0x30 if field else 0x10) | counter]) + field + payload


def _section(table: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc32(head + body))


def _tables(pid: int, kind: int) -> bytes:
    pat = _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))
    pmt = _section(2, 1, struct.pack(">HH", 0xE000 | pid, 0xF000) + struct.pack(">BHH", kind, 0xE000 | pid, 0xF000))
    return _packet(0, True, 0, b"\x00" + pat + b"\xff" * (183 - len(pat))) + _packet(PMT_PID, True, 0, b"\x00" + pmt + b"\xff" * (183 - len(pmt)))


_TABLES = _tables(DATA_PID, PRIVATE_DATA)


def _stamp(mark: int, t: int) -> bytes:
    return struct.pack(">BHH", mark << 4 | (t >> 29) & 0xE | 1, (t >> 14) & 0xFFFE | 1, (t << 1) & 0xFFFE | 1)


def mux(units: list[tuple[bytes, int, int | None, bool]], pid: int = DATA_PID) -> bytes:
    """A one-program stream of (payload, pts, dts, random access) units."""
    out, counter = [_TABLES if pid == DATA_PID else _tables(pid, PRIVATE_DATA)], 0
    middle = [bytes([0x47, pid >> 8, pid & 0xFF, 0x10 | c]) for c in range(16)]
    for payload, pts, dts, key in units:
        stamps = _stamp(2, pts) if dts is None else _stamp(3, pts) + _stamp(1, dts)
        size = len(payload) + 3 + len(stamps)
        pes = b"\x00\x00\x01\xbd" + struct.pack(">HBBB", size if size < 65536 else 0, 0x80, 0x80 if dts is None else 0xC0, len(stamps)) + stamps + payload
        room = 176 if key else 184
        out.append(_packet(pid, True, counter, pes[:room], 0x40 if key else 0, (pts if dts is None else dts) if key else None))
        counter = (counter + 1) & 15
        at, n = room, len(pes)
        while n - at >= 184:
            out += (middle[counter], pes[at : at + 184])
            counter = (counter + 1) & 15
            at += 184
        if at < n:
            out.append(_packet(pid, False, counter, pes[at:]))
            counter = (counter + 1) & 15
    return b"".join(out)


# ---- demultiplexer


def _aligned(data: bytes) -> np.ndarray:
    """Packets as rows of 188 bytes; bytes out of alignment are skipped."""
    raw = np.frombuffer(data, np.uint8)
    whole = len(raw) // PACKET * PACKET
    rows = raw[:whole].reshape(-1, PACKET)
    if len(rows) and (rows[:, 0] == 0x47).all():
        return rows
    # a packet counts if another begins right behind it, or if it begins where one ended
    good, at, n, after = [], 0, len(data), -1
    while at + PACKET <= n:
        if data[at] == 0x47 and (at == after or at + PACKET == n or data[at + PACKET] == 0x47):
            good.append(at)
            at = after = at + PACKET
        else:
            at = data.find(b"\x47", at + 1)
            if at < 0:
                break
    return raw[np.add.outer(np.array(good, np.int64), np.arange(PACKET))] if good else raw[:0].reshape(0, PACKET)


def _sections(parts: list[tuple[bool, bytes]]) -> Iterator[bytes]:
    """Sections of one PID with a right CRC, from (start, payload) of its packets."""
    buffer, live = b"", False
    for start, data in parts:
        if start:
            pointer = data[0] if data else 0
            if live:
                buffer += data[1 : 1 + pointer]
                yield from _cut(buffer)[0]
            buffer, live = data[1 + pointer :], True
        elif live:
            buffer += data
        if live:
            found, buffer = _cut(buffer)
            yield from found


def _cut(buffer: bytes) -> tuple[list[bytes], bytes]:
    found = []
    while len(buffer) >= 3 and buffer[0] != 0xFF:
        size = 3 + ((buffer[1] & 0x0F) << 8 | buffer[2])
        if len(buffer) < size:
            return found, buffer
        if size >= 12 and crc32(buffer[:size]) == 0 and buffer[5] & 1:
            found.append(buffer[:size])
        buffer = buffer[size:]
    return found, b"" if buffer[:1] == b"\xff" else buffer


def _time(b: bytes, i: int) -> int:
    return (b[i] & 0x0E) << 29 | b[i + 1] << 22 | (b[i + 2] & 0xFE) << 14 | b[i + 3] << 7 | b[i + 4] >> 1


def _unit(data: bytes) -> tuple[int | None, int | None, str, bytes]:
    if len(data) < 6 or data[:3] != b"\x00\x00\x01":
        return None, None, "bad_header", data
    kind, size = data[3], data[4] << 8 | data[5]
    status = "ok"
    if size:
        status = "ok" if len(data) >= 6 + size else "truncated"
        data = data[: 6 + size]
    if kind in (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF):  # these have no optional header
        return None, None, status, data[6:]
    if len(data) < 9 or data[6] & 0xC0 != 0x80 or len(data) < 9 + data[8]:
        return None, None, "bad_header", data
    flags = data[7] >> 6
    pts = _time(data, 9) if flags & 2 and data[8] >= 5 else None
    dts = _time(data, 14) if flags == 3 and data[8] >= 10 else None
    return pts, dts, status, data[9 + data[8] :]


def demux(data: bytes) -> list[tuple]:
    """(program, pid, stream_type, unit, pts, dts, random_access, lost_packets, status, payload) of a stream's units, by PID and in order."""
    rows = _aligned(data)
    if not len(rows):
        return [(None, None, None, None, None, None, None, None, "no_sync", None)]
    word = rows[:, 1].astype(np.int32) << 8 | rows[:, 2]
    pid, control = word & 0x1FFF, rows[:, 3]
    sound = (word & 0x8000) == 0
    adapted = (control & 0x20) != 0
    length = np.where(adapted, rows[:, 4].astype(np.int32) + 1, 0)
    flags = np.where(adapted & (length > 1), rows[:, 5], 0)
    begin = np.minimum(4 + length, PACKET).tolist()
    has = ((control & 0x10) != 0) & (length <= 184)
    # a discontinuity may be announced by a packet that has an adaptation field only: it counts for the next with a payload
    for p in np.unique(pid[adapted & ~has & sound & ((flags & 0x80) != 0)]):
        own = np.flatnonzero((pid == p) & sound)
        jump = (flags[own] & 0x80) != 0
        full = np.flatnonzero(has[own])
        if len(full):
            before = np.concatenate([np.zeros(1, np.int64), np.cumsum(jump & ~has[own])])
            since = np.diff(np.concatenate([np.zeros(1, np.int64), before[full]])) > 0
            flags[own[full[since]]] |= 0x80
    starts, counters, flag, scrambled = ((word & 0x4000) != 0).tolist(), (control & 15).tolist(), flags.tolist(), ((control & 0xC0) != 0).tolist()
    flat = rows.tobytes()

    def of(which: int) -> list[int]:
        return np.flatnonzero((pid == which) & has & sound).tolist()

    def payload(i: int) -> bytes:
        return flat[i * PACKET + begin[i] : (i + 1) * PACKET]

    programs: dict[int, int] = {}
    for s in _sections([(starts[i], payload(i)) for i in of(0)]):
        if s[0] == 0:
            for k in range(8, len(s) - 4, 4):
                number = s[k] << 8 | s[k + 1]
                if number:
                    programs[(s[k + 2] & 0x1F) << 8 | s[k + 3]] = number
    streams: dict[int, tuple[int, int]] = {}
    for where, number in programs.items():
        for s in _sections([(starts[i], payload(i)) for i in of(where)]):
            if s[0] == 2 and s[3] << 8 | s[4] == number:
                k = 12 + ((s[10] & 0x0F) << 8 | s[11])
                while k + 5 <= len(s) - 4:
                    streams.setdefault((s[k + 1] & 0x1F) << 8 | s[k + 2], (number, s[k]))
                    k += 5 + ((s[k + 3] & 0x0F) << 8 | s[k + 4])
    out: list[tuple] = []
    for which in sorted(streams):
        number, kind = streams[which]
        unit, parts, key, lost, dark, last, before, repeated = 0, None, False, 0, False, -1, -1, False

        def close() -> None:
            nonlocal unit
            pts, dts, status, body = _unit(b"".join(parts))
            out.append((number, which, kind, unit, pts, dts, key, lost, "scrambled" if dark else "lost_packets" if lost else status, body))
            unit += 1

        waiting = 0
        for i in of(which):
            if last >= 0 and not flag[i] & 0x80:
                step = (counters[i] - last) & 15
                if step == 0 and not repeated and flat[i * PACKET : (i + 1) * PACKET] == flat[before * PACKET : (before + 1) * PACKET]:
                    repeated = True
                    continue
                gap = (step - 1) & 15
                if gap:
                    waiting += gap
                    lost += gap if parts is not None else 0
            last, before, repeated = counters[i], i, False
            if starts[i]:
                if parts is not None:
                    close()
                parts, key, lost, dark, waiting = [payload(i)], bool(flag[i] & 0x40), waiting, scrambled[i], 0
            elif parts is not None:
                parts.append(payload(i))
                waiting = 0
        if parts is not None:
            close()
    return out


# ---- columns


def _mux_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        at, media, held = 0, [], 0
        for i in range(batch.num_rows):
            text = texts[i].as_py()
            if text is None:
                media.append(None)
                continue
            units = [(line.encode(), FIRST_PTS + UNIT_TICKS * k, FIRST_PTS + UNIT_TICKS * (k - 1) if k % 2 else None, k % KEY_EVERY == 0) for k, line in enumerate(text.split("\n"))]
            media.append(mux(units))
            held += len(media[-1])
            if held > 2 << 20:
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(media)), pa.array(media, pa.binary())], names=["id", "media"])
                at, media, held = i + 1, [], 0
        yield pa.RecordBatch.from_arrays([ids.slice(at, len(media)), pa.array(media, pa.binary())], names=["id", "media"])


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each text as a transport stream with one timed unit per line, every eighth a random-access point."""
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(_mux_text, "id bigint, media binary")


def _demux_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.binary()]
    names = ["id", *(x.split(" ")[0] for x in UNITS.split(", "))]

    def batch_of(ids: list, rows: list[tuple]) -> pa.RecordBatch:
        columns = [ids, *zip(*rows)] if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    for batch in batches:
        ids, rows, held = [], [], 0
        for i in range(batch.num_rows):
            media = batch.column(1)[i].as_buffer()
            if media is None:
                continue
            units = demux(media.to_pybytes())
            ids += [batch.column(0)[i].as_py()] * len(units)
            rows += units
            held += len(media)
            if held > 2 << 20:
                yield batch_of(ids, rows)
                ids, rows, held = [], [], 0
        yield batch_of(ids, rows)


def access_units(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """(id, program, pid, stream_type, unit, pts, dts, random_access, lost_packets, status, payload) of a media column."""
    return media.select(F.col(id_col).cast("bigint").alias("id"), F.col(media_col).alias("media")).mapInArrow(_demux_column, "id bigint, " + UNITS)


def text_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's text through a media column: written as a table of streams, and these taken apart by unit."""
    media, _ = written(text_media(docs, id_col, text_col), "media")
    return access_units(media).select(
        F.col("id").alias("doc_id"), "program", "pid", "stream_type", "unit", "pts", "dts", "random_access", "lost_packets", "status",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.col("payload").cast("string").alias("line"),
    )
