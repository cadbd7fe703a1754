import random
import struct

from pyspark.sql import functions as F

from lodestone.llm import mpegts as ts

UNITS = [(bytes([i]) * n, ts.FIRST_PTS + i * 3003, ts.FIRST_PTS + i * 3003 - 1 if i % 2 else None, i % 3 == 0) for i, n in enumerate([0, 1, 100, 161, 162, 163, 170, 171, 184, 5000, 66000])]


def packets(data):
    return [data[i : i + 188] for i in range(0, len(data), 188)]


def test_round_trip_of_all_sizes():
    got = ts.demux(ts.mux(UNITS))
    assert [(u[9], u[4], u[5], u[6]) for u in got] == UNITS
    assert {u[8] for u in got} == {"ok"} and {u[:3] for u in got} == {(1, 0x100, 6)} and [u[3] for u in got] == list(range(len(UNITS)))


def test_stamps_use_all_33_bits():
    for t in (0, 1, (1 << 33) - 1, 0x155555555, 0x0AAAAAAAA):
        assert ts._time(ts._stamp(2, t), 0) == t


def test_crc_and_tables():
    assert ts.crc32(b"123456789") == 0x0376E6E7
    data = bytearray(ts.mux(UNITS))
    data[188 + 20] ^= 1  # the map of the program is broken: no stream is known
    assert ts.demux(bytes(data)) == []


def test_tables_over_several_packets_and_descriptors():
    streams = b"".join(struct.pack(">BHH", 6, 0xE000 | (0x200 + i), 0xF000 | 3) + b"\x01\x01\x00" for i in range(40))
    body = ts._section(2, 1, struct.pack(">HH", 0xE200, 0xF000 | 2) + b"\x09\x00" + streams)
    pmt = b"\x00" + body
    parts = [pmt[i : i + 184] for i in range(0, len(pmt), 184)]
    parts[-1] = parts[-1].ljust(184, b"\xff")
    pat = ts._section(0, 1, struct.pack(">HHHH", 0, 0xE010, 1, 0xE000 | ts.PMT_PID))
    head = ts._packet(0, True, 0, b"\x00" + pat + b"\xff" * (183 - len(pat)))
    tables = head + b"".join(ts._packet(ts.PMT_PID, i == 0, i, p) for i, p in enumerate(parts))
    es = ts.mux([(b"hello", 5, None, True)], 0x227)[376:]
    assert [(u[1], u[9]) for u in ts.demux(tables + es)] == [(0x227, b"hello")]


def test_lost_packets_mark_their_units():
    p = packets(ts.mux(UNITS))
    first = next(i for i, x in enumerate(p) if x[1] & 0x40 and b"\x09" * 50 in x)
    got = ts.demux(b"".join(p[: first + 3] + p[first + 5 :]))
    assert [(u[3], u[7], u[8]) for u in got if u[8] != "ok"] == [(9, 2, "lost_packets")]


def test_lost_start_and_error_indicator():
    p = packets(ts.mux(UNITS))
    starts = [i for i, x in enumerate(p) if i > 1 and x[1] & 0x40]
    got = ts.demux(b"".join(x for i, x in enumerate(p) if i != starts[2]))
    assert {u[9] for u in got}.isdisjoint({UNITS[2][0]}) and [u[8] for u in got].count("lost_packets") == 2
    bad = bytearray(p[starts[2]])
    bad[1] |= 0x80
    marked = ts.demux(b"".join(bytes(bad) if i == starts[2] else x for i, x in enumerate(p)))
    assert marked == got


def test_repeated_packets_and_discontinuity():
    p = packets(ts.mux(UNITS))
    assert ts.demux(b"".join([*p[:6], p[5], *p[6:]])) == ts.demux(b"".join(p))
    jump = ts.mux([(b"b" * 400, 9, None, True)])[376:]
    moved = [bytearray(x) for x in packets(jump)]
    for x in moved:
        x[3] = x[3] & 0xF0 | (x[3] + 9) & 15
    alone = b"".join(p) + b"".join(map(bytes, moved))
    assert "lost_packets" in {u[8] for u in ts.demux(alone)}
    moved[0][5] |= 0x80
    assert {u[8] for u in ts.demux(b"".join(p) + b"".join(map(bytes, moved)))} == {"ok"}


def test_discontinuity_in_a_packet_without_payload():
    p = packets(ts.mux([(b"a" * 400, 9, None, True), (b"b" * 400, 9, None, True)]))
    start = [i for i, x in enumerate(p) if x[1] & 0x40][-1]
    moved = [bytearray(x) for x in p[start:]]
    for x in moved:
        x[3] = x[3] & 0xF0 | (x[3] + 9) & 15
    only = bytes([0x47, 0x01, 0x00, 0x20 | p[start - 1][3] & 15, 183, 0x80]) + b"\xff" * 182
    later = b"".join(map(bytes, moved))
    assert [u[8] for u in ts.demux(b"".join(p[:start]) + later)] == ["lost_packets", "lost_packets"]
    assert [u[8] for u in ts.demux(b"".join(p[:start]) + only + later)] == ["ok", "ok"]


def test_alignment_scrambling_and_bad_packets():
    data = ts.mux(UNITS)
    assert ts.demux(b"\x00\x47junk" + data)[:5] == ts.demux(data)[:5]
    assert ts.demux(data[:1880] + b"xyz" + data[1880:]) == ts.demux(data)
    assert ts.demux(b"no stream")[0][8] == "no_sync"
    p = [bytearray(x) for x in packets(data)]
    p[2][3] |= 0x80
    assert ts.demux(b"".join(map(bytes, p)))[0][8] == "scrambled"
    cut = ts.demux(data[:-188 * 3])
    assert cut[-1][8] in ("ok", "truncated")


def test_truncated_and_bad_header():
    p = packets(ts.mux([(b"q" * 1000, 7, None, False)]))
    assert ts.demux(b"".join(p[:-1]))[0][8] == "truncated"
    p[2] = p[2].replace(b"\x00\x00\x01\xbd", b"\x00\x01\x01\xbd")
    assert ts.demux(b"".join(p))[0][8] == "bad_header"


def test_noise_never_raises():
    rng = random.Random(4)
    data = bytearray(ts.mux(UNITS))
    for _ in range(150):
        noisy = bytearray(data)
        for _ in range(rng.randint(1, 60)):
            noisy[rng.randrange(len(noisy))] = rng.randrange(256)
        ts.demux(bytes(noisy[: rng.randrange(len(noisy))]))


def test_column(spark):
    rows = [(1, "a\nb\n\nc"), (2, None), (3, ""), (None, "é"), (1, "a\nb\n\nc"), (4, "\n".join(str(i) for i in range(3000)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("media", F.lit(1)).withColumn("unit", F.lit("u"))
    out = ts.text_units(df).collect()
    back = {}
    for r in sorted(out, key=lambda r: r.unit):
        assert r.status == "ok" and r.random_access == (r.unit % ts.KEY_EVERY == 0)
        back.setdefault(r.doc_id, []).append(r.line)
    assert back[3] == [""] and back[None] == ["é"] and 2 not in back
    assert back[1] == ["a", "a", "b", "b", "", "", "c", "c"] and len(back[4]) == 3000
    assert ts.text_units(df.limit(0)).count() == 0
    media = spark.createDataFrame([(1, None), (2, bytearray(b""))], "id bigint, media binary")
    assert [(r.id, r.status) for r in ts.access_units(media).collect()] == [(2, "no_sync")]
