import base64
import gzip
import hashlib
import os

import pytest

from lodestone.llm import warc


def make(payload=b"<p>x</p>", uri="http://h.example/a", **fields):
    return warc.record(payload, uri, "00000000-0000-0000-0000-000000000001", {k.replace("_", "-"): v for k, v in fields.items()})


def test_records_are_framed_and_checked():
    big = os.urandom(300_000)
    rows = warc.read_bytes(make(b"") + make(big) + make())
    assert [r["status"] for r in rows] == ["ok"] * 3
    assert [r["payload"] for r in rows] == [b"", big, b"<p>x</p>"]
    assert all(r["block_digest_ok"] and r["payload_digest_ok"] and r["http_status"] == 200 for r in rows)
    assert rows[0]["record_offset"] == 0 and rows[1]["record_offset"] == len(make(b""))


def test_wrong_digests_lengths_and_members():
    plain = gzip.decompress(make())
    assert warc.read_bytes(gzip.compress(plain.replace(b"<p>x", b"<p>y")))[0]["status"] == "bad_block_digest"
    block = plain.split(b"\r\n\r\n", 1)[1][:-4]
    label = b"sha1:" + base64.b32encode(hashlib.sha1(block).digest())
    other = plain.replace(b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:AAAA")
    assert label in plain and warc.read_bytes(gzip.compress(other))[0]["status"] == "bad_payload_digest"
    assert [r["status"] for r in warc.read_bytes(gzip.compress(b"junk\r\n\r\n") + make())] == ["bad_header", "ok"]
    assert [r["status"] for r in warc.read_bytes(make() + make()[:-60])] == ["ok", "truncated"]
    broken = bytearray(make(os.urandom(5000)))
    broken[400:500] = bytes(100)
    got = [r["status"] for r in warc.read_bytes(bytes(broken) + make())]
    assert got[-1] == "ok" and got[0] != "ok"
    assert warc.read_bytes(b"") == []


def test_absent_and_hexadecimal_digests_and_no_gzip():
    body = b"abc"
    head = lambda extra: b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n" + extra + b"\r\n"
    md5 = b"WARC-Block-Digest: md5:" + hashlib.md5(body).hexdigest().encode() + b"\r\n"
    rows = warc.read_bytes(head(b"") + body + b"\r\n\r\n" + head(md5) + body + b"\r\n\r\n")
    assert [(r["status"], r["block_digest_ok"], r["payload"]) for r in rows] == [("ok", None, b"abc"), ("ok", True, b"abc")]
    folded = b"WARC/1.0\r\nWARC-Type: a\r\n  b\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    assert warc.read_bytes(folded)[0]["record_type"] == "a b"


def test_several_records_in_one_member():
    assert [r["status"] for r in warc.read_bytes(gzip.compress(gzip.decompress(make()) * 3))] == ["ok"] * 3


def test_reading_is_incremental():
    class Counting:
        def __init__(self, data):
            self.data, self.at = data, 0

        def read(self, n):
            out = self.data[self.at : self.at + n]
            self.at += len(out)
            return out

    source = Counting(make(os.urandom(200_000)) * 20)
    first = next(warc.read_records(source))
    assert first["status"] == "ok" and source.at < 400_000


def test_round_trip_of_a_table(spark):
    rows = [(1, "http://h.example/a", "<p>é</p>"), (2, None, ""), (3, "http://h.example/b", None), (None, "u", "x"), (1, "http://h.example/a", "<p>é</p>"), (4, "v\r\nX: y", "z" * 1_000_000)]
    df = spark.createDataFrame([(*r, "s", 7) for r in rows], "page_id bigint, url string, html string, status string, payload int")
    got = warc.warc_round_trip(spark, df)
    want = {(i, u if u is None else " ".join(u.splitlines()), h) for i, u, h in rows}
    assert {(r.page_id, r.url, r.html) for r in got.collect()} == want
    assert got.count() == 6 and got.filter("status <> 'ok'").count() == 0
    assert warc.warc_round_trip(spark, df.limit(0)).count() == 0


def test_shards_close_at_their_size(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "x" * 100) for i in range(40)], "page_id bigint, url string, html string").coalesce(1)
    listing = warc.write_warc(df, f"file://{tmp_path}/w", shard_bytes=2000)
    assert listing.count() > 3 and warc.read_warc(listing).count() == 40


@pytest.mark.parametrize("name", ["sha256", "SHA-512"])
def test_other_algorithms(name):
    label = f"{name}:{hashlib.new(name.lower().replace('-', ''), b'x').hexdigest()}"
    assert warc._digest(label, b"x") is True and warc._digest(label, b"y") is False and warc._digest("what:00", b"x") is None


def test_a_small_member_that_inflates_to_a_large_one_is_not_held():
    import tracemalloc
    import zlib

    head = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % (64 << 20)
    z = zlib.compressobj(9, zlib.DEFLATED, 31)
    bomb = z.compress(head) + b"".join(z.compress(bytes(1 << 20)) for _ in range(64)) + z.compress(b"\r\n\r\n") + z.flush()
    good = warc.record(b"x", "http://a/", "00000000-0000-0000-0000-000000000000", {})
    tracemalloc.start()
    rows = warc.read_bytes(good + bomb + good, max_block=1 << 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r["status"] for r in rows] == ["ok", "too_large", "ok"] and peak < 4 << 20
    assert [r["status"] for r in warc.read_bytes(bomb[: len(bomb) // 2], max_block=1 << 20)] == ["truncated"]
    assert len(warc.read_bytes(bomb)[0]["payload"]) == 64 << 20
