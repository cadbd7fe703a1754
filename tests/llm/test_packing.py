import itertools
import random

from pyspark.sql import functions as F

from lodestone.llm import packing

SCHEMA = "doc_id bigint, text string"


def best_sum(sizes, capacity):
    reach = {0}
    for s in sizes:
        reach |= {r + s for r in reach if r + s <= capacity}
    return max(reach)


def test_every_bin_is_the_fullest_that_was_possible():
    rng = random.Random(1)
    for capacity in (7, 20, 64):
        for n in (0, 1, 2, 9, 40):
            sizes = [rng.randint(1, capacity) for _ in range(n)]
            left = sizes.copy()
            bins = packing.pack_lengths(sizes, capacity)
            assert sorted(itertools.chain.from_iterable(bins)) == list(range(n))
            for own in bins:
                total = sum(sizes[i] for i in own)
                assert total == best_sum(left, capacity)
                for i in own:
                    left.remove(sizes[i])


def test_ties_and_repeated_lengths():
    assert packing.pack_lengths([5] * 6, 10) == [[0, 1], [2, 3], [4, 5]]
    assert packing.pack_lengths([10, 10], 10) == [[0], [1]]
    assert [sorted(b) for b in packing.pack_lengths([6, 4, 5, 5], 10)] == [[2, 3], [0, 1]]


def words(n):
    return " ".join(["w"] * n)


def test_table(spark):
    rows = [(1, words(9)), (2, words(39)), (3, None), (4, ""), (5, words(4)), (5, words(4)), (None, words(3)), (6, words(19)), (7, words(20)), (8, "  a\tb\n")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("length", F.lit("x")).withColumn("part", F.lit(0.5)).withColumn("id", F.lit(3))
    out = [r.asDict() for r in packing.pack(df, capacity=20).collect()]
    by_bin = {}
    for r in out:
        by_bin.setdefault(r["bin_id"], []).append(r)
    for own in by_bin.values():
        assert sum(r["length"] for r in own) == own[0]["bin_fill"] <= 20 and sorted(r["slot"] for r in own) == list(range(len(own)))
    total = {}
    for r in out:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {1: 10, 2: 40, 3: 1, 4: 1, 5: 10, None: 4, 6: 20, 7: 21, 8: 3}
    assert sorted((r["piece"], r["start"], r["length"]) for r in out if r["doc_id"] == 2) == [(0, 0, 20), (1, 20, 20)]
    assert sorted((r["piece"], r["start"], r["length"]) for r in out if r["doc_id"] == 7) == [(0, 0, 20), (1, 20, 1)]


def test_empty_table_and_several_groups(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
    rng = random.Random(5)
    df = spark.createDataFrame([(i, words(rng.randint(0, 60))) for i in range(500)], SCHEMA)
    out = packing.pack(df, capacity=64, group_docs=100)
    assert out.select("doc_id").distinct().count() == 500
    fills = [r.bin_fill for r in out.select("bin_id", "bin_fill").distinct().collect()]
    assert sum(fills) / (64 * len(fills)) > 0.92
    assert sorted(map(tuple, packing.pack(df, capacity=64, group_docs=100).collect())) == sorted(map(tuple, out.collect()))


def test_a_very_long_text(spark):
    df = spark.createDataFrame([(1, words(100_000))], SCHEMA)
    out = packing.pack(df)
    assert out.count() == 49 and out.agg(F.sum("length")).first()[0] == 100_001


def test_null_and_repeated_ids_do_not_make_one_group(spark):
    df = spark.createDataFrame([(None if i % 2 else 7, words(9)) for i in range(1000)], SCHEMA)
    out = packing.pack(df, capacity=64, group_docs=100)
    sizes = {}
    for r in out.collect():
        sizes[r.bin_id >> 32] = sizes.get(r.bin_id >> 32, 0) + 1
    assert len(sizes) == 10 and sum(sizes.values()) == 1000 and max(sizes.values()) < 150
