import heapq
import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import sharding

SCHEMA = "doc_id bigint, text string"


def plain(sizes, k):
    """Differencing with tuples of (sum, members)."""
    heap = []
    for i, s in enumerate(sizes):
        parts = [(s, [i]), *((0, []) for _ in range(k - 1))]
        heap.append((-s if k > 1 else 0, i, parts))
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        a, b = sorted(a, key=lambda p: -p[0]), sorted(b, key=lambda p: p[0])
        c = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, b)]
        heapq.heappush(heap, (min(p[0] for p in c) - max(p[0] for p in c), n, c))
        n += 1
    return sorted(p[0] for p in heap[0][2])


def test_same_sums_as_a_plain_version():
    rng = random.Random(3)
    for k in (2, 3, 8):
        for n in (1, 2, 5, 60):
            sizes = [rng.randint(0, 1000) for _ in range(n)]
            leaves = [np.array([s] + [0] * (k - 1)) for s in sizes]
            sums, slots = sharding.difference(leaves)
            assert sorted(sums.tolist()) == plain(sizes, k)
            got = [0] * k
            for s, own in zip(sizes, slots):
                got[own[0]] += s
                assert sorted(own.tolist()) == list(range(k))
            assert got == sums.tolist()


def test_known_case():
    sums, _ = sharding.difference([np.array([s, 0]) for s in (8, 7, 6, 5, 4)])
    assert sorted(sums.tolist()) == [14, 16]


def test_table(spark):
    rng = random.Random(9)
    rows = [(i, f"{i} " + "x" * rng.randint(0, 3000)) for i in range(600)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(50)] + [(2000, None), (2001, None), (2002, ""), (None, "y"), (5, rows[5][1]), (3000, "z" * 40_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit(1)).withColumn("shard", F.lit("a")).withColumn("size", F.lit(2)).withColumn("group_key", F.lit(3))
    for fan_in in (10_000, 40):
        out = sharding.shard(df, shards=8, fan_in=fan_in)
        got = out.collect()
        assert len(got) == len(rows) and {r.shard for r in got} == set(range(8))
        where = {}
        for r in got:
            assert where.setdefault(r.group_key, r.shard) == r.shard
        sums = [0] * 8
        for r in got:
            sums[r.shard] += r.n_bytes
        assert sum(sums) == sum(len((t or "").encode()) for _, t in rows)
        assert max(sums) - min(sums) <= 0.02 * max(sums)
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)


def test_given_keys_and_empty_table(spark):
    df = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(30)], SCHEMA)
    out = sharding.shard(df, key=F.col("doc_id") % 5, shards=4)
    assert out.groupBy("group_key").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() == 0
    assert sharding.shard(df.limit(0)).count() == 0
    assert sharding.shard(df.limit(1), shards=1).first().shard == 0


def test_beyond_the_fan_in_the_spread_stays_near_plain_differencing(spark):
    rng = np.random.default_rng(5)
    sizes = np.maximum(1, rng.lognormal(7, 1.2, 6000)).astype(int)
    groups = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "id bigint, size bigint")
    spread = {}
    for fan_in in (10_000, 500):
        got = sharding.assign(groups, 16, fan_in).collect()
        assert sorted(r.id for r in got) == list(range(6000))
        sums = np.bincount([r.shard for r in got], sizes[[r.id for r in got]], 16)
        spread[fan_in] = sums.max() - sums.min()
    plain_sums = plain(sizes.tolist(), 16)
    assert spread[10_000] == plain_sums[-1] - plain_sums[0]
    # the nodes' last differences of few bytes add up: 12 nodes here
    assert spread[500] <= 0.0005 * sizes.sum() / 16
