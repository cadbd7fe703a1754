import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import minhash as mh

SCHEMA = "doc_id bigint, text string"


def distance(a, b):
    return sum(x != y for p, q in zip(a, b) for x, y in zip(int(p).to_bytes(6, "little"), int(q).to_bytes(6, "little")))


def random_signatures(rng, n):
    base = [[rng.randrange(1 << 48) for _ in range(8)] for _ in range(n)]
    out = [tuple(b) for b in base]
    for b in base:
        for wrong in range(0, 20):
            own = [bytearray(x.to_bytes(6, "little")) for x in b]
            for at in rng.sample(range(48), wrong):
                own[at // 6][at % 6] ^= rng.randint(1, 255)
            out.append(tuple(int.from_bytes(x, "little") for x in own))
    # the worst cases: two errors in all chunks but one, which has one; and errors in one place of every chunk
    for b in base:
        for places in ([(c, p) for c in range(8) for p in ((0, 5) if c else (3,))], [(c, 2) for c in range(8)], [(c, p) for c in range(7) for p in (1, 4)]):
            own = [bytearray(x.to_bytes(6, "little")) for x in b]
            for c, p in places:
                own[c][p] ^= 1
            out.append(tuple(int.from_bytes(x, "little") for x in own))
    return [*dict.fromkeys(out)]


@pytest.mark.parametrize("most", [mh.MAX_DISTANCE, 6, 0])
def test_all_pairs_within_the_distance_once(spark, most):
    sigs = random_signatures(random.Random(most), 6)
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(sigs)], "id bigint, " + ", ".join(f"s{c} bigint" for c in range(8)))
    got = [(r.a, r.b, r.distance) for r in mh.distinct_pairs(df, most).collect()]
    want = {(i, j, d) for i in range(len(sigs)) for j in range(i + 1, len(sigs)) if (d := distance(sigs[i], sigs[j])) <= most}
    assert len(got) == len(set(got)) and set(got) == want
    assert most == 0 or len(want) > 50


def test_distances_beyond_the_guarantee_are_refused(spark):
    with pytest.raises(ValueError, match="guarantees"):
        mh.distinct_pairs(None, mh.MAX_DISTANCE + 1)


def test_signatures_estimate_similarity():
    rng = random.Random(2)
    for share in (0.5, 0.8, 0.95):
        agree = []
        for _ in range(30):
            common = [f"c{rng.random()}" for _ in range(int(400 * share))]
            docs = ["|".join(f"{w} {w}x." for w in common + [f"o{rng.random()}" for _ in range(400 - len(common))]) for _ in range(2)]
            raw = [np.frombuffer(d.encode(), np.uint8) for d in docs]
            s = [mh.signatures(r, np.array([0, len(r)]), 1)[0][0] for r in raw]
            agree.append(1 - distance(s[0], s[1]) / 48)
        words = share / (2 - share)
        assert abs(np.mean(agree) - words) < 0.08


def edited(rng, words, n):
    out = words.copy()
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**6)}"
    return out


def corpus(rng):
    rows, groups = [], []
    for g in range(40):
        words = [f"v{rng.randrange(3000)}" for _ in range(rng.choice([120, 400, 1500]))]
        own = [" ".join(words), " ".join(words).upper(), ", ".join(words)]
        own += [" ".join(edited(rng, words, len(words) // 50)) for _ in range(rng.randrange(5))]
        groups.append(list(range(len(rows), len(rows) + len(own))))
        rows += own
    singles = [" ".join(f"v{rng.randrange(3000)}" for _ in range(300)) for _ in range(80)]
    return [*enumerate(rows + singles)], groups


def test_groups_of_copies_and_clean_documents(spark):
    rows, groups = corpus(random.Random(6))
    df = spark.createDataFrame(rows, SCHEMA)
    found = mh.near_duplicates(df).collect()
    group = {r.doc_id: r.group_id for r in found}
    assert len(found) == len(group) == len(rows)
    for own in groups:
        assert {group[i] for i in own} == {own[0]}
    assert {i for i, g in group.items() if i != g} == {i for own in groups for i in own[1:]}
    sig = {r.id: tuple(r)[1:] for r in mh.signature_table(df).collect()}
    assert {r.doc_id: r.n_links for r in found} == {a: sum(distance(sig[a], sig[b]) <= mh.MAX_DISTANCE for b in sig) - 1 for a in sig}
    kept = {r.doc_id for r in mh.keep_one(df).collect()}
    assert kept == {i for i, _ in rows} - {i for own in groups for i in own[1:]}


def test_pairs_against_brute_force_on_signatures(spark):
    rows, _ = corpus(random.Random(3))
    df = spark.createDataFrame(rows, SCHEMA)
    sig = {r.id: tuple(r)[1:] for r in mh.signature_table(df).collect()}
    want = {(a, b) for a in sig for b in sig if a < b and distance(sig[a], sig[b]) <= mh.MAX_DISTANCE}
    head = {}
    for i in sorted(sig):
        head.setdefault(sig[i], i)
    got = {(r.a, r.b): r.distance for r in mh.near_pairs(df).collect()}
    top = lambda i: head[sig[i]]
    assert {tuple(sorted((top(a), top(b)))) for a, b in want if top(a) != top(b)} == {p for p, d in got.items() if d}
    assert {p for p, d in got.items() if not d} == {(top(i), i) for i in sig if top(i) != i}


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + i, 100) for i in range(1, 20)] + [(7, 300), (500, 501), (501, 500)]
    got = {r.id: r.group_id for r in mh.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {i: g for i, g in got.items() if g == 0} == dict.fromkeys([*range(41), 300], 0)
    assert got[119] == 100 and got[501] == 500
    assert mh.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(1, None), (2, None), (3, ""), (4, ""), (5, "!!"), (6, "!!"), (7, text), (7, text), (None, text), (8, text), (9, "word"), (10, "Word!"), (11, text * 300), (12, text * 300)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("x")).withColumn("a", F.lit(1)).withColumn("s0", F.lit(2)).withColumn("key", F.lit(3))
    got = {r.doc_id: (r.group_id, r.n_links) for r in mh.near_duplicates(df).collect()}
    assert got == {**{i: (i, 0) for i in range(1, 7)}, 9: (9, 1), 10: (9, 1), **dict.fromkeys([7, 8, 11, 12], (7, 3))}
    kept = mh.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 6, 7, 9] and ids.count(None) == 1
    more = df.union(df).union(df.filter("doc_id is null").withColumn("text", F.lit("other")))
    ids = [r.doc_id for r in mh.keep_one(more).collect()]
    assert sorted(i for i in ids if i is not None) == [1, 1, 2, 2, 3, 4, 5, 6, 7, 9] and ids.count(None) == 2
    assert mh.near_duplicates(df.limit(0)).count() == 0 and mh.keep_one(df.limit(0)).count() == 0


def crowd(rng, n):
    """Near copies of one text that nearly all differ."""
    words = [f"v{i}" for i in range(400)]
    return [" ".join(edited(rng, words, 12)) for _ in range(n)]


def rows_of_tables(monkeypatch):
    seen, own = [], mh.written

    def counted(df, name):
        table, path = own(df, name)
        seen.append(table.count())
        return table, path

    monkeypatch.setattr(mh, "written", counted)
    return seen


def test_links_of_a_crowd_without_a_row_a_pair(spark, monkeypatch):
    texts = crowd(random.Random(4), 400)
    rows = [*enumerate(texts + texts[:40], 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    sig = {r.id: tuple(r)[1:] for r in mh.signature_table(df).collect()}
    ids = sorted(sig)
    symbols = np.array([sig[i] for i in ids]).view(np.uint8).reshape(len(ids), 8, 8)[:, :, :6].reshape(len(ids), 48)
    near = (symbols[:, None] != symbols[None]).sum(2) <= mh.MAX_DISTANCE
    assert len(set(sig.values())) > 300 and near.sum() > 150_000
    seen = rows_of_tables(monkeypatch)
    got = {r.doc_id: (r.group_id, r.n_links) for r in mh.near_duplicates(df).collect()}
    assert got == {i: (5, int(n) - 1) for i, n in zip(ids, near.sum(1))}
    assert max(seen) <= (mh.CHUNKS + mh.SYMBOLS) * len(rows)


@pytest.mark.parametrize("number", [0, 5, mh.CHUNKS + 13])
def test_listed_pairs_and_blocks_of_a_key_against_a_loop(number):
    rng = random.Random(number)
    base = bytes(rng.randrange(256) for _ in range(48))
    places = [*range(number * 6, number * 6 + 6)] if number < mh.CHUNKS else [x for x in range(12, 18) if x != number - mh.CHUNKS]
    sigs = []
    for _ in range(150):
        own = bytearray(base)
        for at in rng.sample(range(48), rng.randrange(24)):
            own[at] = rng.choice((own[at], own[at] ^ 1, rng.randrange(256)))
        for at in places:
            own[at] = base[at]
        sigs.append(bytes(own))
    columns = {f"s{c}": [int.from_bytes(s[6 * c : 6 * c + 6], "little") for s in sigs] for c in range(8)}
    ids, n = [i // 2 for i in range(150)], [rng.randint(1, 4) for _ in sigs]
    table = pa.table({"key": [number << 48] * 150, "h": [*range(150)], "id": ids, "n": n, **columns})
    want = {}
    for i in range(150):
        for j in range(i):
            wrong = [sum(x != y for x, y in zip(sigs[i][k : k + 6], sigs[j][k : k + 6])) for k in range(0, 48, 6)]
            kind = [c for c in range(8) if wrong[c] == 0]
            first = kind[0] if kind else next((mh.CHUNKS + 6 * c + next(p for p in range(6) if sigs[i][6 * c + p] != sigs[j][6 * c + p]) for c in range(8) if wrong[c] == 1), -1)
            if sum(wrong) <= mh.MAX_DISTANCE and first == number and ids[i] != ids[j]:
                want[j, i] = sum(wrong)
    assert len(want) > 50
    links = [sum(n[sum(p) - i] for p in want if i in p) for i in range(150)]
    for listed in (1, 1000):
        got = sorted(r for b in mh.pairs_met(table, mh.MAX_DISTANCE, listed) for r in zip(*b.to_pydict().values()))
        assert got == sorted((ids[j], ids[i], d) for (j, i), d in want.items())
        found = mh.links_met(table, mh.MAX_DISTANCE, listed).to_pydict()
        assert dict(zip(found["h"], found["links"])) == {i: x for i, x in enumerate(links) if x}
        groups = dict(zip(found["h"], found["root"]))
        assert all(groups[i] == groups[j] for i, j in want) and all(root <= ids[h] for h, root in groups.items())


def test_links_of_an_id_with_several_texts(spark):
    rng = random.Random(9)
    one, two = ([f"{w}{i}" for i in range(300)] for w in "ab")
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, " ".join(one)), (3, " ".join(edited(rng, two, 3)))]
    got = {tuple(r) for r in mh.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 1, 2), (2, 1, 1), (3, 1, 1)}


def test_one_of_a_crowd_stays_without_a_row_a_pair(spark, monkeypatch):
    rng = random.Random(8)
    rows = [*enumerate(crowd(rng, 400), 7)] + [(1000, "something else"), (None, "no id")]
    df = spark.createDataFrame(rows, SCHEMA)
    seen = rows_of_tables(monkeypatch)
    assert {r.doc_id for r in mh.keep_one(df).collect()} == {7, 1000, None}
    assert max(seen) <= (mh.CHUNKS + mh.SYMBOLS) * len(rows)


def test_keys_are_made_and_moved_once(spark):
    sigs = random_signatures(random.Random(5), 2)
    df = spark.createDataFrame([(i, i, 1, *s) for i, s in enumerate(sigs)], "h bigint, id bigint, n bigint, " + ", ".join(f"s{c} bigint" for c in range(8)))
    buckets = mh._buckets(df, mh.MAX_DISTANCE)
    plan = buckets._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1
    keys = {}
    for r in buckets.collect():
        keys.setdefault(r.key, []).append(r.h)
    assert keys and all(len(own) > 1 and len(own) == len(set(own)) for own in keys.values())
