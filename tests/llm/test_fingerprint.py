import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import fingerprint as fp
from lodestone.llm.words import shingle_hashes, word_hashes

from ..conftest import SF

SCHEMA = "doc_id bigint, text string"


def hashes(text, k=5):
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    return set(shingle_hashes(*word_hashes(raw, np.array([0, len(raw)])), k)[0].tolist())


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    texts = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([3, 30, 300, 2000]))) for _ in range(n)]
    for i in range(0, 20, 2):  # parts, wholes and near copies of long ones
        w = texts[i].split()
        texts.append(" ".join(w[len(w) // 4 : len(w) // 2]))
        texts.append("intro words here " + texts[i] + " and more behind it")
        texts.append(texts[i])
    passage = " ".join(f"p{j}" for j in range(600))
    texts += [passage + f" own {i} " + " ".join(f"q{i}x{j}" for j in range(rng.choice([5, 900]))) for i in range(15)]
    return list(enumerate(texts))


def test_words_and_shingles_do_not_depend_on_the_batch():
    texts = ["a b c d e f", "", "Ünï b", "b", "...", "c d e f g h i"]
    raw = "".join(texts).encode()
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    words, first = word_hashes(np.frombuffer(raw, np.uint8), at)
    assert np.diff(first).tolist() == [6, 0, 2, 1, 0, 7]
    shingles, begin = shingle_hashes(words, first, 5)
    assert np.diff(begin).tolist() == [2, 0, 1, 1, 0, 3]
    for i, t in enumerate(texts):
        own = np.frombuffer(t.encode(), np.uint8)
        assert shingle_hashes(*word_hashes(own, np.array([0, len(own)])), 5)[0].tolist() == shingles[begin[i] : begin[i + 1]].tolist()


def test_sketches_keep_all_hashes_below_the_threshold(spark):
    rows = corpus()
    for scale in (1, 4):
        got = {r.id: r for r in fp.sketches(spark.createDataFrame(rows, SCHEMA), scale=scale).collect()}
        for i, t in rows:
            want = sorted(h for h in hashes(t) if h < (1 << 64) // scale)
            assert [h & (1 << 64) - 1 for h in got[i].sketch] == want


def test_merging_equals_the_sketch_of_all(spark):
    rows = corpus()
    table = fp.sketches(spark.createDataFrame(rows, SCHEMA), scale=4).withColumn("g", F.col("id") % 3)
    for r in fp.merge(table, "g").collect():
        want = set().union(*(hashes(t) for i, t in rows if i % 3 == r.g))
        assert r.sketch == sorted(h for h in want if h < 1 << 62)


def brute(rows, scale, threshold, least):
    """(class of each id, hashes of each class, {(a, b): shared})."""
    words, full = {}, {}
    for i, t in rows:
        if i is not None and t is not None:
            words.setdefault(i, set()).add(" ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())))
            full.setdefault(i, set()).update(hashes(t))
    head = {i: min(j for j in words if words[j] == w) if full[i] else i for i, w in words.items()}
    own = {}
    for i in set(head.values()):
        kept = sorted(h for h in full[i] if h <= ((1 << 64) - 1) // scale)
        own[i] = {*kept, *sorted(full[i] - set(kept))[: max(0, least - len(kept))]}
    links = {(a, b): len(x & full[b]) for a, x in own.items() for b in own if a != b and x and len(x & full[b]) >= math.ceil(threshold * len(x))}
    return head, own, links


def agree(rows, out, scale, threshold, least):
    head, own, links = brute(rows, scale, threshold, least)
    got = {r.doc_id: r for r in out}
    assert len(out) == len(got) == len({i for i, _ in rows if i is not None})
    for i, h in head.items():
        mine = {b: n for (a, b), n in links.items() if a == h}
        best = min(mine, key=lambda b: (-mine[b], b), default=None)
        r = got[i]
        assert (r.class_id, r.n_hashes, r.n_containers, r.n_contained, r.container_id) == (h, len(own[h]), len(mine), sum(b == h for _, b in links), best), i
        assert r.containment == (None if best is None else mine[best] / len(own[h]))
    return links


@pytest.mark.parametrize("scale,threshold,least", [(fp.SCALE, fp.THRESHOLD, fp.LEAST), (8, 0.5, 1), (2, 1.0, 3), (1, 0.7, 8)])
def test_all_containments_are_found(spark, scale, threshold, least):
    rows = corpus(scale)
    out = fp.containments(spark.createDataFrame(rows, SCHEMA), scale=scale, threshold=threshold, least=least).collect()
    assert len(agree(rows, out, scale, threshold, least)) > 20


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, "..."), (4, "one two"), (5, long), (5, long), (6, long), (None, long), (7, long.replace(" ", "\n").upper()), (8, "one two"), (8, "three"), (9, "one, two!"), (10, "three"), (11, None), (11, "one two")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("h", F.lit(1)).withColumn("sketch", F.lit("s")).withColumn("n", F.lit(2))
    s = {(r.id, r.n_shingles, None if r.sketch is None else len(r.sketch) > 0) for r in fp.sketches(df).collect()}
    assert {(1, 0, None), (2, 0, False), (3, 0, False)} <= s and (4, 1) in {x[:2] for x in s}
    got = {r.doc_id: tuple(r)[1:] for r in fp.containments(df).collect()}
    assert got[1] == (1, None, 0, 0, None, None) and got[2] == (2, 0, 0, 0, None, None) and got[3][:2] == (3, 0)
    assert {got[i][0] for i in (5, 6, 7)} == {5} and got[5][2] == 0 and got[9][0] == 4 and got[4][2:5] == (1, 0, 8) or got[4][2] >= 1
    assert got[8][1] == 2 and got[10][4] == 8 and got[8][3] >= 2
    assert fp.containments(df.limit(0)).count() == 0 and fp.sketches(df.limit(0)).count() == 0


def test_estimates_are_near_the_truth(spark):
    rng = random.Random(8)
    small = [f"s{rng.random()}" for _ in range(4000)]
    big = small[:3400] + [f"b{i}" for i in range(200_000)]
    df = spark.createDataFrame([(1, " ".join(small)), (2, " ".join(big))], SCHEMA)
    r = fp.containments(df, threshold=0.5).filter("doc_id = 1").first()
    assert r.container_id == 2 and abs(r.containment - 0.85) < 0.12


def test_recall_of_parts_of_every_length(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randint(0, 20000)}" for _ in range(3000)) for _ in range(20)]
    rows = list(enumerate(texts))
    for n in (1, 4, 5, 8, 20, 60, 120, 400, 1500):
        for t in texts:
            at = rng.randrange(3000 - n)
            rows.append((len(rows), " ".join(t.split()[at : at + n])))
    out = {r.doc_id: r for r in fp.containments(spark.createDataFrame(rows, SCHEMA)).collect()}
    # of five words and more every part is found in its whole; shorter ones are one shingle that only equals another
    assert all(out[i].n_containers > 0 and out[i].containment == 1 for i, t in rows[20:] if len(t.split()) >= 5)


def test_all_documents_of_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    agree(rows, fp.containments(spark.createDataFrame(rows, SCHEMA)).collect(), fp.SCALE, fp.THRESHOLD, fp.LEAST)
