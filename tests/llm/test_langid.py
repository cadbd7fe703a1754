import math

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import langid

from ..conftest import SF

SCHEMA = "doc_id bigint, text string, lang string"


def test_features_against_a_loop():
    texts = ["Été, été!", "", "12 34", "a", "日本 X", "😀🎉 🚀", "𝒜 𐐀b"]
    raw = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    row, bucket, count = langid.features(np.frombuffer(raw, np.uint8), offsets)
    for i, t in enumerate(texts):
        alone = langid.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        assert sorted(zip(bucket[row == i], count[row == i])) == sorted(zip(alone[1], alone[2]))
    assert not any((row == i).any() for i in (1, 2, 5)) and (row == 6).any()
    # "été été ": letters as 1-grams, and all 2- and 3-grams
    assert count[row == 0].sum() == 6 + 7 + 6


def test_held_out_accuracy_and_calibration(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    train, test = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    model = langid.fit(train)
    rows = test.select("text", "lang").toArrow()
    best, sure = langid.predict(model, rows.column("text").combine_chunks())
    right = np.array([b >= 0 and model.labels[b] == want for b, want in zip(best, rows.column("lang").to_pylist())])
    assert right.mean() > 0.97
    assert sure[right].mean() > 0.9 and model.temperature > 0
    used = np.abs(model.weights).sum(1) > 0
    assert 0 < used.mean() < 0.5  # the first norm leaves most weights at zero


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 300)
    logits = rng.normal(size=(300, 3)) + 1.5 * np.eye(3)[y]
    t = langid.fit_temperature(logits * 8, y)
    loss = lambda x: -np.log(langid._softmax(x)[np.arange(300), y]).mean()
    assert loss(logits * 8 / t) < loss(logits * 8) and 2 < t < 20


def test_odd_rows(spark):
    base = [(i, t, lang) for i in range(30) for t, lang in ((f"the and with of {i} them", "en"), (f"der und die mit von {i}", "de"))]
    odd = [(900, None, "en"), (901, "", "en"), (902, "12 34 !!", None), (903, "und die der mit", None), (None, "the with them", "en"), (904, "the and of " * 20000, "en"), (903, "und die der mit", None)]
    df = spark.createDataFrame(base + odd, SCHEMA).withColumn("confidence", F.lit(1)).withColumn("bucket", F.lit("x"))
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    for i in (900, 901, 902):
        assert got[i].predicted is None and got[i].confidence is None and got[i].accepted is False
    assert got[903].predicted == "de" and got[None].predicted == "en" and got[904].predicted == "en"
    assert all(0.25 <= r.confidence <= 1 for r in got.values() if r.confidence is not None)
    kept = langid.accepted(df)
    assert kept.columns == df.columns and kept.count() == len(base) + len(odd) - 3


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.identify(empty).count() == 0 and langid.accepted(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "the", None)], SCHEMA)
    assert langid.identify(unlabelled).first().accepted is False
    one = spark.createDataFrame([(1, "the", "en"), (2, "of", "en")], SCHEMA)
    assert {r.predicted for r in langid.identify(one).collect()} == {"en"}


def plain_ftrl(examples, y, classes, size, epochs, seed):
    """FTRL-proximal one coordinate at a time, as published."""
    z = [[0.0] * classes for _ in range(size + 1)]
    n = [[0.0] * classes for _ in range(size + 1)]

    def weight(i, c):
        l1, l2 = (0.0, 0.0) if i == size else (langid.L1, langid.L2)
        if abs(z[i][c]) <= l1:
            return 0.0
        return -(z[i][c] - math.copysign(l1, z[i][c])) / ((langid.BETA + math.sqrt(n[i][c])) / langid.ALPHA + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for e in order.permutation(len(examples)):
            x = [*zip(examples[e][0].tolist(), examples[e][1].tolist()), (size, 1.0)]
            w = {(i, c): weight(i, c) for i, _ in x for c in range(classes)}
            scores = [sum(w[i, c] * v for i, v in x) for c in range(classes)]
            p = [math.exp(s - max(scores)) for s in scores]
            for c in range(classes):
                for i, v in x:
                    g = v * (p[c] / sum(p) - (c == y[e]))
                    sigma = (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / langid.ALPHA
                    z[i][c] += g - sigma * w[i, c]
                    n[i][c] += g * g
    return [[weight(i, c) for c in range(classes)] for i in range(size + 1)]


def test_training_against_a_plain_version_and_its_objective():
    rng = np.random.default_rng(3)
    size, classes = 40, 3
    y = rng.integers(0, classes, 60)
    examples = []
    for c in y:
        index = np.unique(np.append(rng.integers(0, size, 6), [c, c + 3]))
        value = rng.random(len(index))
        examples.append((index, value / np.sqrt((value * value).sum())))
    weights, bias = langid.train_ftrl(examples, y, classes, size, 5, 11)
    want = np.array(plain_ftrl(examples, y, classes, size, 5, 11))
    assert np.allclose(weights, want[:-1]) and np.allclose(bias, want[-1])
    loss = lambda w, b: -sum(np.log(langid._softmax(v @ w[i] + b)[c]) for (i, v), c in zip(examples, y))
    assert loss(weights, bias) < 0.7 * loss(weights * 0, bias * 0)
    assert (weights == 0).any()


def test_the_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    seen = []
    real = langid.train_ftrl
    monkeypatch.setattr(langid, "train_ftrl", lambda examples, y, *a: seen.append(np.bincount(y).max() / 0.8) or real(examples, y, *a))
    rows = [(1, f"the and {i}x", "en") for i in range(300)] + [(i, "der und", "de") for i in range(300)] + [(5, "le la", "fr")] * 300
    langid.fit(spark.createDataFrame(rows, SCHEMA), per_label=50)
    assert seen and seen[0] <= 51
