"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Features are hashed counts of the 1-, 2- and 3-grams of a text's lower-cased letters, with runs of anything else as one
space, weighted by 1 + ln(count) and by inverse document frequency over the whole table, and scaled to unit length. The
weights are learnt by follow-the-regularised-leader with an elastic net (L1 makes them sparse, L2 keeps them small) from a bounded sample
of labelled rows, at most ``TRAIN_PER_LABEL`` a label, those with the lowest hashes of the id and then of the text. A fifth of the sample is held out to fit
the temperature that calibrates the probabilities. Training takes memory by the sample (rows times labels) and the number of buckets only.

Defined results. A null, empty or letterless text has no features: its prediction and confidence are null and it is rejected.
A text whose calibrated confidence is below ``min_confidence`` is rejected too. Ties go to the label that sorts first.
Rows with a null id or label are classified, not learnt from. Rows repeating an id are each classified; of rows repeating id and text one is learnt from. If no row has a label,
or none any letter, nothing is learnt and every row is rejected; with one label all texts with letters get it. Further columns are
ignored by the report and kept by ``accepted``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_bytes

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
#: The bound of the training sample: so many labelled rows of each label.
TRAIN_PER_LABEL = 400
MIN_CONFIDENCE = 0.5
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.5, 4
_SLICE_BYTES, _SLICE_ROWS = 1 << 18, 96
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


@functools.cache
def _fold() -> np.ndarray:
    """The lower case of every letter, of all planes; a space for anything else."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            table[c] = ord(x.lower()[0])
    return table


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the n-grams of some rows of UTF-8 text, by row and bucket."""
    rows = len(offsets) - 1
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    head = (raw & 0xC0) != 0x80
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(head)])[offsets]
    chars = _fold()[points]
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(at))
    blank = chars == 32
    keep = np.ones(len(chars), np.bool_)
    keep[1:] = ~(blank[1:] & blank[:-1] & (row[1:] == row[:-1]))
    chars, row, blank = chars[keep], row[keep], blank[keep]
    codes, owners = [], []
    one = (chars + np.uint32(1)) * _A
    codes.append(((one ^ one >> np.uint32(15)) * _B >> np.uint32(32 - BUCKET_BITS))[~blank])
    owners.append(row[~blank])
    if len(chars) > 1:
        two = one[:-1] * _C + (chars[1:] + np.uint32(2)) * _B
        same = row[1:] == row[:-1]
        codes.append(((two ^ two >> np.uint32(15)) * _C >> np.uint32(32 - BUCKET_BITS))[same])
        owners.append(row[:-1][same])
    if len(chars) > 2:
        three = two[:-1] * _A + (chars[2:] + np.uint32(3)) * _C
        same = row[2:] == row[:-2]
        codes.append(((three ^ three >> np.uint32(15)) * _A >> np.uint32(32 - BUCKET_BITS))[same])
        owners.append(row[:-2][same])
    key = np.concatenate(owners).astype(np.int64) << BUCKET_BITS | np.concatenate(codes)
    letters = np.bincount(row[~blank], minlength=rows) > 0
    counts = np.bincount(key, minlength=rows << BUCKET_BITS)
    found = np.flatnonzero(counts)
    found = found[letters[found >> BUCKET_BITS]]
    return found >> BUCKET_BITS, found & (BUCKETS - 1), counts[found]


def _runs(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + _SLICE_BYTES, side="right")) - 1
        j = min(n, i + _SLICE_ROWS, max(i + 1, j))
        yield i, j
        i = j


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS + 1, np.int64)
    for batch in batches:
        raw, offsets = text_bytes(batch.column(0))
        for i, j in _runs(offsets):
            row, bucket, _ = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            total[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
            total[BUCKETS] += len(np.unique(row))
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "df"])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = text_bytes(batch.column(3))
        for i, j in _runs(offsets):
            row, bucket, count = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            at = np.searchsorted(row, np.arange(j - i + 1))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (bucket, count)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(3)), *lists], names=["label", "h", "t", "bucket", "count"])


@dataclass
class Model:
    """What a row needs to be classified."""

    labels: list[str]
    weights: np.ndarray  # buckets x labels
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def logits(self, row: np.ndarray, bucket: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
        value = (1 + np.log(count)) * self.idf[bucket]
        norm = np.sqrt(np.bincount(row, value * value, rows))
        used = np.abs(self.weights).sum(1)[bucket] > 0
        row, bucket, value = row[used], bucket[used], value[used]
        return np.stack([np.bincount(row, value * self.weights[bucket, c], rows) for c in range(len(self.labels))], 1) / np.maximum(norm, 1e-12)[:, None] + self.bias

    def probabilities(self, row: np.ndarray, bucket: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
        return _softmax(self.logits(row, bucket, count, rows) / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train_ftrl(examples: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, size: int = BUCKETS, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal with per-coordinate rates; the bias is coordinate ``size`` without penalties."""
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))
    l1 = np.array([L1])

    def solve(z: np.ndarray, n: np.ndarray, free: np.ndarray) -> np.ndarray:
        keep = np.where(free[:, None], 0.0, l1)
        w = -(z - np.sign(z) * keep) / ((BETA + np.sqrt(n)) / ALPHA + np.where(free[:, None], 0.0, L2))
        return np.where(np.abs(z) > keep, w, 0.0)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            index, value = examples[i]
            at, x = np.append(index, size), np.append(value, 1.0)
            free = at == size
            w = solve(z[at], n[at], free)
            p = _softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = solve(z, n, np.arange(size + 1) == size)
    return w[:size], w[size]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log likelihood, by golden section over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(_softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-300).mean()

    low, high, r = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = TRAIN_PER_LABEL) -> Model | None:
    """Learn from ``docs``; document frequencies come from all rows, weights from the bounded sample."""
    df = docs.select(F.col(text_col).alias("text")).filter("text is not null").mapInArrow(_document_frequency, "bucket int, df bigint").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    total = np.zeros(BUCKETS + 1, np.int64)
    total[df["bucket"].to_numpy(np.int64)] = df["df"].to_numpy(np.int64)
    idf = np.log((1 + total[BUCKETS]) / (1 + total[:BUCKETS])) + 1
    keyed = docs.select(F.col(label_col).cast("string").alias("label"), F.xxhash64(id_col).alias("h"), F.xxhash64(text_col).alias("t"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("label is not null and id is not null and text is not null")
    lowest = Window.partitionBy("label").orderBy("h", "t")
    ranked = keyed.select("label", "h", "t").distinct().withColumn("rank", F.row_number().over(lowest)).filter(F.col("rank") <= per_label)
    # one row a label
    limits = ranked.groupBy("label").agg(F.max(F.struct("h", "t")).alias("most"))
    sample = keyed.join(F.broadcast(limits), "label").filter(F.struct("h", "t") <= F.col("most")).dropDuplicates(["label", "h", "t"]).select("label", "h", "t", "text")
    rows = sample.mapInArrow(_examples, "label string, h bigint, t bigint, bucket array<int>, count array<int>").toPandas()
    rows = rows[rows["bucket"].map(len) > 0].sort_values(["label", "h", "t"], kind="stable")
    if rows.empty:
        return None
    labels = sorted(rows["label"].unique())
    y = rows["label"].map({x: i for i, x in enumerate(labels)}).to_numpy()
    examples = []
    for bucket, count in zip(rows["bucket"], rows["count"]):
        bucket = np.asarray(bucket, np.int64)
        value = (1 + np.log(np.asarray(count, np.float64))) * idf[bucket]
        examples.append((bucket, value / np.sqrt((value * value).sum())))
    held = np.arange(len(y)) % 5 == 4
    chosen = np.flatnonzero(~held)
    weights, bias = train_ftrl([examples[i] for i in chosen], y[chosen], len(labels))
    model = Model(list(labels), weights, bias, idf)
    if held.any():
        logits = np.stack([examples[i][1] @ weights[examples[i][0]] + bias for i in np.flatnonzero(held)])
        model.temperature = fit_temperature(logits, y[held])
    return model


def predict(model: Model | None, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Index of the label (-1: none) and its calibrated probability, for each row of a string column."""
    raw, offsets = text_bytes(column)
    best, sure = np.full(len(column), -1), np.zeros(len(column))
    if model is not None:
        for i, j in _runs(offsets):
            row, bucket, count = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            p = model.probabilities(row, bucket, count, j - i)
            has = np.bincount(row, minlength=j - i) > 0
            best[i:j] = np.where(has, p.argmax(1), -1)
            sure[i:j] = np.where(has, p.max(1), 0.0)
    return best, sure


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", min_confidence: float = MIN_CONFIDENCE, per_label: int = TRAIN_PER_LABEL) -> DataFrame:
    """(doc_id, lang, predicted, confidence, accepted) for every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(docs, id_col, text_col, label_col, per_label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            best, sure = predict(model, batch.column(2))
            none = best < 0
            names = pa.array([None if b < 0 else model.labels[b] for b in best], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), names, pa.array(np.round(sure, 6), mask=none), pa.array(~none & (sure >= min_confidence))], names=["doc_id", "lang", "predicted", "confidence", "accepted"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, lang string, predicted string, confidence double, accepted boolean")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", min_confidence: float = MIN_CONFIDENCE, per_label: int = TRAIN_PER_LABEL) -> DataFrame:
    """``docs`` without the rows that language identification rejects."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, label_col, per_label))
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, sure = predict(shared.value, batch.column(where))
            yield batch.filter(pa.array((best >= 0) & (sure >= min_confidence)))

    return docs.mapInArrow(run, docs.schema)
