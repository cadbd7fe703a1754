"""Hyperdimensional vectors: seeded bit patterns that bind by exclusive or and bundle by majority.

A pattern is an array of ``WORDS`` BIGINTs of 60 bits each. Everything but the projection of dense vectors is a column expression
or an aggregate. Names seed their patterns, so the same name has the same pattern everywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dense
from .ranking import top_k

WORDS, WORD_BITS = 167, 60
BITS = WORDS * WORD_BITS
#: A Python worker keeps so many patterns, or bundles, that it made; it makes or projects at most so many rows at a time.
KEPT, ROWS = 4096, 256


def pattern(name: Column, words: int = WORDS) -> Column:
    """The pattern that a name seeds."""
    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.conv(F.substring(F.md5(F.concat(name, F.lit(":"), i.cast("string"))), 1, 15), 16, 10).cast("bigint"))


def bind(a: Column, b: Column) -> Column:
    """Exclusive or; binding again with the same pattern undoes it."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


unbind = bind


def similarity(a: Column, b: Column) -> Column:
    """1 - share of bits that differ: 1 for the same pattern, about 1/2 for unrelated ones."""
    wrong = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    return 1 - wrong / (F.size(a) * F.lit(float(WORD_BITS)))


def bundle(rows: DataFrame, *by: str, vector: str = "v") -> DataFrame:
    """(by..., v): the bitwise majority of each group's patterns; a bit is set if more than half (rounded down) have it."""
    words = rows.select(*by, F.posexplode(vector).alias("i", "w"))
    bits = [F.sum(F.shiftright("w", b).bitwiseAND(F.lit(1).cast("bigint"))).alias(f"b{b}") for b in range(WORD_BITS)]
    sums = words.groupBy(*by, "i").agg(F.count(F.lit(1)).alias("n"), *bits)
    word = F.lit(0).cast("bigint")
    for b in range(WORD_BITS):
        word = word.bitwiseOR(F.when(F.col(f"b{b}") > F.floor(F.col("n") / 2), F.lit(1 << b)).otherwise(F.lit(0).cast("bigint")))
    return sums.select(*by, "i", word.alias("w")).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda s: s["w"]).alias("v"))


def _seeded(name: str, words: int) -> np.ndarray:
    return np.array([int(hashlib.md5(f"{name}:{i}".encode()).hexdigest()[:15], 16) for i in range(words)], np.int64)


def _majority(patterns: Iterator[np.ndarray], n: int) -> np.ndarray:
    """``bundle`` of ``n`` patterns."""
    at = np.arange(WORD_BITS)
    counts = sum(p[:, None] >> at & 1 for p in patterns)
    return ((counts > n // 2).astype(np.int64) << at).sum(1)


def encode_documents(attributes: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, v) from (doc_id, key, value): the bundle of each key bound with its value; a pair without either doesn't count.

    Only names are brought together: a document's patterns are made and bundled where its pairs are, once for the documents that share them.
    """
    named = attributes.select("doc_id", F.struct(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")).alias("p"))
    # the pairs are far smaller than what is made of them: as many tasks as there are partitions, however few bytes these have
    parts = int(attributes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = named.filter("p.key is not null and p.value is not null").repartition(parts, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("pairs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns: dict[str, np.ndarray] = {}
        bundles: dict[tuple, np.ndarray] = {}

        def of(name: str) -> np.ndarray:
            if name not in patterns:
                if len(patterns) >= KEPT:
                    patterns.clear()
                patterns[name] = _seeded(name, words)
            return patterns[name]

        def bundled(own: tuple) -> np.ndarray:
            if own not in bundles:
                if len(bundles) >= KEPT:
                    bundles.clear()
                bundles[own] = _majority((of(k) ^ of(v) for k, v in own), len(own))
            return bundles[own]

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = np.stack([bundled(tuple((p["key"], p["value"]) for p in own)) for own in part.column(1).to_pylist()])
                offsets = pa.array(np.arange(0, made.size + 1, words), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(made.ravel()))], names=["doc_id", "v"])

    return pairs.mapInArrow(run, f"doc_id {attributes.schema['doc_id'].dataType.simpleString()}, v array<bigint>")


def attribute_search(memory: DataFrame, wanted: DataFrame, known: DataFrame, k: int, words: int = WORDS) -> DataFrame:
    """Documents most like key bound with value, for each (qid, key, value) whose key and value are both in ``known`` (name)."""
    names = known.select("name").distinct()
    w = wanted.join(names.withColumnRenamed("name", "key"), "key", "left_semi").join(names.withColumnRenamed("name", "value"), "value", "left_semi")
    w = w.select("qid", bind(pattern(F.col("key"), words), pattern(F.col("value"), words)).alias("q"))
    return recall(memory, w, k)


def extract_attribute(memory: DataFrame, key: str, known: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, value, score): the known name most like the document unbound from ``key``."""
    open_ = memory.select("doc_id", unbind(F.col("v"), pattern(F.lit(key), words)).alias("u"))
    each = open_.crossJoin(known.select("name").distinct().select("name", pattern(F.col("name"), words).alias("p"))).select("doc_id", "name", similarity(F.col("u"), F.col("p")).alias("score"))
    return each.groupBy("doc_id").agg(F.max_by("name", F.struct("score", F.col("name"))).alias("value"), F.max("score").alias("score"))


def query_pattern(words_of: DataFrame, known: DataFrame, words: int = WORDS) -> DataFrame:
    """(qid, v): exclusive or of the patterns of a query's known words (qid, word) of 3 bytes or more."""
    used = words_of.filter(F.octet_length("word") >= 3).join(known.select(F.col("name").alias("word")).distinct(), "word", "left_semi")
    at = used.select("qid", F.posexplode(pattern(F.col("word"), words)).alias("i", "w"))
    return at.groupBy("qid", "i").agg(F.bit_xor("w").alias("w")).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda s: s["w"]).alias("v"))


def location(path: Column, scope: Column, range_: Column, words: int = WORDS) -> Column:
    return pattern(F.concat_ws("::", path, scope, range_), words)


def build_memory(places: DataFrame, words: int = WORDS) -> DataFrame:
    """(mid, v): the bundle of locations bound with entities, from (mid, path, scope, range, entity)."""
    return bundle(places.select("mid", bind(location(F.col("path"), F.col("scope"), F.col("range"), words), pattern(F.col("entity"), words)).alias("v")), "mid")


def validate(memory: DataFrame, proposals: DataFrame, words: int = WORDS) -> DataFrame:
    """``proposals`` (mid, path, scope, range, entity) with how far the memory agrees as ``score``; 0.5 where there is no memory."""
    m = proposals.join(memory.select("mid", "v"), "mid", "left")
    score = similarity(unbind(F.col("v"), location(F.col("path"), F.col("scope"), F.col("range"), words)), pattern(F.col("entity"), words))
    return m.withColumn("score", F.coalesce(score, F.lit(0.5))).drop("v")


def recall(entities: DataFrame, queries: DataFrame, k: int, threshold: float = 0.0) -> DataFrame:
    """The ``k`` entities (doc_id, v) most like each query (qid, q), of similarity ``threshold`` at least."""
    best = dense.nearest_bits(queries.select("qid", "q"), entities.select("doc_id", "v"), k, lambda words: words * WORD_BITS)
    return top_k(best.filter(F.col("score") >= threshold), k)


def patterns_of(entities: DataFrame) -> DataFrame:
    """(qid, q): the distinct vectors of (doc_id, v), by the smallest id that has them."""
    return entities.groupBy(F.col("v").alias("q")).agg(F.min("doc_id").alias("qid")).select("qid", "q")


def register_entities(memory: DataFrame, entities: DataFrame) -> DataFrame:
    """``memory`` (doc_id, v) with ``entities``, which replace those of the same id; of several with one id the greatest vector."""
    new = entities.groupBy("doc_id").agg(F.max("v").alias("v"))
    return memory.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new.select(memory.columns))


def packed(v: Column) -> Column:
    """A vector's words as 8 bytes each, the highest first: for exchange with other stores."""
    return F.unhex(F.array_join(F.transform(v, lambda w: F.lpad(F.hex(w), 16, "0")), ""))


def unpacked(raw: Column) -> Column:
    """The words of a packed vector."""
    at = F.sequence(F.lit(0), F.floor(F.octet_length(raw) / 8).cast("int") - 1)
    return F.transform(at, lambda i: F.conv(F.hex(F.substring(raw, i * 8 + 1, F.lit(8))), 16, 10).cast("bigint"))


def project(vectors: DataFrame, id_col: str = "doc_id", vector_col: str = "emb", words: int = WORDS, seed: int = 42) -> DataFrame:
    """(doc_id, v): signs of a dense vector's products with seeded Gaussian hyperplanes; like vectors get like patterns."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = None
        for frame in frames:
            if frame.empty:
                continue
            for at in range(0, len(frame), ROWS):  # the products of a row take 80 kB
                part = frame.iloc[at : at + ROWS]
                x = np.stack(part["emb"].to_numpy()).astype(np.float64)
                if planes is None or planes.shape[1] != x.shape[1]:
                    planes = np.random.default_rng(seed).standard_normal((words * WORD_BITS, x.shape[1]))
                bits = (x @ planes.T > 0).reshape(len(x), words, WORD_BITS)
                packed = (bits.astype(np.int64) << np.arange(WORD_BITS)).sum(2)
                yield pd.DataFrame({"doc_id": part["doc_id"], "v": list(packed)})

    return vectors.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(vector_col).alias("emb")).filter("emb is not null").mapInPandas(run, "doc_id bigint, v array<bigint>")
