"""Dense and binary vector retrieval.

A stated set of queries is held against all vectors in blocks: a block of queries, bounded in bytes, is a matrix that every task
has, each Arrow batch of vectors is multiplied by it at once, and a task gives its best rows of each query only. Queries beyond a
block take further passes over the vectors. Where only given pairs are asked for, vectors are joined to those pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import vector as vx
from ..sources.tables import written
from .ranking import DIGITS, top_k

#: A block of queries has at most this many bytes of vectors; a product has at most so many cells.
BLOCK_BYTES, CELLS = 8 << 20, 1 << 22
#: So many values are sorted to find the median among them; of more a finer histogram is made first.
SORTED = 100_000


def corpus_mean(vectors: DataFrame) -> DataFrame:
    """(dim, mean): the mean of every dimension of (emb)."""
    return vectors.select(F.posexplode("emb").alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def mean_vector(vectors: DataFrame) -> DataFrame:
    """One row (mean): the corpus mean as an array, as long as a vector."""
    return corpus_mean(vectors).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("mean"))


def dynamic_scale(vectors: DataFrame, mean: DataFrame) -> DataFrame:
    """One row (scale): twice the upper median deviation from the mean, within 0.05 and 0.5; 0.2 for no vectors.

    Values are counted in 4096 cells; the median's cell is cut into as many again until few values, or one value, are left in it.
    """
    dev = vectors.crossJoin(F.broadcast(mean)).select(F.explode(F.zip_with("emb", "mean", lambda x, m: F.abs(x.cast("double") - m))).alias("d"))
    all_ = dev.agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).first()
    n, low, high, skip = all_["n"], all_["low"], all_["high"], all_["n"] // 2
    while n > SORTED and low < high:
        inside = dev.filter((F.col("d") >= low) & (F.col("d") <= high))
        cell = F.least(F.lit(4095), F.floor((F.col("d") - low) / ((high - low) / 4096)))
        cells = inside.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))
        for c in cells.orderBy("cell").collect():  # 4096 rows at most
            if skip < c["n"]:
                n, low, high = c["n"], c["low"], c["high"]
                break
            skip -= c["n"]
    if n and low < high:
        low = dev.filter((F.col("d") >= low) & (F.col("d") <= high)).orderBy("d").offset(skip).first()["d"]
    return vectors.sparkSession.createDataFrame([(0.2 if not n else max(0.05, min(0.5, 2 * low)),)], "scale double")


# ---- a set of queries against all vectors


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """``round`` as in SQL: half up on the decimal that a number prints as."""
    out = np.round(x, digits)
    scaled = np.abs(x) * 10.0**digits
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best documents of each query, by their best score as it is rounded, then by id."""
    order = np.lexsort((-score, ids, q))
    q, ids, score = q[order], ids[order], score[order]
    first = np.ones(len(q), np.bool_)
    first[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
    q, ids, score = q[first], ids[first], score[first]
    order = np.lexsort((ids, -_half_up(score, DIGITS), q))
    q, ids, score = q[order], ids[order], score[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[kept], ids[kept], score[kept]


def _blocks(queries: DataFrame, column: str) -> Iterator[tuple[np.ndarray, list]]:
    """(ids, vectors) of the queries (qid, column), as many at a time as ``BLOCK_BYTES`` allow."""
    ids, rows, held = [], [], 0
    for row in written(queries.select("qid", column).filter(F.col(column).isNotNull()), "queries").toLocalIterator():
        size = 8 * len(np.ravel(row[1]))
        if held and held + size > BLOCK_BYTES:
            yield np.array(ids), rows
            ids, rows, held = [], [], 0
        ids.append(row[0])
        rows.append(row[1])
        held += size
    if ids:
        yield np.array(ids), rows


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """A column of (lists of) lists of one length as an array; ``column`` has no nulls."""
    shape = [len(column)]
    while pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        column = column.flatten()
        shape.append(len(column) // max(1, int(np.prod(shape))))
    return column.to_numpy(zero_copy_only=False).astype(kind).reshape(shape)


Product = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, q @ x.T)


def _raw_dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return q @ x.T


def _differing(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(x)), np.int64)
    for w in range(q.shape[-1]):
        out += np.bitwise_count((q[:, None, w] ^ x[None, :, w]).view(np.uint64))  # of a signed number it would count those of its size
    return out


def _nearness(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return -_differing(q, x).astype(np.float64)


def _views(bits: int) -> Product:
    def product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return reduce(np.add, (np.maximum(0.0, 1 - _differing(q[:, i], x[:, i]) / bits) for i in range(q.shape[1]))) / q.shape[1]

    return product


def _products(queries: DataFrame, vectors: DataFrame, q_column: str, column: str, kind: type, product: Product, k: int | None) -> DataFrame:
    """(qid, doc_id, score): every query by every vector, or each task's ``k`` best documents of each query."""
    spark = vectors.sparkSession
    rows = vectors.select("doc_id", column).filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    kinds = [to_arrow_type(queries.schema["qid"].dataType), to_arrow_type(vectors.schema["doc_id"].dataType)]
    fields = f"qid {queries.schema['qid'].dataType.simpleString()}, doc_id {vectors.schema['doc_id'].dataType.simpleString()}, score double"
    parts = []
    for ids, matrix in _blocks(queries, q_column):
        block = spark.sparkContext.broadcast((ids, np.array(matrix, kind)))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            qids, q = block.value
            step = max(1, CELLS // len(q))
            made = lambda a, d, s: pa.RecordBatch.from_arrays([pa.array(qids[a]).cast(kinds[0]), pa.array(d).cast(kinds[1]), pa.array(s)], names=["qid", "doc_id", "score"])
            kept = None
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    docs = part.column(0).to_numpy(zero_copy_only=False)
                    docs = docs.astype(str) if docs.dtype == object else docs
                    score = product(q, _matrix(part.column(1), kind))
                    if k is None:
                        yield made(np.repeat(np.arange(len(q)), len(docs)), np.tile(docs, len(q)), score.ravel())
                        continue
                    # what rounds to the k-th best value or above; repeated documents make room for no more than they take
                    most = min(score.shape[1], k)
                    least = np.partition(score, score.shape[1] - most, axis=1)[:, score.shape[1] - most]
                    if len(np.unique(docs)) < len(docs):
                        least = np.full(len(q), -np.inf)
                    a, d = np.nonzero(score >= (least - 2 * 10.0**-DIGITS)[:, None])
                    new = (a, docs[d], score[a, d])
                    kept = _best(*(new if kept is None else (np.concatenate(x) for x in zip(kept, new))), k)
            if kept is not None:
                yield made(*kept)

        parts.append(rows.mapInArrow(run, fields))
    if not parts:
        return spark.createDataFrame([], fields)
    out = reduce(DataFrame.unionByName, parts)
    return out if k is None else out.groupBy("qid", "doc_id").agg(F.max("score").alias("score"))


def similarity_matrix(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(qid, doc_id, score): q . d of every query (qid, q) and vector (doc_id, emb)."""
    return _products(queries, vectors, "q", "emb", np.float64, _raw_dots, None)


def pure_semantic(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The ``k`` documents of each query (qid, q) by max(0, q . p), the best of a document's passages (doc_id, emb)."""
    return top_k(_products(queries, vectors, "q", "emb", np.float64, _dots, k), k)


maxsim = pure_semantic


def similarity_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` (.., a, b) with their dot product as ``score``."""
    return pairs.withColumn("score", vx.dot(F.col("a"), F.col("b")))


def pair_scores(pairs: DataFrame, queries: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, doc_id, score) of the given pairs (qid, doc_id) alone: best of max(0, q . p) over the document's passages."""
    met = pairs.select("qid", "doc_id").join(queries.select("qid", "q"), "qid").join(passages.select("doc_id", "emb"), "doc_id")
    return met.select("qid", "doc_id", F.greatest(F.lit(0.0), vx.dot(F.col("q"), F.col("emb"))).alias("score")).groupBy("qid", "doc_id").agg(F.max("score").alias("score"))


# ---- binary vectors


def quantize(vectors: DataFrame, mean: DataFrame) -> DataFrame:
    """``vectors`` with their sign bits as 64-bit words in ``bits``."""
    return vectors.crossJoin(F.broadcast(mean)).withColumn("bits", vx.sign_bits(F.col("emb"), F.col("mean"))).drop("mean")


def quantize_views(vectors: DataFrame, mean: DataFrame, scale: DataFrame, views: int = 16) -> DataFrame:
    """``vectors`` with ``views`` shifted sign vectors in ``bits``."""
    return vectors.crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(scale)).withColumn("bits", vx.shifted_bits(F.col("emb"), F.col("mean"), F.col("scale"), views)).drop("mean", "scale")


def pair_distances(pairs: DataFrame, queries: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, doc_id, dist) of the given pairs (qid, doc_id) alone: the least Hamming distance of (qid, qbits) to the document's (doc_id, bits)."""
    met = pairs.select("qid", "doc_id").join(queries.select("qid", "qbits"), "qid").join(passages.select("doc_id", "bits"), "doc_id")
    return met.select("qid", "doc_id", vx.hamming(F.col("qbits"), F.col("bits")).alias("dist")).groupBy("qid", "doc_id").agg(F.min("dist").alias("dist"))


def hamming_candidates(queries: DataFrame, passages: DataFrame, limit: int = 5000) -> DataFrame:
    """The ``limit`` nearest documents of each query (qid, doc_id, dist, rank), by the best of their passages."""
    near = Window.partitionBy("qid").orderBy("dist", "doc_id")
    found = _products(queries, passages, "qbits", "bits", np.int64, _nearness, limit)
    return found.select("qid", "doc_id", (-F.col("score")).cast("int").alias("dist")).withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= limit)


def pure_semantic_quantized(queries: DataFrame, passages: DataFrame, k: int, bits: int = 64, limit: int = 5000) -> DataFrame:
    near = hamming_candidates(queries, passages, min(k, limit))
    return top_k(near.select("qid", "doc_id", F.greatest(F.lit(0.0), 1 - F.col("dist") / float(bits)).alias("score")), k)


def pure_semantic_views(queries: DataFrame, passages: DataFrame, k: int, bits: int = 64) -> DataFrame:
    """As above over several views: a passage's similarity is the mean over its views, a document's that of its best passage."""
    return top_k(_products(queries, passages, "qbits", "bits", np.int64, _views(bits), k), k)


def nearest_bits(queries: DataFrame, vectors: DataFrame, k: int, bits: Callable[[int], int]) -> DataFrame:
    """(qid, doc_id, score): at least the ``k`` best by 1 - share of differing bits of (qid, q) and (doc_id, v), of ``bits(words)`` bits each."""

    def product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        own, back = np.unique(x, axis=0, return_inverse=True)  # equal vectors are compared once
        return (1 - _differing(q, own) / float(bits(q.shape[-1])))[:, back.ravel()]

    return _products(queries, vectors, "q", "v", np.int64, product, k)
