"""Encoders: text to unit vectors. Trained weights are the caller's; the two here need none."""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as tx
from .functions import vector as vx


class Encoder(ABC):
    """Gives (id, chunk_idx, emb) for texts (id, text)."""

    @abstractmethod
    def encode(self, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame: ...


class PrecomputedEncoder(Encoder):
    """Looks embeddings up in a table (id, emb)."""

    def __init__(self, table: DataFrame, key: str, value: str):
        self.table = table.select(F.col(key).alias("_key"), F.col(value).alias("emb"))

    def encode(self, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        return texts.join(self.table, F.col(id_col) == F.col("_key")).select(F.col(id_col), F.lit(0).alias("chunk_idx"), "emb")


def hash_vector(tokens: list[str], dim: int) -> np.ndarray:
    out = np.zeros(dim)
    for t in tokens:
        h = int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "big")
        out[h % dim] += 1.0 if h >> 63 else -1.0
    return out / max(float(np.linalg.norm(out)), 1e-12)


class ModelEncoder(Encoder):
    """Wraps ``make()``, which gives a function from a list of texts to a (n, dim) array, called once a Python worker.

    Texts of more than ``max_tokens`` estimated tokens are cut into super-chunks, each one vector, or with ``pool`` averaged to one.
    """

    def __init__(self, make: Callable[[], Callable[[list[str]], np.ndarray]], max_tokens: int = 512, pool: bool = False, output_dim: int | None = None):
        self.make, self.max_tokens, self.pool, self.output_dim = make, max_tokens, pool, output_dim

    def encode(self, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        text = F.coalesce(F.col(text_col), F.lit(""))
        chunks = F.when(tx.token_estimate(text) > self.max_tokens, tx.super_chunks(text, self.max_tokens)).otherwise(F.array(text))
        rows = texts.select(F.col(id_col).cast("bigint").alias("id"), F.posexplode(chunks).alias("chunk_idx", "chunk"))
        make = self.make

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = make()
            for frame in frames:
                if len(frame):
                    yield pd.DataFrame({"id": frame["id"], "chunk_idx": frame["chunk_idx"], "emb": list(np.asarray(model(frame["chunk"].tolist()), np.float32))})

        out = rows.mapInPandas(run, "id bigint, chunk_idx int, emb array<float>")
        if self.pool:
            sums = out.select("id", F.posexplode("emb").alias("dim", "x")).groupBy("id", "dim").agg(F.avg("x").alias("x"))
            out = sums.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("emb")).select("id", F.lit(0).alias("chunk_idx"), vx.l2_normalize(F.col("emb")).cast("array<float>").alias("emb"))
        if self.output_dim is not None:
            out = out.withColumn("emb", vx.truncate(F.col("emb"), self.output_dim).cast("array<float>"))
        return out.withColumnRenamed("id", id_col)


def apply_layers(vectors: DataFrame, functions: dict[str, Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """(doc_id, name, emb): every vector (doc_id, emb) through each of the named functions of a batch of vectors, such as those of ``functions.layers``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = np.stack(frame["emb"].to_numpy()).astype(np.float64)
                for name, function in functions.items():
                    yield pd.DataFrame({"doc_id": frame["doc_id"], "name": name, "emb": list(function(x))})

    kind = vectors.schema["doc_id"].dataType.simpleString()
    return vectors.select("doc_id", "emb").filter("emb is not null").mapInPandas(run, f"doc_id {kind}, name string, emb array<double>")


class HashingEncoder(ModelEncoder):
    """Signed hashes of words, unit length: repeatable and without a model. It claims no semantic quality."""

    def __init__(self, dim: int = 384, **options):
        super().__init__(lambda: lambda texts: np.stack([hash_vector(t.lower().split(), dim) for t in texts]), **options)
