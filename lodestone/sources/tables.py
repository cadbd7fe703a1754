"""Reading corpora and keeping index tables: Parquet tables that can be reopened, appended to, refreshed and cleared."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "doc_id string, text string"


_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; a temporary one is made on a local master only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    _made.append(f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def clean(spark: SparkSession) -> None:
    """Remove the scratch tables made so far; results that read them must have been written by then."""
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared folder and read back: plans that use it often read it instead of making it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_corpus(spark: SparkSession, path: str, kind: str = "parquet", id_col: str = "id", title_col: str | None = "title", text_col: str = "text", **options: str) -> DataFrame:
    """(doc_id, text) of a Parquet, JSON, CSV, ORC or text source; a title goes in front."""
    raw = spark.read.format(kind).options(**options).load(path)
    parts = [F.col(c) for c in (title_col, text_col) if c and c in raw.columns]
    return raw.select(F.col(id_col).alias("doc_id"), F.trim(F.concat_ws(" ", *parts)).alias("text"))


def from_dicts(spark: SparkSession, rows: Iterable[Mapping[str, object]]) -> DataFrame:
    """(doc_id, text) of dictionaries with ``id`` (or ``_id``), maybe ``title``, and ``text``."""
    made = [(str(r.get("id", r.get("_id", i))), f"{r.get('title') or ''} {r.get('text') or ''}".strip()) for i, r in enumerate(rows)]
    return spark.createDataFrame(made, CORPUS)


def texts_of(batch: object) -> list[str]:
    """The texts of a batch given as a dictionary with ``text``, a list of texts or of such dictionaries, or one text."""
    if isinstance(batch, Mapping):
        batch = batch.get("text", [])
    if isinstance(batch, str):
        return [batch]
    return [t for x in batch for t in texts_of(x)] if isinstance(batch, Iterable) else [str(batch)]


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def clear(spark: SparkSession, path: str) -> None:
    """Leave the table empty but readable."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def refreshed(spark: SparkSession, path: str) -> DataFrame:
    """The table as it is now, whatever was read of it before."""
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [None if v is None else np.asarray(v, np.float16).tobytes() for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "half"])


def write_vectors(vectors: DataFrame, path: str, half: bool = False) -> None:
    """Append (doc_id, emb); ``half`` stores 16-bit floats."""
    if half:
        vectors = vectors.select(F.col("doc_id").cast("bigint").alias("doc_id"), "emb").mapInArrow(_pack, "doc_id bigint, half binary")
    append(vectors, path)


def _unpack(dims: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [None if b is None else np.frombuffer(b, np.float16)[:dims].astype(np.float32) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=["doc_id", "emb"])

    return run


def read_vectors(spark: SparkSession, path: str, dims: int | None = None) -> DataFrame:
    """(doc_id, emb), or the first ``dims`` values of each."""
    raw = spark.read.parquet(path)
    if "half" in raw.columns:
        return raw.mapInArrow(_unpack(dims), "doc_id bigint, emb array<float>")
    return raw.select("doc_id", F.col("emb") if dims is None else F.slice("emb", 1, dims).alias("emb"))


def export_results(ranked: DataFrame, path: str, kind: str = "json") -> None:
    """Write ranked results as JSON lines or CSV with a header."""
    writer = ranked.write.mode("overwrite")
    writer.json(path) if kind == "json" else writer.option("header", True).csv(path)
