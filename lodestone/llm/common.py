"""Shared plumbing of the training-data operators: scratch tables, sized joins, bounded text slices."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is broadcast only when its written size is at most this many bytes.
BROADCAST_BYTES = 8 << 20
#: Python workers look at about this many bytes of text at a time.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one on a local master only."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Scratch tables that are there: of the session, and of each open scope.
_made: list[list[str]] = [[]]


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    _made[-1].append(path)
    return path


def clean(spark: SparkSession) -> None:
    """Remove the scratch tables of the innermost scope, or of the session; results that read them must have been written by then."""
    while _made[-1]:
        drop_path(spark, _made[-1].pop())


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made within are removed at the end, so what is made from them must be written within."""
    _made.append([])
    try:
        yield
    finally:
        clean(spark)
        _made.pop()


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def path_bytes(spark: SparkSession, path: str) -> int:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength()


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def sized(df: DataFrame, name: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` as a written table, hinted for broadcast only if that table is at most ``limit`` bytes."""
    table, path = written(df, name)
    return F.broadcast(table) if path_bytes(df.sparkSession, path) <= limit else table


def whole_partitions(function: Callable[[pd.DataFrame], pd.DataFrame]):
    """``function`` of all rows of a partition, for ``mapInPandas`` behind ``repartitionById``: a partition is one group of bounded size."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [frame for frame in frames if len(frame)]
        if own:
            yield function(pd.concat(own, ignore_index=True))

    return run


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows holding at most ``limit`` bytes together, or a single longer row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the rows' offsets into them; a null row is an empty one."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
