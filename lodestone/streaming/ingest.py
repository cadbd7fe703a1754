"""Indexing documents as they arrive: tokenizing is stateless, so each micro-batch appends its own terms.

A batch writes below its own number and overwrites what an earlier try left, so a replay changes nothing. Reading takes a document's
latest batch, as indexing an id again replaces what it had; a document without terms leaves a row without term, so that it too
replaces. Within a batch the last row of an id by ``order`` counts, by default the greatest text. Document frequencies are counted over the table when it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import index
from ..sources.tables import scratch


def start(docs: DataFrame, out: str, checkpoint: str, mode: str = "quantized", available_now: bool = True, order: str = "text") -> StreamingQuery:
    """Write the terms of a streaming (doc_id, text, maybe ``order``) below ``out`` as they come."""

    def sink(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("doc_id").agg(F.max_by("text", order).alias("text"))
        found = index.doc_terms(last, mode)
        last.select("doc_id").join(found, "doc_id", "left").write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = docs.select("doc_id", *dict.fromkeys(("text", order))).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def terms(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, term, tf) of each document's latest batch."""
    rows = spark.read.parquet(out)
    latest = rows.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return rows.join(latest, ["doc_id", "batch"]).filter("term is not null").select("doc_id", "term", "tf")


def stream_terms(spark: SparkSession, path: str, mode: str = "quantized") -> DataFrame:
    """The terms of a documents table, read as a stream of files until no more are there."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4)
    docs = source.option("pathGlobFilter", name).parquet(folder) if not _is_folder(spark, path) else source.parquet(path)
    out = scratch(spark, "stream-terms")
    query = start(docs, out, scratch(spark, "stream-state"), mode)
    query.awaitTermination()
    return terms(spark, out)


def _is_folder(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
