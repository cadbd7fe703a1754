"""Queries of the training-data operators and of the pipeline, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprint, htmldiff, langid, minhash, mpegts, packing, secrets, sharding, warc
from .common import documents


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(spark, _pages(spark, sf_dir))


def op5_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.text_units(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.containments(documents(spark, sf_dir))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmldiff.extract(_pages(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_secrets, op2_bpe, op3_langid, op4_warc, op5_mpegts, op6_packing, op7_fingerprint, op8_minhash, op9_sharding, op10_html, pipeline)
    return {f.__name__: f for f in own}


OP4_SQL = """
SELECT page_id, url, 'response' AS record_type, CAST(200 AS INT) AS http_status, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
       true AS block_digest_ok, true AS payload_digest_ok, 'ok' AS status, html
FROM pages"""

OP5_SQL = f"""
WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
units AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS unit FROM lines)
SELECT doc_id, CAST(1 AS INT) AS program, CAST({mpegts.DATA_PID} AS INT) AS pid, CAST({mpegts.PRIVATE_DATA} AS INT) AS stream_type, unit,
       {mpegts.FIRST_PTS} + {mpegts.UNIT_TICKS} * unit AS pts,
       CASE WHEN unit % 2 = 1 THEN {mpegts.FIRST_PTS} + {mpegts.UNIT_TICKS} * (unit - 1) END AS dts,
       unit % {mpegts.KEY_EVERY} = 0 AS random_access, CAST(0 AS INT) AS lost_packets, 'ok' AS status,
       CAST(octet_length(encode(line)) AS BIGINT) AS payload_bytes, line
FROM units"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secrets": secrets.oracle_sql(), "op4_warc": OP4_SQL, "op5_mpegts": OP5_SQL}
