"""Top-k and score arithmetic over (qid, doc_id, score) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6


def top_k(scored: DataFrame, k: int, by: str = "qid", digits: int = DIGITS) -> DataFrame:
    """The ``k`` best of each query with their rank; scores are rounded first and ties go to the lower id."""
    rounded = scored.withColumn("score", F.round("score", digits))
    best = Window.partitionBy(by).orderBy(F.desc("score"), "doc_id")
    return rounded.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def minmax(scored: DataFrame, by: str = "qid") -> DataFrame:
    """(score - least) / range of each query as ``norm``; 0.5 where the range is at most 1e-6."""
    w = Window.partitionBy(by)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scored.withColumn("norm", F.when(high - low <= 1e-6, 0.5).otherwise((F.col("score") - low) / (high - low)))


def confidence(scored: DataFrame, by: str = "qid") -> DataFrame:
    """(qid, confidence): 1 - entropy / ln n of the scores' shares; 0 if they sum to 0, 1 for a single one."""
    total = scored.withColumn("p", F.try_divide("score", F.sum("score").over(Window.partitionBy(by))))
    entropy = F.sum(F.when(F.col("p") > 0, -F.col("p") * F.ln("p")).otherwise(0.0))
    return total.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), entropy.alias("h")).select(
        by, F.when(F.col("s") <= 0, 0.0).when(F.col("n") == 1, 1.0).otherwise(1 - F.col("h") / F.ln(F.col("n").cast("double"))).alias("confidence")
    )


def fuse(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Confidence-weighted fusion: candidates of ``a`` with their score and that of ``b`` (0.5 where it has none).

    Each list weighs by its confidence (both alike if neither has any), and both are min-max normalised.
    """
    both = a.select("qid", "doc_id", F.col("score").alias("sa")).join(b.select("qid", "doc_id", F.col("score").alias("sb")), ["qid", "doc_id"], "left").withColumn("sb", F.coalesce("sb", F.lit(0.5)))
    one = lambda c: both.select("qid", "doc_id", F.col(c).alias("score"))
    ca, cb = (confidence(one(c)).withColumnRenamed("confidence", n) for c, n in (("sa", "ca"), ("sb", "cb")))
    na, nb = (minmax(one(c)).select("qid", "doc_id", F.col("norm").alias(n)) for c, n in (("sa", "na"), ("sb", "nb")))
    total = F.col("ca") + F.col("cb")
    weight = lambda c: F.when(total > 0, F.col(c) / total).otherwise(0.5)
    joined = na.join(nb, ["qid", "doc_id"]).join(ca, "qid").join(cb, "qid")
    return top_k(joined.select("qid", "doc_id", (weight("ca") * F.col("na") + weight("cb") * F.col("nb")).alias("score")), k)
