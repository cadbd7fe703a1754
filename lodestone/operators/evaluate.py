"""Retrieval evaluation: ranked (qid, doc_id, score, rank) against judgements (qid, doc_id, rel)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from . import lexical


def top1(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, doc_id, correct) for each judged query; a query without an answer isn't correct."""
    asked = qrels.filter("rel > 0").select("qid").distinct()
    first = ranked.filter("rank = 1").select("qid", "doc_id")
    good = qrels.filter("rel > 0").select("qid", "doc_id").distinct().withColumn("hit", F.lit(True))
    return asked.join(first, "qid", "left").join(good, ["qid", "doc_id"], "left").select("qid", "doc_id", F.coalesce("hit", F.lit(False)).alias("correct"))


def extended(ranked: DataFrame, qrels: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``top1`` with ``extended``: a wrong answer that, like the expected document, has half the query's keywords.

    Reported beside the accuracy and never as part of it. The expected document is the lowest judged id.
    """
    judged = top1(ranked, qrels)
    expected = qrels.filter("rel > 0").groupBy("qid").agg(F.min("doc_id").alias("want"))
    keys = lexical.keyword_table(queries, 4)
    need = keys.groupBy("qid").agg(F.floor(F.sum("n") / 2).alias("need"))
    wrong = judged.filter("not correct and doc_id is not null").join(expected, "qid")
    pairs = wrong.select("qid", "doc_id").union(wrong.select("qid", "want"))
    hits = lexical.keyword_hits(keys, pairs, docs)
    both = wrong.join(need, "qid").join(hits.select("qid", "doc_id", F.col("hits").alias("got")), ["qid", "doc_id"]).join(hits.select("qid", F.col("doc_id").alias("want"), F.col("hits").alias("meant")), ["qid", "want"])
    ok = both.filter((F.col("got") >= F.col("need")) & (F.col("meant") >= F.col("need"))).select("qid", F.lit(True).alias("ok"))
    return judged.join(ok, "qid", "left").select("qid", "doc_id", "correct", F.coalesce("ok", F.lit(False)).alias("extended"))


def metrics(ranked: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(qid, ndcg, ap, rr, recall, precision) at ``k`` for each judged query."""
    rel = qrels.groupBy("qid", "doc_id").agg(F.max("rel").cast("double").alias("rel")).filter("rel > 0")
    ideal = rel.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "doc_id")))
    best = ideal.groupBy("qid").agg(F.sum(F.when(F.col("r") <= k, F.col("rel") / F.log2(F.col("r") + 1.0)).otherwise(0.0)).alias("idcg"), F.count(F.lit(1)).alias("n_rel"))
    got = ranked.filter(F.col("rank") <= k).select("qid", "doc_id", "rank").join(rel, ["qid", "doc_id"])
    got = got.withColumn("seen", F.count(F.lit(1)).over(Window.partitionBy("qid").orderBy("rank")))
    sums = got.groupBy("qid").agg(
        F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.sum(F.col("seen") / F.col("rank")).alias("ap"), F.min("rank").alias("first"), F.count(F.lit(1)).alias("found")
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return best.join(sums, "qid", "left").select(
        "qid", zero(F.col("dcg") / F.col("idcg")).alias("ndcg"), zero(F.col("ap") / F.least(F.col("n_rel"), F.lit(k))).alias("ap"), zero(1 / F.col("first")).alias("rr"),
        zero(F.col("found") / F.col("n_rel")).alias("recall"), zero(F.col("found") / F.lit(float(k))).alias("precision"),
    )


def mean_of_splits(per_query: DataFrame, split_col: str, value_col: str) -> DataFrame:
    """One row (score): the mean over splits of each split's mean, not the mean over queries."""
    return per_query.groupBy(split_col).agg(F.avg(value_col).alias("m")).agg(F.avg("m").alias("score"))


def _mean_ranks(pairs: DataFrame, c: str) -> DataFrame:
    """(c, rank): the mean rank of every distinct value; sums run within range partitions, and over one row a partition."""
    counts = pairs.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    ranged = written(counts.repartitionByRange(c).select(c, "n", F.spark_partition_id().alias("part")), "ranged")
    parts = ranged.groupBy("part").agg(F.sum("n").alias("all"))  # their number is bounded by the shuffle partitions
    before = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    upto = F.sum("n").over(Window.partitionBy("part").orderBy(c))
    return ranged.join(before, "part").select(c, (F.col("before") + upto - (F.col("n") - 1) / 2).alias(f"rank_{c}"))


def correlation(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (n, pearson, spearman) of the pairs without nulls; ties share their mean rank."""
    pairs = written(pairs.select(a, b).dropna(), "pairs")
    ranked = pairs.join(_mean_ranks(pairs, a), a).join(_mean_ranks(pairs, b), b)
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("pearson"), F.corr(f"rank_{a}", f"rank_{b}").alias("spearman"))


def bootstrap(pairs: DataFrame, a: str = "a", b: str = "b", rounds: int = 200, seed: int = 42) -> DataFrame:
    """One row (low, high): 95 % interval of Pearson's correlation, each round weighing the rows by seeded Poisson counts."""
    u = F.xxhash64(F.lit(seed), "round", F.xxhash64(*pairs.columns)).cast("double") / float(1 << 63) / 2 + 0.5
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    n = F.lit(0)
    for s in steps:
        n = n + F.when(u > s, 1).otherwise(0)
    w = pairs.crossJoin(pairs.sparkSession.range(rounds).withColumnRenamed("id", "round")).withColumn("w", n.cast("double"))
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = w.groupBy("round").agg(F.sum("w").alias("n"), F.sum(F.col("w") * x).alias("sx"), F.sum(F.col("w") * y).alias("sy"), F.sum(F.col("w") * x * x).alias("sxx"), F.sum(F.col("w") * y * y).alias("syy"), F.sum(F.col("w") * x * y).alias("sxy"))
    r = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt((F.col("n") * F.col("sxx") - F.col("sx") ** 2) * (F.col("n") * F.col("syy") - F.col("sy") ** 2))
    return s.select(r.alias("r")).agg(F.percentile("r", F.lit(0.025)).alias("low"), F.percentile("r", F.lit(0.975)).alias("high"))


def scaling(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row (slope, intercept, r2) of the line through the points."""
    return points.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
