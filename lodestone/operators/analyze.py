"""Query analysis: known and unknown words, codes, compound splits, phonetic expansion, routes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

ROUTES = ("PureLexical", "PureSemantic", "FullHybrid")
ALPHA = {"high_lexical": 0.85, "balanced": 0.7, "high_semantic": 0.7, "very_high_semantic": 0.7, "pure_semantic": 0.0}


def query_words(queries: DataFrame) -> DataFrame:
    """(qid, pos, word)."""
    return queries.select("qid", F.posexplode(tx.terms(F.col("text"))).alias("pos", "word"))


def fuzzy(words: DataFrame, vocabulary: DataFrame, top_k: int = 5, max_distance: int = 2) -> DataFrame:
    """(word, term, distance): the nearest words of the same sound; only distinct ``words`` (word) are looked up."""
    sounded = words.select("word").distinct().withColumn("sdx", tx.soundex(F.col("word")))
    near = sounded.join(vocabulary.select("term", tx.soundex(F.col("term")).alias("sdx")), "sdx").filter(F.abs(F.length("word") - F.length("term")) <= max_distance)
    near = near.withColumn("distance", F.levenshtein("word", "term")).filter(F.col("distance") <= max_distance)
    order = Window.partitionBy("word").orderBy("distance", "term")
    return near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top_k).select("word", "term", "distance")


def expand(queries: DataFrame, idfs: DataFrame) -> DataFrame:
    """(qid, pos, word, kind, term, idf): what each query word stands for.

    ``kind`` is ``code``, ``known``, ``compound`` (its parts and itself), ``typo`` (words of the same sound instead) or ``oov``.
    """
    asked = query_words(queries)
    known = asked.select("word").distinct().join(idfs.select(F.col("term").alias("word"), F.col("idf").alias("word_idf")), "word", "left")
    compound = F.col("word").isin(*tx.COMPOUNDS)
    kinds = known.withColumn("kind", F.when(tx.is_code(F.col("word")), "code").when(F.col("word_idf").isNotNull(), "known").when(compound, "compound"))
    typos = fuzzy(kinds.filter("kind is null"), idfs).filter("term <> word").select("word", F.col("term").alias("near"))
    parts = reduce(lambda c, k: c.when(F.col("word") == k, F.array(*map(F.lit, (*tx.COMPOUNDS[k], k)))), tx.COMPOUNDS, F.when(F.lit(False), F.array(F.lit(""))))
    meaning = kinds.join(typos, "word", "left").select(
        "word", F.coalesce("kind", F.when(F.col("near").isNotNull(), "typo").otherwise("oov")).alias("kind"),
        F.when(F.col("kind") == "compound", parts).otherwise(F.array(F.coalesce(F.when(F.col("kind").isNull(), F.col("near")), F.col("word")))).alias("terms"),
    )
    meaning = meaning.select("word", "kind", F.explode("terms").alias("term"))
    meaning = meaning.join(idfs.select("term", "idf"), "term", "left")
    return asked.join(meaning, "word").select("qid", "pos", "word", "kind", "term", "idf")


def expanded_terms(expansion: DataFrame) -> DataFrame:
    """(qid, term, idf): the set that a query is searched by; idf is null for a word that the corpus lacks."""
    return expansion.groupBy("qid", "term").agg(F.max("idf").alias("idf"))


def route_of(has_code: Column, intent: Column, n_words: Column, idf_avg: Column, n_high: Column, oov_ratio: Column) -> Column:
    short = (n_words <= 8) & (idf_avg <= 1.2) & (n_high == 0) & (oov_ratio < 0.1)
    return F.when(n_words == 0, "PureSemantic").when(has_code | intent, "PureLexical").when(short, "PureSemantic").otherwise("FullHybrid")


def analyze(queries: DataFrame, expansion: DataFrame, force_route: str | None = None) -> DataFrame:
    """(qid, n_words, n_expanded, idf_avg, oov_ratio, has_code, has_typo, route)."""
    word = expansion.groupBy("qid", "pos", "word", "kind").agg(F.max("idf").alias("own"))
    seen = word.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_words"),
        F.max((F.col("kind") == "code").cast("int")).alias("codes"),
        F.max((F.col("kind") == "typo").cast("int")).alias("typos"),
        F.sum(F.when(F.col("kind").isin("compound", "typo", "oov"), 1).otherwise(0)).alias("n_oov"),
        F.sum(F.when(F.col("kind") != "code", 1).otherwise(0)).alias("n_plain"),
        F.sum(F.when(F.col("kind").isin("code", "known"), 1).otherwise(0)).alias("n_known"),
        F.sum(F.when(F.col("kind") == "code", 5.0).when(F.col("kind") == "known", F.coalesce("own", F.lit(1.5))).otherwise(0.0)).alias("total_idf"),
        F.max(F.col("word").isin(*tx.CODE_INTENT).cast("int")).alias("intents"),
    )
    sets = expanded_terms(expansion).groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_expanded"), F.avg(F.when(F.col("idf") >= 1.5, F.col("idf"))).alias("content"), F.sum((F.coalesce("idf", F.lit(0.0)) > 2.5).cast("int")).alias("n_high")
    )
    a = queries.select("qid").join(seen, "qid", "left").join(sets, "qid", "left").fillna(0, ["n_words", "n_expanded", "codes", "typos", "n_oov", "n_plain", "intents", "n_high"])
    idf_avg = F.when(F.col("n_words") == 0, 0.5).otherwise(
        F.coalesce("content", F.when(F.col("codes") == 1, 10.0), F.when(F.col("n_known") > 0, F.col("total_idf") / F.col("n_known")), F.lit(1.0))
    )
    a = a.withColumn("idf_avg", idf_avg).withColumn("oov_ratio", F.when(F.col("n_plain") > 0, F.col("n_oov") / F.col("n_plain")).otherwise(0.0))
    route = route_of(F.col("codes") == 1, F.col("intents") == 1, F.col("n_words"), F.col("idf_avg"), F.col("n_high"), F.col("oov_ratio"))
    if force_route in ROUTES:
        route = F.lit(force_route)
    return a.select("qid", "n_words", "n_expanded", "idf_avg", "oov_ratio", (F.col("codes") == 1).alias("has_code"), (F.col("typos") == 1).alias("has_typo"), route.alias("route"))


def query_type(route: Column, text: Column) -> Column:
    return F.when(F.trim(text) == "", "balanced").when(route == "PureLexical", "high_lexical").when(route == "PureSemantic", "pure_semantic").otherwise("balanced")


def alpha(kind: Column) -> Column:
    """The published weight of a query type; scoring works its own out."""
    return reduce(lambda c, k: c.when(kind == k, F.lit(ALPHA[k])), ALPHA, F.when(F.lit(False), F.lit(0.0))).otherwise(0.7)
