import random

from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import minhash, queries, secrets

from ..conftest import SF
from ..oracle import differences


def through(spark, docs):
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], None))
    return seen


def test_stages_keep_columns_and_each_decides(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    raw, told, single, clean, packed = through(spark, docs)
    for df in (told, single, clean):
        assert df.columns == docs.columns
    groups = minhash.components(minhash.near_pairs(told).select("a", "b"))
    gone = {r.id for r in groups.filter("id <> group_id").collect()}
    assert {r.doc_id for r in told.collect()} - gone == {r.doc_id for r in single.collect()} and gone
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()}
    assert secrets.parts(clean).filter("strong").count() == 0
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in clean.collect()}
    assert packed.groupBy("bin_id").agg(F.sum("length").alias("n"), F.max("bin_fill").alias("f")).filter("n <> f or n > 2048").count() == 0


def test_odd_tables(spark):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(["the", "and", "of", "with", "that"]) + str(rng.randrange(999)) for _ in range(80))
    one = text()
    rows = [(i, text(), "en", "s", 1) for i in range(30)] + [(50, one, "en", "s", 1), (51, one, None, None, None), (50, one, "en", "s", 1), (60, None, "en", "s", 0), (61, "", "en", "s", 0), (None, text(), "en", "s", 1)]
    rows.append((70, text() + ' token = "' + "ab12" * 10 + '"', "en", "s", 1))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("label", F.lit("x")).withColumn("scope", F.lit(1))
    _, told, single, clean, packed = through(spark, df)
    assert {r.doc_id for r in told.collect()} == {*range(30), 50, 51, None, 70}
    assert {r.doc_id for r in single.collect()} == {*range(30), 50, None, 70} and clean.columns == df.columns
    assert clean.filter("doc_id = 70").first().text.endswith(secrets.MARK)
    assert packed.count() == 33
    assert through(spark, df.limit(0))[-1].count() == 0


def test_run_equals_its_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    want = through(spark, spark.read.parquet(f"{SF}/documents.parquet"))[-1]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_queries_against_their_sql(spark):
    q = queries.queries()
    for name, sql in queries.oracle_sql().items():
        assert differences(q[name](spark, SF), SF, sql) == "", name


def test_every_operator_has_a_query(spark):
    names = list(queries.queries())
    assert [n for n in range(1, 11) if not any(x.startswith(f"op{n}_") for x in names)] == [] and "pipeline" in names
