"""Retrieval on small corpora with known winners, and the algebra of vectors and patterns."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.api import Index, register
from lodestone.encoder import HashingEncoder, PrecomputedEncoder
from lodestone.functions import vector as vx
from lodestone.operators import analyze, dense, evaluate, hdc, hybrid, index, lexical, local, ranking
from lodestone.sources import tables
from lodestone.streaming import ingest

FACTS = [(1, "The speed of light is 299792458 metres per second."), (2, "Python is a programming language created by Guido van Rossum."), (3, "The Eiffel Tower stands in Paris, France."), (4, "The secret activation code is QUANTUM7DELTA, keep it safe.")]


def corpus(spark, rows=FACTS):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid bigint, text string")


@pytest.mark.parametrize("mode", ["quantized", "text"])
def test_known_winners(spark, mode):
    asked = {"QUANTUM7DELTA": 4, "speed of light": 1, "Eiffel Tower Paris": 3, "who created python": 2}
    got = Index(corpus(spark), mode=mode).search(queries(spark, *asked), k=1).collect()
    assert {r.qid: r.doc_id for r in got} == dict(enumerate(asked.values()))


def test_routes(spark):
    i = Index(corpus(spark))
    q = queries(spark, "84729", "the passkey please", "Eiffel Tower", "", "eifel towr")
    got = {r.qid: r for r in i.analyze(q).collect()}
    assert [got[n].route for n in range(5)] == ["PureLexical", "PureLexical", "FullHybrid", "PureSemantic", "FullHybrid"]
    assert got[0].has_code and got[4].has_typo and got[3].idf_avg == 0.5
    words = {(r.word, r.term) for r in analyze.expand(q, i.idfs).filter("qid in (1, 4)").collect()}
    assert {("passkey", "pass"), ("passkey", "key"), ("passkey", "passkey"), ("eifel", "eiffel"), ("towr", "tower")} <= words
    assert {r.route for r in i.analyze(q, "PureLexical").collect()} == {"PureLexical"}


def test_exact_kv_context_counts(spark):
    i = Index(corpus(spark, [*FACTS, (5, "Agreement ID: ABC-12345; agreement id = XYZ, end"), (6, "agreement without")]))
    hits = {(r.qid, r.doc_id) for r in i.search_exact(queries(spark, "abc-12345", "tower stands in", "ght is 2997", "nothing here", "!!")).collect()}
    assert hits == {(0, 5), (1, 3), (2, 1)}
    keys = spark.createDataFrame([("activation code",), ("Agreement ID",), ("speed of light",)], "key string")
    assert {(r.key, r.doc_id, r.value) for r in i.search_kv(keys, 0).collect()} == {("activation code", 4, "QUANTUM7DELTA"), ("Agreement ID", 5, "ABC-12345"), ("speed of light", 1, "299792458 metres per second.")}
    assert {(r.doc_id, r.n) for r in i.search_all_instances(spark.createDataFrame([("agreement",)], "key string")).collect()} == {(5, 2), (6, 1)}
    snippet = i.recall_context(spark.createDataFrame([("Paris",)], "key string"), 6).first()
    assert (snippet.doc_id, snippet.snippet) == (3, "ds in Paris, Fran")
    assert i.keyword_overlap(queries(spark, "eiffel paris")).first().doc_id == 3


def test_connectors_skip_three_steps_only(spark):
    rows = [(1, "key is the of value"), (2, "key : = \t x, y"), (3, "key istanbul"), (4, "key")]
    got = {r.doc_id: r.value for r in lexical.key_value(corpus(spark, rows), spark.createDataFrame([("key",)], "key string")).collect()}
    assert got == {1: "the of value", 2: "x", 3: "istanbul"}


def test_keeping_adding_and_clearing(spark, tmp_path):
    made = Index(corpus(spark), spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id bigint, emb array<float>")).save(f"{tmp_path}/i")
    again = Index.open(spark, f"{tmp_path}/i")
    assert again.doc_count() == 4 and again.vectors.count() == 2 and again.has_document(3) and not again.has_document(9)
    more = made.add(corpus(spark, [(2, "Ruby is a gem"), (7, "new"), (7, "newer")]))
    assert more.doc_count() == 5 and more.get_document(2).first().text == "Ruby is a gem" and more.get_document(7).first().text == "newer"
    assert more.terms.filter("doc_id = 2 and term = 'python'").count() == 0
    assert len(more.clear()) == 0 and more.stats().first().documents == 5
    with pytest.raises(ValueError):
        Index(corpus(spark), mode="x")


def test_needles_in_noise(spark):
    rng = random.Random(2)
    noise = lambda n: " ".join(f"noise{rng.randrange(400)}" for _ in range(n))
    rows = [(i, f"{noise(1000)} the hidden token{i}zeta lies here {noise(1000)}") for i in range(5)]
    got = Index(corpus(spark, rows)).search(queries(spark, *(f"token{i}zeta" for i in range(5))), k=1).collect()
    assert {r.qid: r.doc_id for r in got} == {i: i for i in range(5)}


def test_hybrid_is_gated_by_words(spark):
    docs = corpus(spark, [(1, "alpha beta gamma"), (2, "delta epsilon zeta")])
    v = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "doc_id bigint, emb array<float>")
    qv = spark.createDataFrame([(0, [1.0, 0.0])], "qid bigint, q array<float>")
    q = queries(spark, "alpha words unknown")
    got = {r.doc_id: r.score for r in Index(docs, v).search(q, qv, 2).collect()}
    assert got[1] > 0 and got[2] == 0
    assert {r.doc_id for r in Index(docs, v, mode="text").search(q, qv, 2).collect()} == {1}
    lonely = Index(docs, v, mode="text").search(queries(spark, "nothing shared here"), qv, 2).collect()
    assert [(r.doc_id, r.score) for r in lonely] == [(2, 1.0)]


def test_span_density_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["aaa", "bbb", "ccc", "xxx", "yyy"]) for _ in range(rng.randint(1, 25)))) for i in range(40)]
    e = spark.createDataFrame([(0, "aaa", 2.0), (0, "bbb", 3.0), (0, "ccc", None)], "qid bigint, term string, idf double")
    weight = {"aaa": 2.0, "bbb": 3.0, "ccc": 0.5}
    pairs = spark.createDataFrame([(0, i) for i, _ in rows], "qid bigint, doc_id bigint")
    got = {r.doc_id: r.density for r in hybrid.span_density(pairs, e, corpus(spark, rows)).collect()}
    for i, t in rows:
        w = t.split()
        have = {x for x in w if x in weight}
        if len(have) < 2:
            assert i not in got
            continue
        span = min(j - k + 1 for k in range(len(w)) for j in range(k, len(w)) if have <= set(w[k : j + 1]))
        assert math.isclose(got[i], sum(weight[x] for x in have) ** 1.5 / (math.log(span) + 1))


def test_quantisation(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [3.0, 2.0, 1.0])], "doc_id bigint, emb array<float>")
    mean = dense.mean_vector(v)
    assert {r.doc_id: r.bits for r in dense.quantize(v, mean).collect()} == {1: [0b100], 2: [0b001]}  # equal to the mean is 0
    views = dense.quantize_views(v, mean, spark.createDataFrame([(4.0,)], "scale double")).first().bits
    assert len(views) == 16 and views[0] != views[15]
    wide = spark.createDataFrame([([1.0] * 130,)], "emb array<float>").select(vx.sign_bits(F.col("emb"), F.array_repeat(F.lit(0.0), 130)).alias("b")).first().b
    assert wide == [-1, -1, 3]
    assert dense.dynamic_scale(v.limit(0), mean).first().scale == 0.2


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0] + [0.0] * 62,)], "emb array<float>")
    assert df.select(vx.norm(F.col("emb")).alias("n")).first().n == 5
    out = df.select(vx.truncate(F.col("emb"), 64).alias("t")).first().t
    assert out[:2] == [0.6, 0.8]
    for dim in (32, 100, 512):
        with pytest.raises(ValueError):
            vx.truncate(F.col("emb"), dim)


def test_patterns(spark):
    p = spark.range(1).select(hdc.pattern(F.lit("a")).alias("a"), hdc.pattern(F.lit("b")).alias("b"), hdc.pattern(F.lit("a")).alias("c"))
    r = p.select(hdc.similarity(F.col("a"), F.col("c")).alias("same"), hdc.similarity(F.col("a"), F.col("b")).alias("other"), (hdc.unbind(hdc.bind(F.col("a"), F.col("b")), F.col("b")) == F.col("a")).alias("back")).first()
    assert r.same == 1 and abs(r.other - 0.5) < 0.03 and r.back
    b = spark.createDataFrame([(1, [0b111]), (1, [0b011]), (1, [0b001]), (2, [0b11]), (2, [0b01])], "g int, v array<bigint>")
    assert {r.g: r.v for r in hdc.bundle(b, "g").collect()} == {1: [0b011], 2: [0b01]}
    places = spark.createDataFrame([(1, "f.py", "main", "1-9", "x"), (1, "f.py", "main", "10-20", "y")], "mid bigint, path string, scope string, range string, entity string")
    memory = hdc.build_memory(places)
    scores = {(r.mid, r.entity): r.score for r in hdc.validate(memory, places.union(places.withColumn("mid", F.lit(2).cast("bigint"))).union(places.limit(1).withColumn("entity", F.lit("z")))).collect()}
    assert scores[1, "x"] > 0.6 and abs(scores[1, "z"] - 0.5) < 0.05 and scores[2, "x"] == 0.5
    known = spark.createDataFrame([("alpha",), ("beta",)], "name string")
    asked = spark.createDataFrame([(1, "alpha"), (1, "beta"), (1, "of"), (2, "nobody")], "qid bigint, word string")
    assert [r.qid for r in hdc.query_pattern(asked, known).collect()] == [1]


def test_projection_keeps_angles(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [1.0, 1.0, 0.0]), (3, [-1.0, 0.0, 0.0]), (4, None)], "doc_id bigint, emb array<float>")
    p = hdc.project(v, words=40)
    q = p.filter("doc_id = 1").select(F.lit(0).alias("qid"), F.col("v").alias("q"))
    got = {r.doc_id: r.score for r in hdc.recall(p, q, 5).collect()}
    assert got[1] == 1 and abs(got[2] - 0.75) < 0.05 and got[3] < 0.05 and 4 not in got


def test_evaluation(spark):
    ranked = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2), (2, 12, 0.7, 1)], "qid bigint, doc_id bigint, score double, rank int")
    qrels = spark.createDataFrame([(1, 11, 1), (2, 12, 1), (3, 13, 1)], "qid bigint, doc_id bigint, rel int")
    got = {r.qid: r for r in evaluate.metrics(ranked, qrels, 10).collect()}
    assert math.isclose(got[1].ndcg, 1 / math.log2(3)) and got[1].rr == 0.5 and got[2].ndcg == 1 and got[3].recall == 0
    assert {r.qid: r.correct for r in evaluate.top1(ranked, qrels).collect()} == {1: False, 2: True, 3: False}
    docs = corpus(spark, [(10, "keyword here"), (11, "keyword there"), (12, "x"), (13, "y")])
    ext = {r.qid: (r.correct, r.extended) for r in evaluate.extended(ranked, qrels, spark.createDataFrame([(1, "keyword"), (2, "x"), (3, "y")], "qid bigint, text string"), docs).collect()}
    assert ext == {1: (False, True), 2: (True, False), 3: (False, False)}
    split = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("a", 0.0), ("b", 1.0)], "s string, v double")
    assert math.isclose(evaluate.mean_of_splits(split, "s", "v").first().score, 2 / 3)
    line = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(20)], "x double, y double")
    s = evaluate.scaling(line).first()
    assert math.isclose(s.slope, 2) and math.isclose(s.r2, 1)
    pairs = spark.createDataFrame([(float(i), i + random.Random(i).random() * 9) for i in range(80)], "a double, b double")
    ci, r = evaluate.bootstrap(pairs).first(), evaluate.correlation(pairs).first()
    assert ci.low < r.pearson < ci.high and ci.high - ci.low < 0.2


def test_scores(spark):
    s = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (2, 1, 1.0), (2, 2, 0.0), (3, 1, 0.0)], "qid bigint, doc_id bigint, score double")
    assert {r.norm for r in ranking.minmax(s).filter("qid = 1").collect()} == {0.5}
    assert {r.qid: round(r.confidence, 6) for r in ranking.confidence(s).collect()} == {1: 0.0, 2: 1.0, 3: 0.0}
    assert [r.doc_id for r in ranking.top_k(s.filter("qid = 1"), 1).collect()] == [1]


def test_encoders(spark):
    docs = corpus(spark, [(1, "a b c"), (2, ""), (3, "w " * 3000)])
    out = HashingEncoder(64).encode(docs).collect()
    assert len([r for r in out if r.doc_id == 3]) > 1 and all(len(r.emb) == 64 for r in out)
    assert all(abs(sum(x * x for x in r.emb) - 1) < 0.01 for r in out if r.doc_id != 2)
    pooled = {r.doc_id: r.emb for r in HashingEncoder(128, pool=True, output_dim=64).encode(docs).collect()}
    assert set(pooled) == {1, 2, 3} and len(pooled[3]) == 64
    table = spark.createDataFrame([(1, [1.0])], "k bigint, v array<float>")
    assert [r.doc_id for r in PrecomputedEncoder(table, "k", "v").encode(docs).collect()] == [1]
    assert Index(docs).index_passages(HashingEncoder(64)).vectors.count() >= 3


def test_sources(spark, tmp_path):
    made = tables.from_dicts(spark, [{"id": "a", "title": "T", "text": "x"}, {"_id": "b", "text": "y"}])
    assert {tuple(r) for r in made.collect()} == {("a", "T x"), ("b", "y")}
    for kind in ("json", "csv", "orc", "parquet"):
        path = f"{tmp_path}/{kind}"
        writer = spark.createDataFrame([("1", "T", "x")], "id string, title string, text string").write
        (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)
        assert [tuple(r) for r in tables.read_corpus(spark, path, kind, **({"header": "true"} if kind == "csv" else {})).collect()] == [("1", "T x")]
    assert tables.texts_of({"text": ["a", "b"]}) == ["a", "b"] and tables.texts_of("a") == ["a"] and tables.texts_of([{"text": "a"}, "b"]) == ["a", "b"] and tables.texts_of(7) == ["7"]
    v = spark.createDataFrame([(1, [0.5, 0.25]), (2, None)], "doc_id bigint, emb array<float>")
    for half in (False, True):
        tables.write_vectors(v, f"{tmp_path}/v{half}", half)
        tables.write_vectors(v, f"{tmp_path}/v{half}", half)
        assert sorted((r.doc_id, r.emb) for r in tables.read_vectors(spark, f"{tmp_path}/v{half}", 1).filter("emb is not null").collect()) == [(1, [0.5])] * 2
    tables.clear(spark, f"{tmp_path}/vTrue")
    assert tables.refreshed(spark, f"{tmp_path}/vTrue").count() == 0
    tables.export_results(v.select("doc_id"), f"{tmp_path}/out", "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").count() == 2


def test_streaming_replaces_and_replays(spark, tmp_path):
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    corpus(spark, [(1, "first text"), (2, "other text")]).coalesce(1).write.mode("append").parquet(path)
    stream = lambda: spark.readStream.schema("doc_id bigint, text string").parquet(path)
    ingest.start(stream(), out, f"{tmp_path}/state").awaitTermination()
    corpus(spark, [(1, "second text")]).coalesce(1).write.mode("append").parquet(path)
    ingest.start(stream(), out, f"{tmp_path}/state").awaitTermination()
    want = {tuple(r) for r in index.doc_terms(corpus(spark, [(1, "second text"), (2, "other text")])).collect()}
    assert {tuple(r) for r in ingest.terms(spark, out).collect()} == want
    ingest.start(stream(), out, f"{tmp_path}/state").awaitTermination()
    assert {tuple(r) for r in ingest.terms(spark, out).collect()} == want


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("SELECT w1('A b-c') AS a, w2('One, two of') AS b, normalized_text('One, ab') AS c, strip_html('<p>x') AS d, token_estimate('a b c d') AS e, dot(array(1F, 2F), array(3F, 4F)) AS f").first()
    more = spark.sql("SELECT soundex_code('ashcraft') AS a, is_code('12345') AS b, identifiers('see ABC-123, ok') AS c, passages_p1('x') AS d, hamming(array(7L), sign_bits(array(1F, -1F), array(0D, 0D))) AS e, without_stopwords('the cat') AS f, super_chunks('ab') AS g, l2_normalize(array(3F, 4F)) AS h, keywords('the cat 7') AS i").first()
    assert tuple(more) == ("A226", True, ["ABC-123"], ["x"], 2, ["cat"], ["ab"], [0.6, 0.8], ["cat", "7"])
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (["a", "b", "c"], ["one", "two"], "one", " x", 5, 11.0)


def test_loaded_and_raw_idf(spark):
    own = index.load_idf(spark.createDataFrame([("Paris", 9.0), ("paris", 3.0)], "word string, score double"))
    assert [tuple(r) for r in own.collect()] == [("paris", 9.0)]
    raw = {r.term for r in Index(corpus(spark), idf_mode="raw").idfs.collect()}
    assert "paris," in raw and "paris" not in raw


def test_every_query_vector_meets_every_corpus_vector(spark):
    from lodestone.plans import queries as bound

    from .conftest import SF

    b = bound.Bound(spark, SF)
    got = bound.similarity_matrix(spark, SF)
    assert got.count() == b.query_vectors.count() * b.vectors.count() and got.select("doc_id").distinct().count() == b.vectors.count()


def brute_hybrid(rows, query, idf):
    """FullHybrid scores without vectors of a query of lower-case words, by the definition: no bound, no early end."""
    n_terms, words = {}, {}
    strip = lambda w: re.sub(r"[!-/:-@\[-`{-~]+$", "", w)
    for i, t in rows:
        kept = [w for w in t.lower().split() if len(w.encode()) >= 3]
        words[i] = [re.sub(r"^[^0-9a-z]+|[^0-9a-z]+$", "", strip(w)) for w in kept if strip(w)]
        n_terms[i] = [x for w in t.lower().split() if len(x := strip(w)) >= 3]
    average = max(1.0, sum(len(set(x)) for x in n_terms.values()) / len(rows))
    asked = query.split()
    out = {}
    q_mean = sum(idf.get(w, 0.5) for w in asked) / len(asked)
    for i, t in rows:
        own = n_terms[i]
        hit = [w for w in asked if w in own]
        base = 0.0
        if hit:
            v = {w: math.log(1 + own.count(w)) * idf.get(w, 0.5) for w in hit}
            entity, common = sum(x for w, x in v.items() if idf.get(w, 0) > 2.5), sum(x for w, x in v.items() if idf.get(w, 0) <= 2.5)
            ratio = min(1.0, (0.7 * entity + 0.3 * common) / 10)
            lex = ratio * (1 + ratio * ratio) / max(0.5, 0.65 + 0.35 * len(set(own)) / average)
            alpha = max(0.0, min(1.0, 1 - (sum(idf.get(w, 0.5) for w in hit) / len(hit)) / max(q_mean, 0.001)))
            base = (1 - alpha) * lex
        if query in " ".join(strip(w) for w in t.lower().split() if len(w.encode()) >= 3):
            base = 1.0
        have = {w for w in asked if w in words[i]}
        density = 0.0
        if len(have) >= 2:
            w = words[i]
            span = min(j - k + 1 for k in range(len(w)) for j in range(k, len(w)) if have <= set(w[k : j + 1]))
            density = sum(idf.get(x, 0.5) for x in have) ** 1.5 / (math.log(span) + 1)
        out[i] = round(base * (1 + 0.25 * density), 6)
    return sorted(((-s, i) for i, s in out.items()))


def test_hybrid_against_brute_force_with_punctuation_before_words(spark):
    rng = random.Random(6)
    rows = [(1, "alpha alpha beta xxxx yyyy zzzz"), (2, "alpha (beta"), (3, "(alpha (beta"), (4, "«alpha» more words beta"), (5, "alpha"), (6, "nothing here"), (7, "beta (alpha filler")]
    rows += [(i, " ".join(rng.choice(["alpha", "(beta", "beta", "\"alpha", "gamma", "filler", "words", "more"]) for _ in range(rng.randint(2, 30)))) for i in range(8, 150)]
    made = Index(corpus(spark, rows))
    idf = {r.term: r.idf for r in made.idfs.collect()}
    want = brute_hybrid(rows, "alpha beta", idf)
    q = queries(spark, "alpha beta")
    for k in (1, 5, 149):
        got = [(-r.score, r.doc_id) for r in sorted(made.search(q, k=k, force_route="FullHybrid").collect(), key=lambda r: r.rank)]
        assert len(got) == k and all(math.isclose(a[0], b[0], abs_tol=2e-6) and a[1] == b[1] for a, b in zip(got, want)), k


def test_block_products_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_BYTES", 200)
    monkeypatch.setattr(dense, "CELLS", 20)
    rng = random.Random(1)
    v = [(i // 3, [float(rng.choice([-1, 0, 0.5, 1])) for _ in range(8)]) for i in range(120)]
    q = [(i, [float(rng.choice([-1, 0, 1])) for _ in range(8)]) for i in range(7)]
    vectors, asked = spark.createDataFrame(v, "doc_id bigint, emb array<float>"), spark.createDataFrame(q, "qid bigint, q array<float>")
    for k in (1, 4, 100):
        got = {}
        for r in dense.pure_semantic(asked, vectors, k).collect():
            got.setdefault(r.qid, []).append((r.rank, -r.score, r.doc_id))
        for i, x in q:
            best = {}
            for d, y in v:
                best[d] = max(best.get(d, 0.0), sum(a * b for a, b in zip(x, y)))
            assert [t[1:] for t in sorted(got[i])] == sorted((-s, d) for d, s in best.items())[:k]
    assert dense.similarity_matrix(asked, vectors).count() == 840
    assert dense.pure_semantic(asked.limit(0), vectors, 3).count() == 0 == dense.pure_semantic(asked, vectors.limit(0), 3).count()
    named = dense.pure_semantic(asked.withColumn("qid", F.concat(F.lit("q"), "qid")), vectors.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), 2)
    assert named.count() == 14 and {r.doc_id[0] for r in named.collect()} == {"d"}
    assert dense._half_up(__import__("numpy").array([0.1234565, 0.1234555, 2.5, -0.0000005]), 6).tolist() == [0.123457, 0.123456, 2.5, -0.000001]


def test_scale_of_a_tight_cloud(spark, monkeypatch):
    monkeypatch.setattr(dense, "SORTED", 3)
    rng = random.Random(2)
    for values in ([rng.random() for _ in range(99)], [0.1 + rng.random() * 1e-9 for _ in range(500)] + [5.0], [0.25] * 50, [0.0, 1.0]):
        v = spark.createDataFrame([(i, [x]) for i, x in enumerate(values)], "doc_id bigint, emb array<double>")
        mean = spark.createDataFrame([([0.0],)], "mean array<double>")
        assert dense.dynamic_scale(v, mean).first().scale == max(0.05, min(0.5, 2 * sorted(values)[len(values) // 2]))


def test_ranks_over_partitions(spark):
    rng = random.Random(3)
    pairs = [(float(rng.randrange(40)), float(rng.randrange(9))) for _ in range(300)]
    r = evaluate.correlation(spark.createDataFrame([*pairs, (1.0, None)], "a double, b double")).first()
    rank = lambda xs: [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]
    import numpy as np

    a, b = zip(*pairs)
    assert r.n == 300 and math.isclose(r.spearman, np.corrcoef(rank(a), rank(b))[0, 1]) and math.isclose(r.pearson, np.corrcoef(a, b)[0, 1])


def test_index_as_a_mapping_and_its_settings(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id bigint, emb array<float>")
    own = spark.createDataFrame([("light", 7.0)], "term string, idf double")
    i = Index(corpus(spark), v, idf=own)
    assert 3 in i and 9 not in i and i.items().count() == 4
    changed = i.add(corpus(spark, [(2, "light again")]))
    assert changed.idfs.first().idf == 7.0 and {r.doc_id for r in changed.vectors.collect()} == {1}
    gone = changed.discard(spark.createDataFrame([(1,), (77,)], "doc_id bigint"))
    assert len(gone) == 3 and gone.vectors.count() == 0 and 1 not in gone
    kept = Index(corpus(spark), v, mode="text", views=True, idf_mode="raw").clear()
    assert len(kept) == 0 and kept.views and kept.idf_mode == "raw" and kept.mode == "text"
    ordered = Index(corpus(spark)).add(spark.createDataFrame([(9, "zzz", 1), (9, "aaa", 2)], "doc_id bigint, text string, at int").select("doc_id", "text", "at").drop("at"))
    assert ordered.get_document(9).first().text == "zzz"
    # without vectors a blank query has no rows, and others go by words
    got = Index(corpus(spark)).search(queries(spark, "", "Eiffel Tower"), k=1).collect()
    assert [(r.qid, r.doc_id) for r in got] == [(1, 3)]


def test_entities_are_registered_and_packed(spark):
    memory = spark.createDataFrame([(1, [5, 1 << 59]), (2, [0, 7])], "doc_id bigint, v array<bigint>")
    more = hdc.register_entities(memory, spark.createDataFrame([(2, [9, 9]), (3, [1, 2])], "doc_id bigint, v array<bigint>"))
    assert {r.doc_id: r.v for r in more.collect()} == {1: [5, 1 << 59], 2: [9, 9], 3: [1, 2]}
    raw = more.withColumn("raw", hdc.packed(F.col("v")))
    assert all(len(r.raw) == 16 for r in raw.collect()) and raw.filter(hdc.unpacked(F.col("raw")) != F.col("v")).count() == 0


def test_an_emptied_document_loses_its_streamed_terms(spark, tmp_path):
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for text in ("first text", "!!"):
        corpus(spark, [(1, text)]).coalesce(1).write.mode("append").parquet(path)
        ingest.start(spark.readStream.schema("doc_id bigint, text string").parquet(path), out, f"{tmp_path}/state").awaitTermination()
    assert ingest.terms(spark, out).count() == 0


def test_documents_are_bundled_where_their_pairs_are(spark):
    rows = [(d, k, v) for d in range(600) for k, v in (("lang", "fr" if d % 3 else None), ("source", f"s{d % 7}"), ("size", str(d % 2)))]
    pairs = spark.createDataFrame([*rows, (900, "lang", None)], "doc_id bigint, key string, value string")
    bound = pairs.filter("value is not null").select("doc_id", hdc.bind(hdc.pattern(F.col("key"), 5), hdc.pattern(F.col("value"), 5)).alias("v"))
    made = hdc.encode_documents(pairs, 5)
    assert {r.doc_id: r.v for r in made.collect()} == {r.doc_id: r.v for r in hdc.bundle(bound, "doc_id").collect()}
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()  # no row a word


def test_projection_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    v = spark.createDataFrame([(n, [rng.gauss(0, 1) for _ in range(8)]) for n in range(50)], "doc_id bigint, emb array<double>").coalesce(1)
    whole = {r.doc_id: r.v for r in hdc.project(v, words=3).collect()}
    monkeypatch.setattr(hdc, "ROWS", 7)
    assert {r.doc_id: r.v for r in hdc.project(v, words=3).collect()} == whole
    asked, held = hdc.patterns_of(hdc.project(v, words=3)), hdc.project(v.union(v.select(F.col("doc_id") + 50, "emb")), words=3)
    assert [(r.qid, r.doc_id) for r in hdc.recall(held, asked, 2).orderBy("qid", "rank").collect()] == [(n, m) for n in range(50) for m in (n, n + 50)]


def test_a_phrase_with_a_short_word_is_led_to_by_what_documents_have(spark):
    rows = [(i, f"zebra of ivory coast {i}" if i == 7 else f"cup of tea number{i} ivory") for i in range(40)]
    docs = corpus(spark, rows)
    terms = index.doc_terms(docs, "text")
    idfs = index.term_idf(terms, index.count_docs(docs))
    q = queries(spark, "zebra of ivory coast", "cup of nothing number3")
    got = {(r.qid, r.doc_id): r.boost for r in lexical.phrase_boost(q, idfs, docs, F.lower("text"), terms).collect()}
    assert got == {(0, 7): 1.25}
    # only documents that have all words of a phrase meet it, however common one of the words is
    wanted = spark.createDataFrame([(0, w) for w in ("zebra", "of", "ivory")] + [(1, "of"), (2, "of"), (2, "nowhere")], "qid bigint, term string")
    assert sorted(local.having_all(wanted, terms).collect()) == [(0, 7), *((1, i) for i in range(40))]


def test_local_scores_against_plans_with_a_row_a_pair(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(60)]
    docs = corpus(spark, [(i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(300)] + [(300, "")]).repartition(5)
    terms = index.doc_terms(docs)
    e = spark.createDataFrame([(q, rng.choice(words) if j else "unknown", None if j % 4 == 0 else rng.random() * 4) for q in range(9) for j in range(q)], "qid bigint, term string, idf double").dropDuplicates(["qid", "term"])
    v = spark.createDataFrame([(i % 150, [rng.gauss(0, 1) for _ in range(4)]) for i in range(200)] + [(151, None), (152, [1.0, None, 1.0, 1.0]), (153, [1.0])], "doc_id bigint, v array<double>")
    asked = spark.createDataFrame([(q, [rng.gauss(0, 1) for _ in range(4)]) for q in range(0, 9, 2)], "qid bigint, q array<double>")
    lex = ranking.top_k(lexical.overlap(e, terms), 1000).select("qid", "doc_id", "score")
    sem = dense.pair_scores(lex, asked, v.withColumnRenamed("v", "emb")).withColumn("score", F.round("score", 6))
    rows = lambda df: {(r.qid, r.doc_id): round(r.score, 5) for r in df.collect()}
    wanted = rows(ranking.top_k(lex, 5)), rows(ranking.fuse(lex, sem, 5)), {r.qid: round(r.confidence, 6) for r in ranking.confidence(lex).collect()}
    for block, cells in ((200_000, 1 << 19), (230, 50)):
        monkeypatch.setattr(local, "BLOCK_TERMS", block)
        monkeypatch.setattr(local, "CELLS", cells)
        near = local.Near("dot", asked, v)
        assert (rows(lexical.pure_lexical(e, terms, 5)), rows(hybrid.fused(e, terms, near, 5)), {r.qid: round(r.confidence, 6) for r in hybrid.lexical_confidence(e, terms).collect()}) == wanted
    plan = lexical.pure_lexical(e, terms, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
