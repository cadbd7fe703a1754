import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as tx


def column(spark, values, function):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").coalesce(1)
    return [r.y for r in df.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


def plain_soundex(word):
    codes = {c: d for d, cs in enumerate(("BFPV", "CGJKQSXZ", "DT", "L", "MN", "R"), 1) for c in cs}
    up = word.upper()
    if not up:
        return "0000"
    out, last = up[0], codes.get(up[0])
    for c in up[1:]:
        now = codes.get(c)
        if now and now != last and len(out.encode()) < 4:
            out += str(now)
        last = now
    return out + "0" * (4 - len(out.encode()))


def test_soundex_fixture(spark):
    want = {"ashcraft": "A226", "tymczak": "T522", "pfister": "P236", "anderton": "A536", "anderson": "A536", "état": "É33", "où": "O000", "": "0000"}
    assert dict(zip(want, column(spark, list(want), tx.soundex))) == want


def test_soundex_against_plain(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéü16-") for _ in range(rng.randint(1, 12))) for _ in range(500)]
    assert column(spark, words, tx.soundex) == [plain_soundex(w) for w in words]


def test_byte_lengths(spark):
    assert column(spark, ["où ab é! abc. ab."], tx.terms) == [["où", "abc"]]
    assert column(spark, ["où ab é! abc. ab."], tx.normalized_text) == ["où é abc ab"]


@pytest.mark.parametrize("word,want", [("12345", True), *((w, False) for w in ("1234", "12345678901", "2021-2022", "$10000", "10,000", "QUANTUM7DELTA", "10000th", "50000kg", "(12345)", "±12345"))])
def test_codes(spark, word, want):
    assert column(spark, [word], tx.is_code) == [want]


def test_identifiers(spark):
    assert column(spark, ["The QUANTUM7DELTA, abc-123-x 84729 12 hello_you ABCDE! Ab1"], tx.identifiers) == [["QUANTUM7DELTA", "abc-123-x", "84729", "hello_you", "ABCDE"]]


def test_passages(spark):
    text = "x" * 1000
    assert [len(p) for p in column(spark, [text], tx.passages_p1)[0]] == [512, 512, 488, 232]
    assert column(spark, ["short"], tx.passages_p1) == [["short"]] and column(spark, [""], tx.passages_p1) == [[""]]
    assert column(spark, ["<b>" + "y" * 150 + "</b>"], tx.passages_p2) == [["y" * 150]]
    assert column(spark, ["abc"], lambda x: tx.passages_p2(x, stride=0)) == [["abc"]]
    long = column(spark, ["".join(chr(97 + i % 26) for i in range(20_000))], tx.passages_p2)[0]
    assert len(long) == 8 and long[0].startswith("abc")


def test_bigrams_estimates_and_null(spark):
    assert [tuple(p) for p in column(spark, ["b a c a"], lambda x: tx.sorted_bigrams(tx.words(x)))[0]] == [("a", "b"), ("b", "c")]
    assert column(spark, ["a", ""], lambda x: tx.sorted_bigrams(tx.words(x))) == [[], []]
    assert column(spark, ["", "a b c d"], tx.token_estimate) == [1, 5]
    assert column(spark, [None], tx.terms) == [None] and column(spark, [None], tx.normalized_text) == [None]


def test_keywords(spark):
    assert column(spark, ["What is the X1 a of 7, code-Word word"], tx.keywords) == [["x1", "of", "7", "code", "word", "word"]]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="abC é.,!\t\n", max_size=20), min_size=1, max_size=8))
def test_terms_against_plain(texts):
    from pyspark.sql import SparkSession

    got = column(SparkSession.getActiveSession(), texts, tx.terms)
    want = [[s for w in t.lower().split() if len((s := w.rstrip(".,!")).encode()) >= 3] for t in texts]
    assert got == want
