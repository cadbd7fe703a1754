"""Lexical retrieval: weighted overlap, exact substrings, counts, key-value pairs, snippets, keyword overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.tables import written
from . import local
from .ranking import top_k


def overlap(expanded: DataFrame, doc_terms: DataFrame, default_idf: float = 1.0) -> DataFrame:
    """(qid, doc_id, score): share of the query's idf that a document has, for documents that have some."""
    e = expanded.withColumn("w", F.coalesce("idf", F.lit(default_idf)))
    total = e.groupBy("qid").agg(F.greatest(F.sum("w"), F.lit(1.0)).alias("total"))
    hits = doc_terms.select("doc_id", "term").join((e.select("qid", "term", "w")), "term").groupBy("qid", "doc_id").agg(F.sum("w").alias("hit"))
    return hits.join((total), "qid").select("qid", "doc_id", (F.col("hit") / F.col("total")).alias("score"))


def pure_lexical(expanded: DataFrame, doc_terms: DataFrame, k: int) -> DataFrame:
    return top_k(local.ranked(expanded, doc_terms, _share, k), k)


def _share(cells: local.Cells) -> tuple[np.ndarray, list[np.ndarray]]:
    score = np.where(cells.count() > 0, cells.share(), -np.inf)
    return score, [score]


def _inner(text: Column, mode: str) -> Column:
    """The distinct words of a query but its first and last one, which alone may be cut in a document."""
    if mode == "text":
        w = tx.words(text)
        return F.array_distinct(F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0))))
    w = tx.space_words(F.lower(text))
    inner = F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0)))
    return F.array_distinct(tx.terms(F.array_join(inner, " ")))


def exact_search(queries: DataFrame, docs: DataFrame, doc_terms: DataFrame | None = None, mode: str = "text") -> DataFrame:
    """(qid, doc_id, score 1.0): documents whose lower-case text contains the lower-case query; queries without words find none.

    Queries with an inner word, which must be whole, meet the documents that have all of theirs, so a text is only read for queries
    that it may contain. Others look at every text. ``doc_terms`` are the index's terms of ``mode``; without them the documents' words
    are looked through.
    """
    if doc_terms is None:
        doc_terms, mode = docs.select("doc_id", F.explode(F.array_distinct(tx.words(F.col("text")))).alias("term")), "text"
    q = queries.filter(F.size(tx.words(F.col("text"))) > 0).select("qid", F.lower("text").alias("needle"), _inner(F.col("text"), mode).alias("inner"))
    return containing(q, docs, doc_terms, F.lower("text")).withColumn("score", F.lit(1.0))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(qid, doc_id) of each needle of (doc_id, body, asked) that the body contains; a body is made once, however many are asked for."""
    for batch in batches:
        qids, docs = [], []
        for doc_id, body, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            if (text := body.as_py()) is not None:
                own = [a["qid"] for a in asked.as_py() if a["needle"] in text]
                qids += own
                docs += [doc_id] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(qids, batch.schema.field(2).type.value_type.field("qid").type), pa.array(docs, batch.schema.field(0).type)], names=["qid", "doc_id"])


def containing(q: DataFrame, docs: DataFrame, doc_terms: DataFrame, body: Column, short: bool = True) -> DataFrame:
    """(qid, doc_id): documents whose ``body`` contains the needle of (qid, needle, inner); their terms have all inner words of such a query.

    Without ``short`` there are no needles without an inner word.
    """
    may = local.having_all(q.select("qid", F.explode("inner").alias("term")), doc_terms).join(q.select("qid", "needle"), "qid")
    asked = written(may.groupBy("doc_id").agg(F.collect_list(F.struct("qid", "needle")).alias("asked")), "asked")
    kinds = [q.schema["qid"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()]
    long = docs.join(asked, "doc_id").select("doc_id", body.alias("body"), "asked").mapInArrow(_found, f"qid {kinds[0]}, doc_id {kinds[1]}")
    if not short:
        return long
    rest = docs.select("doc_id", body.alias("body")).join(q.filter(F.size("inner") == 0).select("qid", "needle"), F.contains("body", "needle"))
    return long.unionByName(rest.select("qid", "doc_id"))


def count_instances(docs: DataFrame, needles: DataFrame) -> DataFrame:
    """(key, doc_id, n): occurrences of each key (key) that don't overlap, in documents that have it."""
    low = docs.select("doc_id", F.lower("text").alias("body")).join((needles.select("key", F.lower("key").alias("k"))), F.contains("body", "k"))
    n = (F.length("body") - F.length(F.replace("body", F.col("k")))) / F.length("k")
    return low.filter("k <> ''").select("key", "doc_id", n.cast("bigint").alias("n"))


def _connectors() -> str:
    return "(?i:" + "|".join(sorted(tx.CONNECTORS, key=lambda w: (-len(w), w))) + r")(?![\p{L}\p{N}])"


def key_value(docs: DataFrame, keys: DataFrame, k: int = 0) -> DataFrame:
    """(key, doc_id, value): what follows the first occurrence of each key, behind separators and connecting words, up to a delimiter.

    ``k`` limits the rows of a key, in order of id; 0 means all.
    """
    body = docs.select("doc_id", "text", tx.words(F.col("text")).alias("have"))
    asked = (keys.select("key", F.lower("key").alias("k"), F.array_distinct(tx.words(F.col("key"))).alias("need")))
    met = body.join(asked, F.contains(F.lower("text"), F.col("k"))).filter((F.size("need") > 0) & (F.size(F.array_except("need", "have")) == 0))
    rest = F.substring("text", F.instr(F.lower("text"), F.col("k")) + F.length("k"), F.lit(1 << 30))
    value = F.regexp_extract(rest, r"(?U)^(?:[\s:=]|" + _connectors() + r"){0,3}[\s:=]*([^,;\n\r]*)", 1)
    found = met.select("key", "doc_id", F.regexp_replace(value, r"(?U)^\s+|\s+$", "").alias("value")).filter("value <> ''")
    if k <= 0:
        return found
    return found.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))).filter(F.col("r") <= k).drop("r")


def context(docs: DataFrame, keys: DataFrame, chars: int = 100) -> DataFrame:
    """(key, doc_id, snippet): the text around the first occurrence of each key in the first document that has it."""
    met = docs.join((keys.select("key", F.lower("key").alias("k"))), F.contains(F.lower("text"), F.col("k")))
    one = met.groupBy("key").agg(F.min_by(F.struct("doc_id", "text", "k"), "doc_id").alias("m")).select("key", "m.*")
    at = F.instr(F.lower("text"), F.col("k"))
    start = F.greatest(at - chars, F.lit(1))
    return one.select("key", "doc_id", F.substring("text", start, at + F.length("k") + chars - start).alias("snippet"))


def keyword_overlap(queries: DataFrame, docs: DataFrame, k: int = 100) -> DataFrame:
    """The ``k`` documents of each query with the most of its keywords as substrings; repeated keywords count again."""
    keys = queries.select("qid", F.explode(tx.keywords(F.col("text"))).alias("word")).groupBy("qid", "word").agg(F.count(F.lit(1)).alias("n"))
    return top_k(_substring_hits(keys, docs), k)


def _substring_hits(keys: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, doc_id, score): occurrences-weighted count of the keys (qid, word, n) found in a document.

    A key of letters and digits lies within one run of these. So the parts of each distinct run that are as long as some key are
    joined with the keys by equality; no run is held against every key.
    """
    words = keys.select("word").distinct()
    sizes = words.agg(F.array_sort(F.collect_set(F.length("word"))).alias("sizes"))  # as many as keys have lengths
    have = docs.select("doc_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+", -1), lambda w: w != ""))).alias("run"))
    fitting = F.filter("sizes", lambda n: n <= F.length("run"))
    parts = have.select("run").distinct().crossJoin(F.broadcast(sizes)).select("run", F.explode(fitting).alias("size"))
    parts = parts.select("run", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("run") - F.col("size") + 1), lambda i: F.substring("run", i, F.col("size"))))).alias("word"))
    runs = parts.join(words, "word").select("run", "word")
    hits = have.join(runs, "run").select("doc_id", "word").distinct()
    return hits.join(keys, "word").groupBy("qid", "doc_id").agg(F.sum("n").cast("double").alias("score"))


def keyword_hits(keys: DataFrame, pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, doc_id, hits) of the keys (qid, word, n) for given (qid, doc_id) pairs only."""
    got = pairs.select("qid", "doc_id").distinct().join(docs.select("doc_id", F.lower("text").alias("body")), "doc_id").join((keys), "qid")
    return got.groupBy("qid", "doc_id").agg(F.sum(F.when(F.contains("body", "word"), F.col("n")).otherwise(0)).alias("hits"))


def keyword_table(queries: DataFrame, least: int) -> DataFrame:
    return queries.select("qid", F.explode(tx.keywords(F.col("text"), least)).alias("word")).groupBy("qid", "word").agg(F.count(F.lit(1)).alias("n"))


def phrase_windows(queries: DataFrame) -> DataFrame:
    """(qid, size, at, words, phrase): the windows of 4 and 3 words of queries of 3 words or more."""
    raw = queries.select("qid", tx.space_words(F.col("text")).alias("w")).filter(F.size("w") >= 3)
    parts = []
    for size in (4, 3):
        cut = raw.filter(F.size("w") >= size).select("qid", "w", F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("at"))
        window = F.slice("w", F.col("at"), F.lit(size))
        parts.append(cut.select("qid", F.lit(size).alias("size"), "at", F.transform(window, lambda x: F.lower(F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))).alias("words"), F.lower(F.array_join(window, " ")).alias("phrase")))
    return parts[0].unionByName(parts[1])


def phrase_boost(queries: DataFrame, idfs: DataFrame, docs: DataFrame, body: Column, doc_terms: DataFrame) -> DataFrame:
    """(qid, doc_id, boost): 1.25 where a rare enough phrase of 4 words of the query is in the document, else 1.15 for one of 3.

    ``body`` is the text to look in, ``doc_terms`` has the words that a document must have all of for a phrase to count; only documents
    that have them are read.
    """
    win = written(phrase_windows(queries).withColumn("id", F.monotonically_increasing_id()), "windows")
    each = win.select("id", F.explode("words").alias("term")).join(idfs.select("term", "idf"), "term", "left")
    good = each.groupBy("id").agg(F.avg(F.coalesce("idf", F.lit(0.5))).alias("mean")).filter("mean >= 2.2")
    usable = win.filter(F.octet_length(F.trim("phrase")) >= 10).join(good.select("id"), "id").select("id", "qid", "size", "words", "phrase")
    phrases = written(usable, "phrases")
    asked = phrases.select(F.col("id").alias("qid"), F.col("phrase").alias("needle"), F.col("words").alias("inner"))
    met = containing(asked, docs, doc_terms, body, short=False).withColumnRenamed("qid", "id").join(phrases.select("id", "qid", "size"), "id")
    return met.groupBy("qid", "doc_id").agg(F.max(F.when(F.col("size") == 4, 1.25).otherwise(1.15)).alias("boost"))
