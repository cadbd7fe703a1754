"""The index as plain tables: terms with counts, document lengths, inverse document frequencies, postings, passages.

A document id is a key: indexing it again replaces all that it had.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None) -> DataFrame:
    """(doc_id, text), with the title in front where there is one."""
    body = F.col(text_col) if title_col is None else F.trim(F.concat_ws(" ", F.col(title_col), F.col(text_col)))
    return docs.select(F.col(id_col).alias("doc_id"), body.alias("text"))


def upsert(old: DataFrame, new: DataFrame, order: Column | None = None) -> DataFrame:
    """``old`` with the rows of ``new``, which win; of several new rows with one id the last by ``order``.

    A table has no order of its own: without ``order`` the greatest text is taken, so that the result is defined.
    """
    latest = new.groupBy("doc_id").agg(F.max_by(F.struct(*[F.col(c) for c in new.columns]), F.col("text") if order is None else order).alias("r")).select("r.*")
    return old.join(latest.select("doc_id"), "doc_id", "left_anti").unionByName(latest)


def _doc_terms(docs: DataFrame, tokens: Column) -> DataFrame:
    # shuffled by document, so that its terms are counted, written and met again in one place
    each = docs.select("doc_id", tokens.alias("words")).repartition("doc_id")
    return each.select("doc_id", F.explode("words").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_terms(docs: DataFrame, mode: str = "quantized") -> DataFrame:
    """(doc_id, term, tf): of stripped words (``quantized``) or of word-character runs (``text``)."""
    return _doc_terms(docs, tx.terms(F.col("text")) if mode == "quantized" else tx.words(F.col("text")))


def doc_lengths(terms: DataFrame) -> DataFrame:
    """(doc_id, n_terms, n_words): distinct and all words."""
    return terms.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_words"))


def idf(df: Column, n: Column) -> Column:
    return F.ln((n + 1) / (df + 1)) + 1


def term_idf(terms: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, df, idf) of the terms of 3 bytes or more; ``n_docs`` is one row (n)."""
    df = terms.filter(F.octet_length("term") >= 3).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n_docs)).select("term", "df", idf(F.col("df"), F.col("n")).alias("idf"))


def count_docs(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n"))


def raw_term_idf(docs: DataFrame) -> DataFrame:
    """(term, df, idf) with the frequency counted on words as they stand, punctuation and all."""
    raw = docs.select("doc_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), tx.SPACE, -1), lambda w: F.octet_length(w) >= 3))).alias("term"))
    return raw.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(count_docs(docs))).select("term", "df", idf(F.col("df"), F.col("n")).alias("idf"))


def load_idf(table: DataFrame, word_col: str = "word", score_col: str = "score") -> DataFrame:
    """(term, idf) from outside, lower case; of words alike the highest."""
    return table.groupBy(F.lower(word_col).alias("term")).agg(F.max(F.col(score_col).cast("double")).alias("idf"))


def phonetic(term_idf: DataFrame) -> DataFrame:
    """(term, sdx)."""
    return term_idf.select("term", tx.soundex(F.col("term")).alias("sdx"))


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, positions) over word-character runs."""
    at = docs.select("doc_id", F.posexplode(tx.words(F.col("text"))).alias("pos", "term"))
    return at.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def stream_chunks(docs: DataFrame, chunk_chars: int = 2000) -> DataFrame:
    """(doc_id, n_chunks, n_tokens): chunks of a text and the distinct words of all of them."""
    n = F.length("text")
    cut = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(chunk_chars)), lambda i: F.substring("text", i + 1, F.lit(chunk_chars)))).otherwise(F.array(F.lit("")))
    return docs.select("doc_id", F.size(cut).alias("n_chunks"), F.size(F.array_distinct(F.flatten(F.transform(cut, tx.words)))).alias("n_tokens"))


def gamma(docs: DataFrame, idfs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(doc_id, gamma): min(0.3, min(1, mean idf / 5)) over all word occurrences, 0.5 by default. A diagnostic."""
    at = (doc_terms(docs) if terms is None else terms).join(idfs.select("term", "idf"), "term", "left")
    mean = at.groupBy("doc_id").agg((F.sum(F.coalesce("idf", F.lit(0.5)) * F.col("tf")) / F.sum("tf")).alias("m"))
    return docs.select("doc_id").join(mean, "doc_id", "left").select("doc_id", F.least(F.lit(0.3), F.least(F.lit(1.0), F.coalesce("m", F.lit(2.5)) / 5)).alias("gamma"))


def stats(docs: DataFrame) -> DataFrame:
    """One row: documents, characters, words, distinct words, postings, passages."""
    terms = doc_terms(docs)
    size = docs.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("characters"), F.sum(F.size(tx.passages_p1(F.col("text"))).cast("bigint")).alias("passages"))
    lex = terms.agg(F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("words"), F.countDistinct("term").alias("distinct_words"))
    return size.crossJoin(lex)


def consistency(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """One row (valid, missing): ids that have a text and ids that have none."""
    found = ids.join(docs.select("doc_id", F.lit(1).alias("there")), "doc_id", "left")
    return found.agg(F.count("there").alias("valid"), F.sum(F.when(F.col("there").isNull(), 1).otherwise(0)).alias("missing"))
