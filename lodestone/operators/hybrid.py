"""Hybrid retrieval: lexical weights blended with vector similarity.

Scores are made where a document's words are (``local``). Texts are read for documents that have all words of a query or of a phrase, and
positions where a document can still reach the top k. ``near`` has the vectors of both sides, or is None.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.tables import written
from . import lexical, local
from .local import DEFAULT_IDF, Cells, Near, Side
from .ranking import DIGITS, top_k

LENGTH_WEIGHT = 0.35
W_SEM, W_LEX = 0.6, 0.4
#: Documents of each query whose span density is looked at first: theirs tell which others can still reach the top k.
FIRST = 64
#: A block of queries whose terms every task has holds at most so many terms.
BLOCK_TERMS = 200_000


def hybrid_candidates(expanded: DataFrame, doc_terms: DataFrame, near: Near, k: int, w_sem: float = W_SEM, w_lex: float = W_LEX) -> DataFrame:
    """Documents with a lexical hit by ``w_sem`` * similarity + ``w_lex`` * overlap."""

    def scored(cells: Cells) -> tuple[np.ndarray, list[np.ndarray]]:
        score = np.where(cells.count() > 0, w_sem * cells.near(0.0) + w_lex * cells.share(), -np.inf)
        return score, [score]

    return top_k(local.ranked(expanded, doc_terms, scored, k, near), k)


def _lexical_score(cells: Cells, average: np.ndarray | float) -> np.ndarray:
    ratio = cells.ratio()
    return ratio * (1 + ratio * ratio) / np.maximum(0.5, 1 - LENGTH_WEIGHT + LENGTH_WEIGHT * cells.n_terms / average)


def _alpha(cells: Cells, n_hit: np.ndarray) -> np.ndarray:
    mean = cells.weight() / np.maximum(n_hit, 1)
    return np.where(n_hit == 0, 1.0, np.clip(1 - mean / np.maximum(cells.side.mean, 0.001)[:, None], 0.0, 1.0))


def _blended(expanded: DataFrame, doc_terms: DataFrame, near: Near, k: int, lex: Callable[[Cells, np.ndarray], np.ndarray], alpha: float | None, **known: DataFrame) -> DataFrame:
    """Documents that share a word with a query, or all for a query that shares none with any, by alpha * similarity + (1 - alpha) * ``lex``.

    ``known`` has what ``whole`` (qid, doc_id) contain, which score 1. Scores of 0 are dropped. ``lex`` also gets the candidates' mean number of terms.
    """
    parts = []
    for side in local.sides(expanded, near=near):
        held = written(local.facts(doc_terms, side, near, **known), "facts")

        def size(cells: Cells) -> list[np.ndarray]:
            hit = (cells.count() > 0).astype(np.float64)
            every = np.ones(cells.shape)
            return [hit, hit * cells.n_terms, every, every * cells.n_terms]

        n, terms, all_, all_terms = local.sums(held, side, size, "ssss")
        lost = n == 0
        average = np.maximum(np.where(lost, all_terms, terms) / np.maximum(np.where(lost, all_, n), 1), 1.0)[:, None]

        def scored(cells: Cells, lost=lost, average=average) -> tuple[np.ndarray, list[np.ndarray]]:
            n_hit = cells.count()
            weight = _alpha(cells, n_hit) if alpha is None else alpha
            blend = weight * cells.near(0.0) + (1 - weight) * lex(cells, average)
            score = np.where(cells.known("whole", 0.0) > 0, 1.0, blend)
            score = np.where(((n_hit > 0) | lost[:, None]) & (score > 0), score, -np.inf)
            return score, [score]

        parts.append(local.rows(held, side, scored, ["score"], local.kinds(expanded, doc_terms), k))
    return top_k(local.union(parts, expanded, doc_terms, ["score"]), k)


def full_hybrid_text(queries: DataFrame, expanded: DataFrame, docs: DataFrame, doc_terms: DataFrame, idfs: DataFrame, near: Near | None, k: int) -> DataFrame:
    """TF-IDF blended with the dense similarity of ``near`` over documents that share a word with the query.

    A document that contains the whole query scores 1. Scores of 0 are dropped.
    """
    boost = lexical.phrase_boost(queries, idfs, docs, F.lower("text"), doc_terms)
    whole = lexical.exact_search(queries, docs, doc_terms, "text").select("qid", "doc_id")
    return _blended(expanded, doc_terms, near, k, lambda cells, average: _lexical_score(cells, average) * cells.known("boost", 1.0), None, whole=whole, boost=boost)


def legacy_blend(queries: DataFrame, expanded: DataFrame, docs: DataFrame, doc_terms: DataFrame, near: Near, k: int, alpha: float | None = None, mode: str = "text") -> DataFrame:
    """As above with the share of the query's idf as the lexical part; ``alpha`` replaces the weight if given."""
    whole = lexical.exact_search(queries, docs, doc_terms, mode).select("qid", "doc_id")
    return _blended(expanded, doc_terms, near, k, lambda cells, _: cells.share(), alpha, whole=whole)


def _entropy(n: np.ndarray, s: np.ndarray, slog: np.ndarray) -> np.ndarray:
    """``ranking.confidence`` from the number of scores, their sum and that of score * ln score."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(s <= 0, 0.0, np.where(n == 1, 1.0, 1 - (np.log(s) - slog / s) / np.log(n)))


def _listed(cells: Cells, both: bool, digits: int | None) -> list[np.ndarray]:
    """Whether a pair is a candidate, its overlap as it is rounded, and its similarity; 0.5 where there is none."""
    from .dense import _half_up

    hit = cells.count() > 0
    share = _half_up(np.where(hit, cells.share(), 0.0).ravel(), DIGITS).reshape(cells.shape)
    if not both:
        return [hit, share]
    near = np.where(hit, cells.near(0.5), 0.5)
    return [hit, share, near if digits is None else _half_up(near.ravel(), digits).reshape(cells.shape)]


def _folded(both: bool, digits: int | None) -> Callable[[Cells], list[np.ndarray]]:
    def made(cells: Cells) -> list[np.ndarray]:
        hit, *lists = _listed(cells, both, digits)
        out = [hit.astype(np.float64)]
        for x in lists:
            positive = hit & (x > 0)
            out += [np.where(hit, x, 0.0), np.where(positive, x * np.log(np.where(positive, x, 1.0)), 0.0), np.where(hit, x, np.inf), np.where(hit, x, -np.inf)]
        return out

    return made


def lexical_confidence(expanded: DataFrame, doc_terms: DataFrame) -> DataFrame:
    """(qid, confidence) of the overlap of each query with all documents that have some."""
    rows = []
    for side in local.sides(expanded):
        n, s, slog, _, _ = local.sums(local.facts(doc_terms, side), side, _folded(False, None), "ssslm")
        rows += [(q, float(c)) for q, c, m in zip(side.ids, _entropy(n, s, slog), n) if m]
    return doc_terms.sparkSession.createDataFrame(rows, f"qid {expanded.schema['qid'].dataType.simpleString()}, confidence double")


def fused(expanded: DataFrame, doc_terms: DataFrame, near: Near, k: int, digits: int | None = DIGITS) -> DataFrame:
    """``ranking.fuse`` of the overlap with the similarity of ``near``, rounded to ``digits``."""
    parts = []
    for side in local.sides(expanded, near=near):
        held = written(local.facts(doc_terms, side, near), "facts")
        n, sa, la, low_a, high_a, sb, lb, low_b, high_b = local.sums(held, side, _folded(True, digits), "ssslmsslm")
        a, b = _entropy(n, sa, la), _entropy(n, sb, lb)
        wa, wb = (np.where(a + b > 0, x / np.where(a + b > 0, a + b, 1.0), 0.5)[:, None] for x in (a, b))

        def scored(cells: Cells, wa=wa, wb=wb, ranges=((low_a, high_a), (low_b, high_b))) -> tuple[np.ndarray, list[np.ndarray]]:
            hit, *lists = _listed(cells, True, digits)
            norms = []
            for x, (low, high) in zip(lists, ranges):
                width = np.where(hit.any(1), high - low, 1.0)[:, None]
                norms.append(np.where(width <= 1e-6, 0.5, (x - low[:, None]) / np.where(width <= 1e-6, 1.0, width)))
            score = np.where(hit, wa * norms[0] + wb * norms[1], -np.inf)
            return score, [score]

        parts.append(local.rows(held, side, scored, ["score"], local.kinds(expanded, doc_terms), k))
    return top_k(local.union(parts, expanded, doc_terms, ["score"]), k)


def trimmed_words(text: Column) -> Column:
    """The normalised text's words in order, trimmed to letters and digits on both sides; empty where nothing is left."""
    return F.transform(tx.space_words(tx.normalized_text(text)), lambda x: F.lower(F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))


def trimmed_terms(docs: DataFrame) -> DataFrame:
    """(doc_id, term): a document's words once trimmed as for spans."""
    return docs.select("doc_id", F.explode(F.array_distinct(trimmed_words(F.col("text")))).alias("term"))


def _least_span(places: list[np.ndarray]) -> int:
    """The shortest run of words that has one of each list of places: every place closes one that goes back to the last of each."""
    ends = np.sort(np.concatenate(places))
    low = np.full(len(ends), np.iinfo(np.int64).max)
    for own in places:
        at = np.searchsorted(own, ends, side="right")
        low = np.minimum(low, np.where(at > 0, own[at - 1], -1))
    return int((ends - low + 1)[low >= 0].min())


def _term_blocks(expanded: DataFrame) -> Iterator[dict]:
    """{qid: [(term, weight)]} for as many queries at a time as ``BLOCK_TERMS`` allow."""
    rows = expanded.groupBy("qid").agg(F.collect_list(F.struct("term", F.coalesce("idf", F.lit(DEFAULT_IDF)).alias("w"))).alias("terms"))
    block, held = {}, 0
    for row in written(rows, "query-terms").toLocalIterator():
        if held and held + len(row.terms) > BLOCK_TERMS:
            yield block
            block, held = {}, 0
        block[row.qid] = [(t.term, t.w) for t in row.terms]
        held += len(row.terms)
    if block:
        yield block


def span_density(pairs: DataFrame, expanded: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, doc_id, density) of given (qid, doc_id) pairs: how closely a document has the query's words together.

    The documents of the pairs are read once for each block of queries, with the queries that ask for them.
    """
    asked = written(pairs.groupBy("doc_id").agg(F.collect_set("qid").alias("qids")), "asked")
    rows = docs.join(asked, "doc_id").select("doc_id", trimmed_words(F.col("text")).alias("words"), "qids")
    kinds = [rows.schema["doc_id"].dataType.simpleString(), pairs.schema["qid"].dataType.simpleString()]
    spark, parts = docs.sparkSession, []
    for terms in _term_blocks(expanded.join(pairs.select("qid").distinct(), "qid", "left_semi")):
        block = spark.sparkContext.broadcast((terms, {t for own in terms.values() for t, _ in own}))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            terms, wanted = block.value
            for batch in batches:
                out: tuple[list, list, list] = [], [], []
                for doc_id, words, qids in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                    at: dict[str, list[int]] = {}
                    for i, word in enumerate(words.as_py() or ()):
                        if word in wanted:
                            at.setdefault(word, []).append(i)
                    places = {t: np.array(own) for t, own in at.items()}
                    for qid in qids:
                        met = [(places[t], w) for t, w in terms.get(qid, ()) if t in places]
                        if len(met) >= 2:
                            out[0].append(qid)
                            out[1].append(doc_id)
                            out[2].append(sum(w for _, w in met) ** 1.5 / (np.log(_least_span([p for p, _ in met])) + 1))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(2).type.value_type), pa.array(out[1], batch.schema.field(0).type), pa.array(out[2], pa.float64())], names=["qid", "doc_id", "density"])

        parts.append(rows.mapInArrow(run, f"qid {kinds[1]}, doc_id {kinds[0]}, density double"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"qid {kinds[1]}, doc_id {kinds[0]}, density double")


def exact_normalized(queries: DataFrame, docs: DataFrame, doc_terms: DataFrame) -> DataFrame:
    """(qid, doc_id): normalised texts that contain the lower-case query as it stands."""
    pieces = F.transform(tx.space_words(F.lower("text")), lambda w: F.regexp_replace(w, tx.TRAILING_PUNCTUATION, ""))
    inner = F.array_distinct(F.filter(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0))), lambda w: F.octet_length(w) >= 3))
    q = queries.select("qid", F.lower("text").alias("needle"), inner.alias("inner"))
    return lexical.containing(q, docs, doc_terms, tx.normalized_text(F.col("text")))


def full_hybrid_quantized(queries: DataFrame, expanded: DataFrame, docs: DataFrame, doc_terms: DataFrame, idfs: DataFrame, near: Near | None, k: int) -> DataFrame:
    """TF-IDF blended with the binary similarity of ``near``, re-ranked by span density.

    All documents take part; one without any of the query's words scores 0 however near its vector is.
    """
    body = tx.normalized_text(F.col("text"))
    known = {"boost": lexical.phrase_boost(queries, idfs, docs, body, doc_terms), "whole": exact_normalized(queries, docs, doc_terms).distinct()}
    # words of a speaker are only looked up for dialogue queries
    side = expanded.groupBy("qid").agg(F.avg(F.coalesce("idf", F.lit(DEFAULT_IDF))).alias("q_mean"), F.count(F.lit(1)).alias("q_terms"))
    speakers = F.filter(tx.space_words(F.col("text")), lambda w: (F.octet_length(w) >= 3) & F.substring(w, 1, 1).rlike(r"\p{Lu}"))
    talk = side.filter("q_mean < 2.2 and q_terms > 4").join(queries, "qid").select("qid", F.explode(speakers).alias("w")).select("qid", F.lower("w").alias("term")).distinct()
    talk = written(talk, "talk")  # a query's own words
    known["spoken"] = doc_terms.select("doc_id", "term").join(talk, "term").select("qid", "doc_id").distinct()
    known["acts"] = trimmed_terms(docs)
    finals = []
    for block in local.sides(expanded, queries, near):
        held = written(local.facts(doc_terms, block, near, **known), "facts")
        average = held.agg(F.greatest(F.avg(F.col("n_terms").cast("double")), F.lit(1.0)).alias("average")).first()["average"] or 1.0
        finals.append(_reranked(held, block, average, expanded, docs, k, local.kinds(queries, doc_terms)))
    final = written(local.union(finals, queries, doc_terms, ["score"]), "final")
    # documents without hits score 0 and fill up a query that has fewer than k others above that, in order of id; all its others are in ``final``
    short = queries.select("qid").join(final.filter("round(score, 6) > 0").groupBy("qid").agg(F.count(F.lit(1)).alias("n")), "qid", "left").filter(F.coalesce("n", F.lit(0)) < k).select("qid")
    return top_k(final.unionByName(_filling(short, final, doc_terms, k)), k)


def _bases(cells: Cells, average: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(candidate, base, high, n_act): the score before the span density, and the most that this can make of it."""
    n_hit, whole = cells.count(), cells.known("whole", 0.0) > 0
    dialogue = ((cells.side.mean < 2.2) & (cells.side.n > 4))[:, None]
    weight = np.minimum(1.0, _alpha(cells, n_hit) + np.where(dialogue, 0.35, 0.0))
    blend = (weight * cells.near(0.0) + (1 - weight) * _lexical_score(cells, average) * cells.known("boost", 1.0)) * np.where(dialogue & (cells.known("spoken", 0.0) > 0), 1.15, 1.0)
    base = np.where(whole, 1.0, blend)
    n_act, w_act = cells.words("acts")
    # a document's density is at most that of its words side by side
    most = np.where(n_act >= 2, w_act**1.5 / (np.log(np.maximum(n_act, 1)) + 1), 0.0)
    return (n_hit > 0) | whole, base, base * (1 + 0.25 * most), n_act.astype(np.float64)


def _reranked(held: DataFrame, side: Side, average: float, expanded: DataFrame, docs: DataFrame, k: int, kinds: tuple) -> DataFrame:
    """(qid, doc_id, score): the base scores with the span density, of all documents of each query that can be among the ``k`` best.

    The ``FIRST`` of the highest bounds are worked out, and then those whose bound reaches the k-th best score that is known by then, of
    the first and of the base scores of others: what is left out can't be among the best.
    """
    columns = ["high", "base", "n_act"]

    def by_high(cells: Cells) -> tuple[np.ndarray, list[np.ndarray]]:
        candidate, base, high, n_act = _bases(cells, average)
        return np.where(candidate, high, -np.inf), [high, base, n_act]

    def by_base(cells: Cells) -> tuple[np.ndarray, list[np.ndarray]]:
        candidate, base, _, _ = _bases(cells, average)
        return np.where(candidate, base, -np.inf), [base]

    def scored(rows: DataFrame) -> DataFrame:
        density = span_density(rows.filter("n_act >= 2"), expanded, docs)
        return rows.join(density, ["qid", "doc_id"], "left").select("qid", "doc_id", (F.col("base") * (1 + 0.25 * F.coalesce("density", F.lit(0.0)))).alias("score"))

    most = max(FIRST, k)
    order = Window.partitionBy("qid").orderBy(F.desc("high"), "doc_id")
    bounded = local.rows(held, side, by_high, columns, kinds, most).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    placed = written(bounded, "bounded")
    first = written(scored(placed), "first")
    best = written(local.rows(held, side, by_base, ["score"], kinds, k), "best").join(first.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
    known = Window.partitionBy("qid").orderBy(F.desc("score"))
    # a query with fewer than k documents has no floor: all of its documents are in ``first``
    floors = {r.qid: r.score for r in first.unionByName(best).withColumn("r", F.row_number().over(known)).filter(F.col("r") == k).select("qid", "score").collect()}  # a row a query of the block
    floor = np.array([floors.get(q, np.inf) for q in side.ids])[:, None] - 1e-6

    def above(cells: Cells) -> tuple[np.ndarray, list[np.ndarray]]:
        candidate, base, high, n_act = _bases(cells, average)
        return np.where(candidate & (high >= floor), high, -np.inf), [high, base, n_act]

    more = written(local.rows(held, side, above, columns, kinds, None).join(first.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti"), "more")
    return first.unionByName(scored(more))


def _filling(short: DataFrame, base: DataFrame, doc_terms: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, score 0): the ``k`` lowest ids that each of the queries (qid) has no row of ``base`` for.

    At most as many of the lowest ids as a query has rows, and ``k`` more, can matter to it.
    """
    taken = base.join(short, "qid", "left_semi").select("qid", "doc_id")
    most = short.join(taken.groupBy("qid").agg(F.count(F.lit(1)).alias("n")), "qid", "left").agg(F.max(F.coalesce("n", F.lit(0))).alias("n")).first()["n"]
    if most is None:
        return base.limit(0).select("qid", "doc_id", F.lit(0.0).alias("score"))
    lowest = doc_terms.select("doc_id").distinct().orderBy("doc_id").limit(most + k)
    free = lowest.crossJoin(short).join(taken, ["qid", "doc_id"], "left_anti")
    order = Window.partitionBy("qid").orderBy("doc_id")
    return free.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("qid", "doc_id", F.lit(0.0).alias("score"))
