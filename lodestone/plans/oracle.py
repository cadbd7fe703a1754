"""What each query must return, in DuckDB's SQL, written from the operators' definitions."""

from __future__ import annotations

from ..functions import text as tx
from ..operators.analyze import ALPHA
from .queries import K, KEYS, NEEDLES, Q_CODES

SP = r"[\s\x{0B}\x{85}\p{Z}]+"
PUNCT = r"[!-/:-@\[-`{-~]+$"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return ", ".join(_q(x) for x in xs)


def w1(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+')"


def w2(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex(lower({x}), '{SP}'), lambda w: regexp_replace(w, '{PUNCT}', '')), lambda w: strlen(w) >= 3)"


def norm(x: str) -> str:
    return f"array_to_string(list_transform(list_filter(string_split_regex(lower({x}), '{SP}'), lambda w: strlen(w) >= 3), lambda w: regexp_replace(w, '{PUNCT}', '')), ' ')"


def spaced(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{SP}'), lambda w: w <> '')"


def code(x: str) -> str:
    clean = f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]', '', 'g')"
    return (
        f"(NOT regexp_matches({x}, '[/\\-$€£,±×÷]|^[(\\[]') AND strlen({clean}) BETWEEN 5 AND 15 AND NOT regexp_matches(lower({clean}), '^[0-9]+(?:st|nd|rd|th)$') "
        f"AND NOT regexp_matches({clean}, '[A-Za-z]') AND length(regexp_replace({clean}, '[^0-9]', '', 'g')) BETWEEN 5 AND 10)"
    )


def _codes(x: str) -> str:
    up = f"upper(replace({x}, 'ß', 'ss'))"
    return f"translate(regexp_replace({up}, '[^BFPVCGJKQSXZDTLMNR]', '0', 'g'), 'BFPVCGJKQSXZDTLMNR', '111122222222334556')"


def sounded(source: str, column: str) -> str:
    """``source``'s rows with ``sdx`` of ``column``."""
    return f"""(SELECT * EXCLUDE (c_, f_), CASE WHEN {column} = '' THEN '0000' ELSE f_ || rpad(array_to_string(list_filter(list_transform(range(2, length(c_) + 1), lambda i:
        CASE WHEN c_[i] <> '0' AND c_[i] <> c_[i - 1] THEN c_[i] END), lambda x: x IS NOT NULL)[1:greatest(4 - strlen(f_), 0)], ''), greatest(4 - strlen(f_), 0)::INT, '0') END AS sdx
        FROM (SELECT *, {_codes(column)} AS c_, upper(replace({column}, 'ß', 'ss'))[1] AS f_ FROM {source}))"""


ACCENTS = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿßœ"


def ascii_(x: str) -> str:
    """Each accented letter as a byte of its own, for the byte-wise edit distance."""
    return f"translate({x}, '{ACCENTS}', '{''.join(chr(i + 1) for i in range(8))}{''.join(chr(i + 14) for i in range(len(ACCENTS) - 8))}')"


def base(mode: str = "quantized") -> str:
    words = w2("text") if mode == "quantized" else w1("text")
    return f"""
    q AS (SELECT item_id AS qid, text FROM benchmark),
    dt AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({words}) AS term FROM documents) GROUP BY 1, 2),
    idf AS MATERIALIZED (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf FROM dt WHERE strlen(term) >= 3 GROUP BY 1),
    dl AS (SELECT doc_id, count(*) AS n_terms, sum(tf)::BIGINT AS n_words FROM dt GROUP BY 1)"""


def expansion(queries: str = "q") -> str:
    return f"""
    qw AS MATERIALIZED (SELECT qid, unnest(range(0, len(w))) AS pos, unnest(w) AS word FROM (SELECT qid, {w2("text")} AS w FROM {queries})),
    kk AS MATERIALIZED (SELECT word, CASE WHEN {code("word")} THEN 'code' WHEN idf IS NOT NULL THEN 'known' WHEN word IN ({_list(tx.COMPOUNDS)}) THEN 'compound' END AS kind
           FROM (SELECT DISTINCT word FROM qw) LEFT JOIN idf ON term = word),
    voc AS MATERIALIZED (SELECT term, sdx FROM {sounded("idf", "term")}),
    fz AS MATERIALIZED (SELECT word, term FROM (SELECT word, term, row_number() OVER (PARTITION BY word ORDER BY dist, term) AS r FROM
           (SELECT word, term, levenshtein({ascii_("word")}, {ascii_("term")}) AS dist FROM {sounded("(SELECT word FROM kk WHERE kind IS NULL)", "word")} JOIN voc USING (sdx)
            WHERE abs(length(word) - length(term)) <= 2) WHERE dist <= 2) WHERE r <= 5 AND term <> word),
    meant AS (SELECT word, coalesce(kind, CASE WHEN fz.term IS NULL THEN 'oov' ELSE 'typo' END) AS kind,
              unnest(CASE {" ".join(f"WHEN kind = 'compound' AND word = '{k}' THEN [{_list((*v, k))}]" for k, v in tx.COMPOUNDS.items())} ELSE [coalesce(fz.term, word)] END) AS term
              FROM kk LEFT JOIN fz USING (word)),
    ex AS MATERIALIZED (SELECT qid, pos, qw.word, kind, m.term, idf FROM qw JOIN meant m ON qw.word = m.word LEFT JOIN idf ON idf.term = m.term),
    e AS MATERIALIZED (SELECT qid, term, max(idf) AS idf FROM ex GROUP BY 1, 2)"""


def analysis(queries: str = "q") -> str:
    return f"""
    wd AS (SELECT qid, pos, word, kind, max(idf) AS own FROM ex GROUP BY ALL),
    sw AS (SELECT qid, count(*) AS n_words, bool_or(kind = 'code') AS has_code, bool_or(kind = 'typo') AS has_typo, count(*) FILTER (kind IN ('compound', 'typo', 'oov')) AS n_oov, count(*) FILTER (kind <> 'code') AS n_plain,
           count(*) FILTER (kind IN ('code', 'known')) AS n_known, sum(CASE WHEN kind = 'code' THEN 5.0 WHEN kind = 'known' THEN own ELSE 0 END) AS total_idf, bool_or(word IN ({_list(tx.CODE_INTENT)})) AS intent FROM wd GROUP BY 1),
    se AS (SELECT qid, count(*) AS n_expanded, avg(idf) FILTER (idf >= 1.5) AS content, count(*) FILTER (idf > 2.5) AS n_high FROM e GROUP BY 1),
    an0 AS (SELECT q.qid, coalesce(n_words, 0) AS n_words, coalesce(n_expanded, 0) AS n_expanded, coalesce(has_code, false) AS has_code, coalesce(has_typo, false) AS has_typo, coalesce(intent, false) AS intent, coalesce(n_high, 0) AS n_high,
            CASE WHEN n_words IS NULL THEN 0.5 ELSE coalesce(content, CASE WHEN has_code THEN 10.0 END, CASE WHEN n_known > 0 THEN total_idf / n_known END, 1.0) END AS idf_avg,
            CASE WHEN n_plain > 0 THEN n_oov / n_plain ELSE 0.0 END AS oov_ratio FROM {queries} q LEFT JOIN sw USING (qid) LEFT JOIN se USING (qid)),
    an AS (SELECT qid, n_words, n_expanded, round(idf_avg, 6) AS idf_avg, round(oov_ratio, 6) AS oov_ratio, has_code, has_typo,
           CASE WHEN n_words = 0 THEN 'PureSemantic' WHEN has_code OR intent THEN 'PureLexical' WHEN n_words <= 8 AND idf_avg <= 1.2 AND n_high = 0 AND oov_ratio < 0.1 THEN 'PureSemantic' ELSE 'FullHybrid' END AS route FROM an0)"""


def top(scored: str, k: int = K) -> str:
    return f"SELECT qid, doc_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INT) AS rank FROM (SELECT qid, doc_id, round(score, 6) AS score FROM ({scored}))) WHERE rank <= {k}"


OVERLAP = """SELECT h.qid, doc_id, hit / greatest(total, 1.0) AS score FROM (SELECT qid, doc_id, sum(coalesce(idf, 1.0)) AS hit FROM e JOIN dt USING (term) GROUP BY 1, 2) h
    JOIN (SELECT qid, sum(coalesce(idf, 1.0)) AS total FROM e GROUP BY 1) t ON h.qid = t.qid"""

EXACT = "SELECT qid, doc_id FROM q, documents d WHERE contains(lower(d.text), lower(q.text)) AND len(" + w1("q.text") + ") > 0"

VEC = """
    v AS MATERIALIZED (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS emb, embedding AS raw FROM embeddings),
    qv AS MATERIALIZED (SELECT item_id AS qid, emb AS q FROM benchmark JOIN v ON item_id = doc_id),
    m AS MATERIALIZED (SELECT list(mean ORDER BY i) AS mean FROM (SELECT i, avg(x) AS mean FROM (SELECT unnest(emb) AS x, unnest(range(0, len(emb))) AS i FROM v) GROUP BY 1))"""


def bits(emb: str, mean: str, shift: str = "0.0") -> str:
    return f"array_to_string(list_transform(range(1, len({emb}) + 1), lambda i: CASE WHEN {emb}[i] - {mean}[i] + {shift} > 0 THEN '1' ELSE '0' END), '')"


SIGNS = f"""
    b AS MATERIALIZED (SELECT doc_id, {bits("emb", "mean")} AS bits FROM v, m),
    qb AS MATERIALIZED (SELECT qid, {bits("q", "mean")} AS qbits FROM qv, m),
    ham AS MATERIALIZED (SELECT qid, doc_id, CAST(hamming(qbits, bits) AS INT) AS dist FROM qb, b)"""

SCALE = """
    dev AS (SELECT abs(x - mean[i]) AS d FROM (SELECT unnest(emb) AS x, unnest(range(1, len(emb) + 1)) AS i FROM v), m),
    sc AS MATERIALIZED (SELECT greatest(0.05, least(0.5, 2 * d)) AS scale FROM (SELECT d, row_number() OVER (ORDER BY d) AS r FROM dev) WHERE r = (SELECT count(*) // 2 FROM dev) + 1)"""

DENSE = "SELECT qid, doc_id, greatest(0.0, list_inner_product(q, emb)) AS score FROM qv, v"


def windows() -> str:
    clean = "regexp_replace(regexp_replace(x, '^[^\\p{L}\\p{N}]+', ''), '[^\\p{L}\\p{N}]+$', '')"
    return f"""
    rw AS (SELECT qid, {spaced("text")} AS w FROM q),
    wn AS (SELECT qid, size, w_at, list_transform(w[w_at:w_at + size - 1], lambda x: lower({clean})) AS words, lower(array_to_string(w[w_at:w_at + size - 1], ' ')) AS phrase
           FROM (SELECT qid, w, size, unnest(range(1, len(w) - size + 2)) AS w_at FROM rw, (VALUES (4), (3)) s(size) WHERE len(w) >= greatest(size, 3))),
    wi AS (SELECT qid, size, w_at, any_value(words) AS words, any_value(phrase) AS phrase FROM (SELECT qid, size, w_at, words, phrase, unnest(words) AS term FROM wn) LEFT JOIN idf USING (term)
           GROUP BY 1, 2, 3 HAVING avg(coalesce(idf, 0.5)) >= 2.2 AND strlen(any_value(trim(phrase))) >= 10)"""


PHRASE = "ph AS MATERIALIZED (SELECT qid, doc_id, max(CASE WHEN size = 4 THEN 1.25 ELSE 1.15 END)::DOUBLE AS boost FROM wi JOIN body ON contains(body, phrase) AND len(list_filter(words, lambda w: NOT list_contains(terms, w))) = 0 GROUP BY 1, 2)"
TEXT_BODY = f"body AS MATERIALIZED (SELECT doc_id, lower(text) AS body, list_distinct({w1('text')}) AS terms FROM documents)"
NORM_BODY = f"body AS MATERIALIZED (SELECT doc_id, {norm('text')} AS body, list_distinct({w2('text')}) AS terms FROM documents)"

HITS = """
    ht AS MATERIALIZED (SELECT qid, doc_id, count(*) AS n_hit, sum(coalesce(idf, 0.5)) AS o_sum, sum(CASE WHEN coalesce(idf, 0) > 2.5 THEN ln(1 + tf) * coalesce(idf, 0.5) ELSE 0 END) AS entity,
           sum(CASE WHEN coalesce(idf, 0) > 2.5 THEN 0 ELSE ln(1 + tf) * coalesce(idf, 0.5) END) AS common FROM e JOIN dt USING (term) GROUP BY 1, 2),
    qs AS (SELECT qid, avg(coalesce(idf, 0.5)) AS q_mean, count(*) AS q_terms FROM e GROUP BY 1)"""

# a query that shares a word with no document is scored against all of them
CANDIDATES = """
    cd AS (SELECT qid, doc_id, coalesce(n_hit, 0) AS n_hit, coalesce(o_sum, 0) AS o_sum, coalesce(entity, 0) AS entity, coalesce(common, 0) AS common, n_terms
           FROM (SELECT qid, doc_id, n_terms FROM q, dl) LEFT JOIN ht USING (qid, doc_id) WHERE n_hit > 0 OR qid NOT IN (SELECT qid FROM ht)),
    av AS (SELECT qid, greatest(avg(n_terms), 1.0) AS average FROM cd GROUP BY 1)"""

ALPHA_SQL = "(CASE WHEN n_hit = 0 THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - (o_sum / n_hit) / greatest(q_mean, 0.001))) END)"
RATIO = "least(1.0, (0.7 * entity + 0.3 * common) / 10)"
LEX = f"({RATIO} * (1 + {RATIO} * {RATIO}) / greatest(0.5, 0.65 + 0.35 * n_terms / average))"

HYBRID_T = f"""SELECT qid, doc_id, CASE WHEN x.doc_id IS NOT NULL THEN 1.0 ELSE {ALPHA_SQL} * coalesce(s.score, 0) + (1 - {ALPHA_SQL}) * {LEX} * coalesce(boost, 1.0) END AS score
    FROM cd JOIN av USING (qid) JOIN qs USING (qid) LEFT JOIN ({DENSE}) s USING (qid, doc_id) LEFT JOIN ph USING (qid, doc_id) LEFT JOIN ({EXACT}) x USING (qid, doc_id)"""


def legacy(alpha: str) -> str:
    return f"""SELECT qid, doc_id, CASE WHEN x.doc_id IS NOT NULL THEN 1.0 ELSE {alpha} * coalesce(s.score, 0) + (1 - {alpha}) * coalesce(o.score, 0) END AS score
    FROM cd JOIN qs USING (qid) LEFT JOIN ({DENSE}) s USING (qid, doc_id) LEFT JOIN ({OVERLAP}) o USING (qid, doc_id) LEFT JOIN ({EXACT}) x USING (qid, doc_id)"""


def density(pairs: str) -> str:
    """(qid, doc_id, density): every occurrence closes a span that goes back to the last one of each word."""
    clean = "lower(regexp_replace(regexp_replace(x, '^[^\\p{L}\\p{N}]+', ''), '[^\\p{L}\\p{N}]+$', ''))"
    return f"""
    tp AS MATERIALIZED (SELECT doc_id, {clean} AS term, pos FROM (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS pos FROM (SELECT doc_id, {spaced(norm("text"))} AS w FROM documents))),
    oc AS MATERIALIZED (SELECT p.qid, p.doc_id, e.term, pos, coalesce(idf, 0.5) AS w FROM ({pairs}) p JOIN e ON e.qid = p.qid JOIN tp ON tp.doc_id = p.doc_id AND tp.term = e.term WHERE p.qid IN (SELECT qid FROM e GROUP BY 1 HAVING count(*) >= 2)),
    ac AS (SELECT qid, doc_id, count(*) AS n, sum(w) AS w FROM (SELECT DISTINCT qid, doc_id, term, w FROM oc) GROUP BY 1, 2 HAVING count(*) >= 2),
    gr AS (SELECT g.qid, g.doc_id, g.pos, o.pos AS last FROM (SELECT a.qid, a.doc_id, a.pos, t.term FROM (SELECT DISTINCT qid, doc_id, pos FROM oc) a JOIN (SELECT DISTINCT qid, doc_id, term FROM oc) t ON a.qid = t.qid AND a.doc_id = t.doc_id) g
           ASOF LEFT JOIN oc o ON o.qid = g.qid AND o.doc_id = g.doc_id AND o.term = g.term AND g.pos >= o.pos),
    sp AS (SELECT qid, doc_id, min(span) AS span FROM (SELECT qid, doc_id, pos, pos - min(last) + 1 AS span, count(last) AS n FROM gr GROUP BY 1, 2, 3) g JOIN ac USING (qid, doc_id) WHERE g.n = ac.n GROUP BY 1, 2),
    dn AS MATERIALIZED (SELECT qid, doc_id, pow(w, 1.5) / (ln(greatest(1, span)) + 1) AS density FROM sp JOIN ac USING (qid, doc_id))"""


def hybrid_q(queries: str = "q") -> str:
    talk = "CASE WHEN dialogue AND len(list_filter(speakers, lambda w: list_contains(terms, lower(w)))) > 0 THEN 1.15 ELSE 1.0 END"
    weight = f"least(1.0, {ALPHA_SQL} + CASE WHEN dialogue THEN 0.35 ELSE 0 END)"
    return f"""
    sd AS (SELECT qid, q_mean, q_mean < 2.2 AND q_terms > 4 AS dialogue, list_filter({spaced("text")}, lambda w: strlen(w) >= 3 AND regexp_matches(w[1], '\\p{{Lu}}')) AS speakers FROM qs JOIN q USING (qid)),
    pr AS (SELECT q.qid, dl.doc_id, n_terms, (SELECT greatest(avg(n_terms), 1.0) FROM dl) AS average, q.text FROM {queries} q, dl),
    bs AS MATERIALIZED (SELECT pr.qid, pr.doc_id, CASE WHEN contains(body, lower(pr.text)) THEN 1.0 WHEN n_hit IS NULL THEN 0.0
           ELSE ({weight} * coalesce(greatest(0.0, 1 - dist / 64.0), 0) + (1 - {weight}) * {LEX} * coalesce(boost, 1.0)) * {talk} END AS base
           FROM pr JOIN body ON pr.doc_id = body.doc_id LEFT JOIN ht ON pr.qid = ht.qid AND pr.doc_id = ht.doc_id LEFT JOIN sd ON pr.qid = sd.qid LEFT JOIN ham ON pr.qid = ham.qid AND pr.doc_id = ham.doc_id LEFT JOIN ph ON pr.qid = ph.qid AND pr.doc_id = ph.doc_id),
    {density("SELECT bs.qid, bs.doc_id FROM bs WHERE base > 0")},
    fq AS (SELECT bs.qid, bs.doc_id, base * (1 + 0.25 * coalesce(density, 0)) AS score FROM bs LEFT JOIN dn ON bs.qid = dn.qid AND bs.doc_id = dn.doc_id)"""


def keywords(x: str, least: int) -> str:
    digit = " OR regexp_matches(w, '[0-9]')" if least <= 2 else ""
    return f"list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: (strlen(w) >= {least}{digit}) AND w NOT IN ({_list(tx.KEYWORD_STOPWORDS)}) AND w <> '')"


def _keys(values) -> str:
    return f"(SELECT unnest([{_list(values)}]) AS key)"


def _kv() -> str:
    connectors = "|".join(sorted(tx.CONNECTORS, key=lambda w: (-len(w), w)))
    # no lookahead here: a connecting word is one that a character other than a letter or digit, put at the end too, follows
    after = "substr(text, instr(lower(text), lower(key)) + length(key))"
    space = r"[\s\x{0B}\x{85}\p{Z}]"
    trim = rf"^{space}+|{space}+$"
    step = f"CASE WHEN regexp_matches(r, '^(?:{space}|[:=])') THEN substr(r, 2) WHEN regexp_matches(lower(r) || ' ', '^(?:{connectors})[^\\p{{L}}\\p{{N}}]') THEN substr(r, length(regexp_extract(lower(r) || ' ', '^({connectors})[^\\p{{L}}\\p{{N}}]', 1)) + 1) ELSE r END"
    return f"""WITH found AS (SELECT key, doc_id, {after} AS r FROM documents d, {_keys(KEYS)} k WHERE contains(lower(text), lower(key)) AND len(list_filter({w1("key")}, lambda w: NOT list_contains({w1("text")}, w))) = 0),
    s1 AS (SELECT key, doc_id, {step} AS r FROM found), s2 AS (SELECT key, doc_id, {step} AS r FROM s1), s3 AS (SELECT key, doc_id, {step} AS r FROM s2),
    cut AS (SELECT key, doc_id, regexp_replace(regexp_extract(regexp_replace(r, '^(?:{space}|[:=])*', ''), '^[^,;\\n\\r]*'), '{trim}', '', 'g') AS value FROM s3) SELECT key, doc_id, value FROM cut WHERE value <> ''"""


def identifiers() -> str:
    edge = r"""[.,;:!?()\[\]{}"'']+"""
    n = lambda p: f"length(regexp_replace(w, '{p}', '', 'g'))"
    return f"""WITH words AS (SELECT doc_id, i, regexp_replace(regexp_replace(x, '^{edge}', ''), '{edge}$', '') AS w FROM (SELECT doc_id, unnest(l) AS x, unnest(range(0, len(l))) AS i FROM (SELECT doc_id, string_split_regex(text, '{SP}') AS l FROM documents))),
    sized AS (SELECT *, {n("[^\\p{Lu}]")} AS u, {n("[^0-9]")} AS g, {n("[^\\p{L}]")} AS a, strlen(w) AS b FROM words),
    good AS (SELECT * FROM sized WHERE a + g > 0 AND ((b >= 5 AND (u / (a + g) > 0.5 OR (g / (a + g) > 0.1 AND u / (a + g) > 0.2) OR g / (a + g) > 0.3 OR (regexp_matches(w, '[-_]') AND b >= 7))) OR (b >= 4 AND g / (a + g) > 0.8)))
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS pos, w AS identifier FROM good"""


SPACE1 = r"[\s\x{0B}\x{85}\p{Z}]"


def _trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE1}+|{SPACE1}+$', '', 'g')"


def p1() -> str:
    return f"""WITH cut AS (SELECT doc_id, list_filter(list_transform(range(0, length(text), 256), lambda i: substr(text, i + 1, 512)), lambda p: strlen({_trimmed("p")}) >= 50) AS l, text FROM documents),
    ps AS (SELECT doc_id, CASE WHEN len(l) > 0 THEN l ELSE [substr(text, 1, 512)] END AS l FROM cut)
    SELECT doc_id, CAST(i AS INT) AS passage_idx, md5(p) AS digest, CAST(length(p) AS INT) AS n_chars FROM (SELECT doc_id, unnest(l) AS p, unnest(range(0, len(l))) AS i FROM ps)"""


def p2() -> str:
    return f"""WITH plain AS (SELECT doc_id, regexp_replace(text, '<[^>]+>', ' ', 'g') AS t FROM documents),
    sampled AS (SELECT doc_id, CASE WHEN length(t) > 8000 THEN concat_ws(' ', substr(t, 1, 2000), substr(t, length(t) // 4 + 1, 2000),
        substr(t, length(t) * 3 // 4 - 1000 + 1, least(length(t) * 3 // 4 + 1000, length(t)) - (length(t) * 3 // 4 - 1000)), substr(t, length(t) - 2000 + 1, 2000)) ELSE t END AS t FROM plain),
    cut AS (SELECT doc_id, list_filter(list_transform(range(0, length(t), 1000), lambda i: {_trimmed("substr(t, i + 1, 2000)")}), lambda p: strlen(p) >= 100) AS l, t FROM sampled),
    ps AS (SELECT doc_id, CASE WHEN len(l) > 0 THEN l ELSE [substr(t, 1, 2000)] END AS l FROM cut)
    SELECT doc_id, CAST(i AS INT) AS passage_idx, md5(p) AS digest, CAST(length(p) AS INT) AS n_chars FROM (SELECT doc_id, unnest(l) AS p, unnest(range(0, len(l))) AS i FROM ps)"""


METRICS = f"""
    rl AS (SELECT qid, doc_id, 1.0 AS rel FROM ({EXACT})),
    ri AS (SELECT qid, sum(CASE WHEN r <= {K} THEN rel / log2(r + 1) ELSE 0 END) AS idcg, count(*) AS n_rel FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY doc_id) AS r FROM rl) GROUP BY 1),
    gt AS (SELECT r.qid, rank, rel, count(*) OVER (PARTITION BY r.qid ORDER BY rank) AS seen FROM rk r JOIN rl ON r.qid = rl.qid AND r.doc_id = rl.doc_id),
    gs AS (SELECT qid, sum(rel / log2(rank + 1)) AS dcg, sum(seen / rank) AS ap, min(rank) AS first_, count(*) AS found FROM gt GROUP BY 1),
    mt AS (SELECT ri.qid, coalesce(dcg / idcg, 0) AS ndcg, coalesce(ap / least(n_rel, {K}), 0) AS ap, coalesce(1 / first_, 0) AS rr, coalesce(found / n_rel, 0) AS recall, coalesce(found / {K}.0, 0) AS precision FROM ri LEFT JOIN gs USING (qid))"""


def _pattern(x: str, words: int) -> str:
    return f"list_transform(range(0, {words}), lambda i: ('0x' || substr(md5({x} || ':' || CAST(i AS VARCHAR)), 1, 15))::BIGINT)"


ATTRIBUTES = "attr AS (SELECT doc_id, 'lang' AS key, lang AS value FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents UNION ALL SELECT doc_id, 'size', CAST(length(CAST(n_chars AS VARCHAR)) AS VARCHAR) FROM documents)"


def memory(words: int) -> str:
    return f"""{ATTRIBUTES},
    pt AS MATERIALIZED (SELECT name, {_pattern("name", words)} AS p FROM (SELECT key AS name FROM attr UNION SELECT value FROM attr)),
    bw AS (SELECT doc_id, i, xor(k.p[i + 1], v.p[i + 1]) AS w FROM attr JOIN pt k ON k.name = key JOIN pt v ON v.name = value, range(0, {words}) r(i)),
    mb AS (SELECT doc_id, i, b, CASE WHEN sum((w >> b) & 1) > count(*) // 2 THEN (1::BIGINT << b) ELSE 0 END AS w FROM bw, range(0, 60) r2(b) GROUP BY 1, 2, 3),
    me AS MATERIALIZED (SELECT doc_id, i, sum(w)::BIGINT AS w FROM mb GROUP BY 1, 2)"""


def _similar(words: int) -> str:
    return f"1 - sum(bit_count(xor(a.w, b.w))) / ({words} * 60.0)"


def _encoded(texts: str, name: str = "") -> str:
    """``ev`` (doc_id, c, i, x): 64 values of every text's chunks, by the leading 64 bits of the words' MD5."""
    n, v = name, f"CAST('0x' || substr(md5(w), 1, 16) AS UBIGINT)"
    return f"""{n}tx AS (SELECT doc_id, text, floor(len({spaced("text")}) * 1.3::DOUBLE) > 512 AS long_ FROM ({texts})),
    {n}ch AS MATERIALIZED (SELECT doc_id, c, CASE WHEN long_ THEN substr(text, c * 2048 + 1, 2048) ELSE text END AS t FROM (SELECT *, unnest(range(0, CASE WHEN long_ THEN (length(text) + 2047) // 2048 ELSE 1 END)) AS c FROM {n}tx)),
    {n}hv AS (SELECT doc_id, c, CAST({v} % 64 AS INT) AS i, sum(CASE WHEN {v} >= 9223372036854775808::UBIGINT THEN 1.0::DOUBLE ELSE -1.0 END) AS x FROM (SELECT doc_id, c, unnest({spaced("lower(t)")}) AS w FROM {n}ch) GROUP BY 1, 2, 3),
    {n}nm AS (SELECT doc_id, c, sqrt(sum(x * x)) AS z FROM {n}hv GROUP BY 1, 2),
    {n}ev AS MATERIALIZED (SELECT k.doc_id, k.c, k.i, coalesce(x / greatest(z, 1e-12), 0.0) AS x FROM (SELECT doc_id, c, unnest(range(0, 64)) AS i FROM {n}ch) k LEFT JOIN {n}hv h ON h.doc_id = k.doc_id AND h.c = k.c AND h.i = k.i LEFT JOIN {n}nm m ON m.doc_id = k.doc_id AND m.c = k.c)"""


def unified_parts() -> tuple[str, str]:
    """The tables that a search by routes needs, and the search."""
    extra = f"SELECT qid + 1000000 AS qid, CASE WHEN qid % 2 = 0 THEN 'serial ' ELSE '84729 ' END || ({spaced('text')})[5] AS text FROM q WHERE qid < 6"
    sets = f"{base()}, qx AS (SELECT * FROM q UNION ALL {extra}), {expansion('qx')}, {analysis('qx')}".replace("JOIN q USING (qid)", "JOIN qx USING (qid)")
    hybrid = f"{HITS}, {windows()}, {NORM_BODY}, {PHRASE}, {VEC}, {SIGNS}, {hybrid_q('qx')}".replace("FROM qs JOIN q USING", "FROM qs JOIN qx USING").replace("FROM q)", "FROM qx)")
    with_ = f"WITH {sets}, {hybrid}, lx AS ({top(OVERLAP)}), hy AS ({top('SELECT * FROM fq')})"
    return with_, "SELECT lx.*, 'PureLexical' AS route FROM lx JOIN an USING (qid) WHERE an.route = 'PureLexical' UNION ALL SELECT hy.*, 'FullHybrid' FROM hy JOIN an USING (qid) WHERE an.route = 'FullHybrid'"


def _fusion() -> str:
    return f"""la AS (SELECT qid, doc_id, round(score, 6) AS sa FROM ({OVERLAP})), lb AS (SELECT qid, doc_id, round(score, 6) AS sb FROM ({DENSE})),
    both_ AS (SELECT qid, doc_id, sa, coalesce(sb, 0.5) AS sb FROM la LEFT JOIN lb USING (qid, doc_id))"""


def _confidence(column: str, source: str) -> str:
    return f"""SELECT qid, CASE WHEN s <= 0 THEN 0.0 WHEN n = 1 THEN 1.0 ELSE 1 - h / ln(n) END AS confidence FROM (SELECT qid, count(*) AS n, sum(x) AS s, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) AS h
    FROM (SELECT qid, {column} AS x, {column} / sum({column}) OVER (PARTITION BY qid) AS p FROM {source}) GROUP BY 1)"""


def _minmax(column: str, source: str) -> str:
    return f"SELECT qid, doc_id, {column} AS score, CASE WHEN hi - lo <= 1e-6 THEN 0.5 ELSE ({column} - lo) / (hi - lo) END AS norm FROM (SELECT *, min({column}) OVER (PARTITION BY qid) AS lo, max({column}) OVER (PARTITION BY qid) AS hi FROM {source})"


def truncated(dim: int) -> str:
    return f"SELECT doc_id, CAST(i AS INT) AS dim, round(x / greatest(n, 1e-12), 6) AS x FROM (SELECT vec_id AS doc_id, unnest(e) AS x, unnest(range(0, {dim})) AS i, sqrt(list_inner_product(e, e)) AS n FROM (SELECT vec_id, (embedding::DOUBLE[])[1:{dim}] AS e FROM embeddings))"


def oracle_sql() -> dict[str, str]:
    lexical = f"WITH {base()}, {expansion()}"
    vectors = f"WITH {VEC}"
    ranked = f"{lexical}, rk AS ({top(OVERLAP)})"
    w1_, w2_ = w1("text"), w2("text")
    return {
        "tok_w1_counts": f"SELECT doc_id, CAST(len(w) AS INT) AS n, CAST(len(list_distinct(w)) AS INT) AS n_distinct FROM (SELECT doc_id, {w1_} AS w FROM documents)",
        "tok_w2_counts": f"SELECT doc_id, CAST(len(w) AS INT) AS n, CAST(len(list_distinct(w)) AS INT) AS n_distinct, md5(array_to_string(w, '|')) AS digest FROM (SELECT doc_id, {w2_} AS w FROM documents)",
        "normalized_doc_text": f"SELECT doc_id, {norm('text')} AS body FROM documents",
        "stopword_filtered": f"SELECT doc_id, CAST(len(w) AS INT) AS n, CAST(len(list_filter(w, lambda x: x NOT IN ({_list(tx.STOPWORDS)}))) AS INT) AS n_kept FROM (SELECT doc_id, {w1_} AS w FROM documents)",
        "soundex_vocab": f"WITH {base()} SELECT term, sdx FROM {sounded('idf', 'term')}",
        "code_tokens": f"WITH t AS (SELECT unnest({w2_}) AS word FROM documents UNION ALL SELECT unnest([{_list(Q_CODES)}])) SELECT word, count(*) AS n FROM t WHERE {code('word')} GROUP BY 1",
        "identifiers": identifiers(),
        "token_bigrams": f"WITH s AS (SELECT doc_id, list_sort(list_distinct({w1_})) AS s FROM documents), p AS (SELECT s[i] AS a, s[i + 1] AS b FROM (SELECT s, unnest(range(1, len(s))) AS i FROM s)) SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2",
        "token_estimate": f"SELECT doc_id, CAST(greatest(1, floor(len({spaced('text')}) * 1.3::DOUBLE)) AS BIGINT) AS n_tokens FROM documents",
        "strip_html": "SELECT page_id, length(p) AS n_chars, md5(p) AS digest FROM (SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS p FROM pages)",
        "passages_p1": p1(),
        "passages_p2": p2(),
        "super_chunks": "SELECT doc_id, CAST(i AS INT) AS chunk_idx, md5(p) AS digest, CAST(length(p) AS INT) AS n_chars FROM (SELECT doc_id, i, substr(text, i * 2048 + 1, 2048) AS p FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 2047) // 2048)) AS i FROM documents))",
        "fallback_tokens": f"WITH w AS (SELECT item_id AS qid, ({spaced('lower(text)')})[1:510] AS w FROM benchmark), t AS (SELECT qid, unnest(list_concat([''], w, [''])) AS word, unnest(range(0, len(w) + 2)) AS pos, len(w) + 1 AS last_ FROM w) "
        "SELECT qid, CAST(pos AS INT) AS pos, CAST(CASE WHEN pos = 0 THEN 101 WHEN pos = last_ THEN 102 ELSE list_reduce(list_prepend(0::BIGINT, list_transform(range(0, strlen(word)), lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::BIGINT)), lambda a, b: (a * 31 + b) % 4294967296) % 29522 + 1000 END AS INT) AS token FROM t",
        "keyword_list": f"SELECT qid, word, count(*) AS n FROM (SELECT item_id AS qid, unnest({keywords('text', 2)}) AS word FROM benchmark) GROUP BY 1, 2",
        "doc_term_tf": f"WITH {base()} SELECT doc_id, term, tf FROM dt",
        "postings_positions": f"SELECT term, doc_id, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM (SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM (SELECT doc_id, {w1_} AS w FROM documents)) GROUP BY 1, 2",
        "prefix_scan": f"WITH {base()} SELECT term, df FROM idf WHERE starts_with(term, 'tion')",
        "word_idf": f"WITH {base()} SELECT term, df, round(idf, 6) AS idf FROM idf",
        "word_idf_text": f"WITH {base('text')} SELECT term, df, round(idf, 6) AS idf FROM idf",
        "word_idf_raw": f"SELECT term, count(*) AS df, round(ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1, 6) AS idf FROM (SELECT unnest(list_distinct(list_filter(string_split_regex(lower(text), '{SP}'), lambda w: strlen(w) >= 3))) AS term FROM documents) GROUP BY 1",
        "doc_gamma": f"WITH {base()} SELECT d.doc_id, round(least(0.3, least(1.0, coalesce(m, 2.5) / 5)), 6) AS gamma FROM documents d LEFT JOIN (SELECT doc_id, sum(coalesce(idf, 0.5) * tf) / sum(tf) AS m FROM dt LEFT JOIN idf USING (term) GROUP BY 1) g ON d.doc_id = g.doc_id",
        "index_stats": f"WITH {base()}, {p1().removeprefix('WITH ').split('SELECT doc_id, CAST(i AS INT)')[0].rstrip()} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT sum(length(text))::BIGINT FROM documents) AS characters, (SELECT sum(len(l))::BIGINT FROM ps) AS passages, (SELECT count(*) FROM dt) AS postings, (SELECT sum(tf)::BIGINT FROM dt) AS words, (SELECT count(DISTINCT term) FROM dt) AS distinct_words",
        "consistency_check": "SELECT count(d.doc_id) AS valid, sum(CASE WHEN d.doc_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing FROM embeddings e LEFT JOIN documents d ON e.vec_id * 3 = d.doc_id",
        "doc_upsert": "WITH n AS (SELECT doc_id * 2 AS doc_id, 'new ' || text AS text FROM documents) SELECT doc_id, md5(text) AS digest FROM n UNION ALL SELECT doc_id, md5(text) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n)",
        "stream_chunks": f"SELECT doc_id, CAST(greatest(1, ceil(length(text) / 2000)) AS INT) AS n_chunks, CAST(len(list_distinct(flatten(list_transform(range(0, length(text), 2000), lambda i: {w1('substr(text, i + 1, 2000)')})))) AS INT) AS n_tokens FROM documents",
        "stream_equals_batch": f"WITH {base()} SELECT doc_id, term, tf FROM dt",
        "query_analysis": f"{lexical}, {analysis()} SELECT * FROM an",
        "fuzzy_expand": f"{lexical} SELECT qid, CAST(pos AS INT) AS pos, word, kind, term FROM ex",
        "query_route": f"{lexical}, {analysis()}, ty AS (SELECT qid, route, CASE WHEN trim(text) = '' THEN 'balanced' WHEN route = 'PureLexical' THEN 'high_lexical' WHEN route = 'PureSemantic' THEN 'pure_semantic' ELSE 'balanced' END AS query_type FROM an JOIN q USING (qid)) SELECT *, (CASE {' '.join(f'WHEN query_type = {_q(k)} THEN {v}' for k, v in ALPHA.items())} ELSE 0.7 END)::DOUBLE AS alpha FROM ty",
        "forced_route": "SELECT 'PureSemantic' AS route, count(*) AS n FROM benchmark",
        "pure_lexical_topk": f"{lexical} {top(OVERLAP)}",
        "exact_search": f"WITH q AS (SELECT item_id AS qid, text FROM benchmark) SELECT *, 1.0::DOUBLE AS score FROM ({EXACT})",
        "count_instances": f"SELECT key, doc_id, (length(t) - length(replace(t, k, ''))) // length(k) AS n FROM (SELECT key, lower(key) AS k, doc_id, lower(text) AS t FROM documents, {_keys(NEEDLES)}) WHERE contains(t, k)",
        "kv_extract": _kv(),
        "context_snippet": f"WITH f AS (SELECT key, min(doc_id) AS doc_id FROM documents, {_keys(KEYS)} WHERE contains(lower(text), lower(key)) GROUP BY 1), a AS (SELECT key, f.doc_id, text, instr(lower(text), lower(key)) AS pos_ FROM f JOIN documents d ON f.doc_id = d.doc_id) SELECT key, doc_id, substr(text, greatest(pos_ - 100, 1), pos_ + length(key) + 100 - greatest(pos_ - 100, 1)) AS snippet FROM a",
        "keyword_overlap": top(f"SELECT qid, doc_id, sum(n)::DOUBLE AS score FROM (SELECT qid, word, count(*) AS n FROM (SELECT item_id AS qid, unnest({keywords('text', 2)}) AS word FROM benchmark) GROUP BY 1, 2) k JOIN documents d ON contains(lower(d.text), word) GROUP BY 1, 2", 100),
        "l2_norm": "SELECT vec_id AS doc_id, round(sqrt(list_inner_product(e, e)), 6) AS norm FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)",
        "matryoshka_16": truncated(16),
        "matryoshka_32": truncated(32),
        "corpus_mean": "SELECT CAST(i AS INT) AS dim, round(avg(x), 6) AS mean FROM (SELECT unnest(embedding::DOUBLE[]) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY 1",
        "dynamic_scale": f"{vectors}, {SCALE} SELECT round(scale, 6) AS scale FROM sc",
        "dense_topk": f"{vectors} {top(DENSE)}",
        "passage_maxsim_dense": f"{vectors} {top('SELECT qid, doc_id // 4 AS doc_id, max(score) AS score FROM (' + DENSE + ') GROUP BY 1, 2')}",
        "similarity_matrix": f"{vectors} SELECT qid, doc_id, round(list_inner_product(q, emb), 6) AS score FROM qv, v",
        "sign_quantize": f"{vectors} SELECT doc_id, list_sum(list_transform(range(0, 64), lambda i: CASE WHEN emb[i + 1] - mean[i + 1] > 0 THEN (CASE WHEN i = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << i) END) ELSE 0::HUGEINT END))::BIGINT AS word FROM v, m",
        "hamming_candidates": f"{vectors}, {SIGNS} SELECT qid, doc_id, dist, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, doc_id) AS INT) AS rank FROM ham) WHERE rank <= 50",
        "hamming_topk": f"{vectors}, {SIGNS} {top('SELECT qid, doc_id, greatest(0.0, 1 - dist / 64.0) AS score FROM ham')}",
        "hamming_16view_topk": f"{vectors}, {SCALE}, vb AS MATERIALIZED (SELECT doc_id, i, {bits('emb', 'mean', '((i / 15.0::DOUBLE - 0.5) * scale)').replace('lambda i:', 'lambda j:').replace('emb[i]', 'emb[j]').replace('mean[i]', 'mean[j]')} AS bits FROM v, m, sc, range(0, 16) r(i)), wb AS MATERIALIZED (SELECT qid, i, {bits('q', 'mean', '((i / 15.0::DOUBLE - 0.5) * scale)').replace('lambda i:', 'lambda j:').replace('q[i]', 'q[j]').replace('mean[i]', 'mean[j]')} AS qbits FROM qv, m, sc, range(0, 16) r(i)) {top('SELECT qid, doc_id, avg(greatest(0.0, 1 - hamming(qbits, bits) / 64.0)) AS score FROM wb JOIN vb USING (i) GROUP BY 1, 2')}",
        "passage_maxsim_hamming": f"{vectors}, {SIGNS} {top('SELECT qid, doc_id // 4 AS doc_id, max(greatest(0.0, 1 - dist / 64.0)) AS score FROM ham GROUP BY 1, 2')}",
        "hybrid_candidates": f"{lexical}, {VEC}, {SIGNS} {top('SELECT qid, doc_id, 0.6 * coalesce(greatest(0.0, 1 - dist / 64.0), 0) + 0.4 * score AS score FROM (' + OVERLAP + ') LEFT JOIN ham USING (qid, doc_id)')}",
        "full_hybrid_t": f"WITH {base('text')}, {expansion()}, {VEC}, {HITS}, {CANDIDATES}, {windows()}, {TEXT_BODY}, {PHRASE} {top('SELECT * FROM (' + HYBRID_T + ') WHERE score > 0')}",
        "legacy_blend": f"WITH {base('text')}, {expansion()}, {VEC}, {HITS}, {CANDIDATES} {top('SELECT * FROM (' + legacy(ALPHA_SQL) + ') WHERE score > 0')}",
        "legacy_alpha": f"WITH {base('text')}, {expansion()}, {VEC}, {HITS}, {CANDIDATES} {top('SELECT * FROM (' + legacy('0.4::DOUBLE') + ') WHERE score > 0')}",
        "full_hybrid_q": f"{lexical}, {HITS}, {windows()}, {NORM_BODY}, {PHRASE}, {VEC}, {SIGNS}, {hybrid_q()} {top('SELECT * FROM fq')}",
        "phrase_boost": f"WITH {base('text')}, {windows()}, {TEXT_BODY}, {PHRASE} SELECT qid, doc_id, boost FROM ph",
        "span_density": f"{lexical}, {density(top(OVERLAP))} SELECT qid, doc_id, round(density, 6) AS density FROM dn",
        "unified_search": " ".join(unified_parts()),
        "minmax_normalize": f"{lexical}, {VEC}, {_fusion()} SELECT qid, doc_id, score, round(norm, 6) AS norm FROM ({_minmax('sa', 'la')})",
        "score_confidence": f"{lexical}, {VEC}, {_fusion()} SELECT qid, round(confidence, 6) AS confidence FROM ({_confidence('sa', 'la')})",
        "confidence_fusion": f"{lexical}, {VEC}, {_fusion()}, ca AS ({_confidence('sa', 'both_')}), cb AS ({_confidence('sb', 'both_')}), na AS ({_minmax('sa', 'both_')}), nb AS ({_minmax('sb', 'both_')}) "
        + top("SELECT na.qid, na.doc_id, CASE WHEN ca.confidence + cb.confidence > 0 THEN ca.confidence / (ca.confidence + cb.confidence) ELSE 0.5 END * na.norm + CASE WHEN ca.confidence + cb.confidence > 0 THEN cb.confidence / (ca.confidence + cb.confidence) ELSE 0.5 END * nb.norm AS score FROM na JOIN nb ON na.qid = nb.qid AND na.doc_id = nb.doc_id JOIN ca ON ca.qid = na.qid JOIN cb ON cb.qid = na.qid"),
        "hdc_bind": f"WITH {ATTRIBUTES}, p AS (SELECT DISTINCT key, value FROM attr) SELECT key, value, CAST(i AS INT) AS i, xor(a[i + 1], b[i + 1]) AS w FROM (SELECT key, value, {_pattern('key', 167)} AS a, {_pattern('value', 167)} AS b FROM p), range(0, 167) r(i)",
        "hdc_bundle": f"WITH {memory(167)} SELECT doc_id, CAST(i AS INT) AS i, w FROM me",
        "hdc_search": f"WITH {memory(167)}, wq(qid, key, value) AS (VALUES (1::BIGINT, 'lang', 'fr'), (2, 'source', 'src3'), (3, 'lang', 'nowhere')), b AS (SELECT qid, i, xor(k.p[i + 1], v.p[i + 1]) AS w FROM wq JOIN pt k ON k.name = key JOIN pt v ON v.name = value, range(0, 167) r(i)) " + top(f"SELECT b.qid, a.doc_id, {_similar(167)} AS score FROM me a JOIN b USING (i) GROUP BY 1, 2"),
        "hdc_extract": f"WITH {memory(167)}, n AS (SELECT DISTINCT lang AS name FROM documents), k AS (SELECT p FROM pt WHERE name = 'lang'), a AS (SELECT doc_id, i, xor(w, k.p[i + 1]) AS w FROM me, k), b AS (SELECT n.name, i, pt.p[i + 1] AS w FROM n JOIN pt ON pt.name = n.name, range(0, 167) r(i)), s AS (SELECT doc_id, name, {_similar(167)} AS score FROM a JOIN b USING (i) GROUP BY 1, 2) SELECT doc_id, name AS value, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, name DESC) AS r FROM s) WHERE r = 1",
        "hdc_recall": f"WITH {memory(167)}, vs AS MATERIALIZED (SELECT doc_id, list(w ORDER BY i) AS v FROM me GROUP BY 1), dv AS MATERIALIZED (SELECT v, min(doc_id) AS qid FROM vs GROUP BY 1), "
        "sm AS MATERIALIZED (SELECT a.qid AS qid, b.qid AS other, 1 - list_sum(list_transform(list_zip(a.v, b.v), lambda z: bit_count(xor(z[1], z[2])))) / (167 * 60.0) AS score FROM dv a, dv b) "
        + top("SELECT sm.qid, vs.doc_id, sm.score FROM sm JOIN dv ON dv.qid = sm.other JOIN vs ON vs.v = dv.v WHERE sm.score >= 0.6"),
        "hdc_query_pattern": f"WITH {base()}, uw AS (SELECT DISTINCT qid, unnest({w2('text')}) AS word FROM q), us AS (SELECT qid, {_pattern('word', 167)} AS p FROM uw WHERE word IN (SELECT term FROM idf)) SELECT qid, CAST(i AS INT) AS i, bit_xor(w) AS w FROM (SELECT qid, unnest(p) AS w, unnest(range(0, 167)) AS i FROM us) GROUP BY 1, 2",
        "hdc_validate": f"""WITH sz AS (SELECT source, lang, CAST(length(CAST(n_chars AS VARCHAR)) AS VARCHAR) AS z FROM documents), pl AS (SELECT DISTINCT source AS mid, lang AS path, 'size' AS scope, z AS range, source || '/' || z AS entity FROM sz),
        pp AS MATERIALIZED (SELECT *, {_pattern("path || '::' || scope || '::' || range", 167)} AS l, {_pattern('entity', 167)} AS e FROM pl),
        ww AS (SELECT mid, i, xor(l[i + 1], e[i + 1]) AS w FROM pp, range(0, 167) r(i)),
        mw AS (SELECT mid, i, sum(w)::BIGINT AS w FROM (SELECT mid, i, b, CASE WHEN sum((w >> b) & 1) > count(*) // 2 THEN (1::BIGINT << b) ELSE 0 END AS w FROM ww, range(0, 60) r2(b) GROUP BY 1, 2, 3) GROUP BY 1, 2),
        mm AS MATERIALIZED (SELECT mid, list(w ORDER BY i) AS v FROM mw GROUP BY 1)
        SELECT mm.mid, path, scope, range, entity, round(1 - list_sum(list_transform(range(1, 168), lambda j: bit_count(xor(xor(v[j], l[j]), e[j])))) / (167 * 60.0), 6) AS score FROM mm, pp""",
        "persist_texts": "SELECT doc_id, md5(text) AS digest, (SELECT count(*) FROM documents WHERE doc_id % 2 = 0) AS n_before FROM documents",
        "half_vectors": "WITH f AS (SELECT vec_id AS doc_id, unnest(e) AS x, unnest(range(0, 32)) AS i FROM (SELECT vec_id, (embedding::DOUBLE[])[1:32] AS e FROM embeddings)), s AS (SELECT doc_id, i, x, pow(2.0::DOUBLE, greatest(floor(log2(greatest(abs(x), 1e-30))), -14) - 10) AS step FROM f) SELECT doc_id, CAST(i AS INT) AS dim, round(round_even(x / step, 0) * step, 6) AS x FROM s",
        "index_reopened": f"{lexical} {top(OVERLAP)}",
        "external_idf": f"{lexical.replace('e AS MATERIALIZED (SELECT qid, term, max(idf) AS idf FROM ex GROUP BY 1, 2)', 'e AS MATERIALIZED (SELECT qid, term, 2 * max(idf) AS idf FROM ex GROUP BY 1, 2)')} {top(OVERLAP)}",
        "keyword_bonus": f"{lexical}, r AS ({top(OVERLAP)}), k AS (SELECT qid, word, count(*) AS n FROM (SELECT qid, unnest({keywords('text', 2)}) AS word FROM q) GROUP BY 1, 2), h AS (SELECT r.qid, r.doc_id, sum(n) AS hits FROM r JOIN k ON k.qid = r.qid JOIN documents d ON d.doc_id = r.doc_id AND contains(lower(d.text), word) GROUP BY 1, 2) {top('SELECT r.qid, r.doc_id, r.score + 0.05 * coalesce(hits, 0) AS score FROM r LEFT JOIN h ON h.qid = r.qid AND h.doc_id = r.doc_id')}",
        "encode_texts": f"WITH {_encoded('SELECT doc_id, text FROM documents')} SELECT doc_id, CAST(c AS INT) AS chunk_idx, CAST(i AS INT) AS dim, round(CAST(x AS FLOAT)::DOUBLE, 6) AS x FROM ev",
        "encoded_search": f"WITH {p1().removeprefix('WITH ').split('SELECT doc_id, CAST(i AS INT)')[0].rstrip()}, {_encoded('SELECT doc_id * 100000 + i AS doc_id, p AS text FROM (SELECT doc_id, unnest(l) AS p, unnest(range(0, len(l))) AS i FROM ps)')}, {_encoded('SELECT item_id AS doc_id, text FROM benchmark', 'q')}, "
        "pv AS MATERIALIZED (SELECT doc_id // 100000 AS doc_id, list(CAST(x AS FLOAT)::DOUBLE ORDER BY i) AS v FROM ev WHERE c = 0 GROUP BY ev.doc_id), qw AS MATERIALIZED (SELECT doc_id AS qid, list(CAST(x AS FLOAT)::DOUBLE ORDER BY i) AS v FROM qev WHERE c = 0 GROUP BY 1) "
        + top("SELECT qid, pv.doc_id, max(greatest(0.0, list_inner_product(qw.v, pv.v))) AS score FROM qw, pv GROUP BY 1, 2"),
        "layer_primitives": "WITH v AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS e FROM embeddings), f AS (SELECT doc_id, unnest(e) AS x, unnest(range(0, len(e))) AS i, list_avg(e) AS m, list_avg(list_transform(e, lambda y: y * y)) AS s, sqrt(list_inner_product(e, e)) AS z FROM v), "
        "g AS (SELECT doc_id, i, unnest(['silu', 'sigmoid', 'elu_plus_one', 'rms_norm', 'layer_norm', 'l2_norm']) AS name, unnest([x / (1 + exp(-x)), 1 / (1 + exp(-x)), CASE WHEN x > 0 THEN x + 1 ELSE exp(x) END, x / sqrt(s + 1e-5), (x - m) / sqrt(s - m * m + 1e-12), x / greatest(z, 1e-12)]) AS x FROM f) SELECT doc_id, name, CAST(i AS INT) AS dim, round(x, 6) AS x FROM g",
        "eval_driver": f"{unified_parts()[0]}, rk AS ({unified_parts()[1]}), {METRICS} SELECT qid, round(ndcg, 6) AS ndcg, round(ap, 6) AS ap, round(rr, 6) AS rr, round(recall, 6) AS recall, round(precision, 6) AS precision FROM mt",
        "eval_top1": f"{ranked}, rl AS ({EXACT}) SELECT a.qid, r.doc_id, rl.doc_id IS NOT NULL AS correct FROM (SELECT DISTINCT qid FROM rl) a LEFT JOIN (SELECT * FROM rk WHERE rank = 1) r ON a.qid = r.qid LEFT JOIN rl ON rl.qid = r.qid AND rl.doc_id = r.doc_id",
        "eval_extended": f"{ranked}, rl AS ({EXACT}), tp AS (SELECT a.qid, r.doc_id, rl.doc_id IS NOT NULL AS correct, want FROM (SELECT qid, min(doc_id) AS want FROM rl GROUP BY 1) a LEFT JOIN (SELECT * FROM rk WHERE rank = 1) r ON a.qid = r.qid LEFT JOIN rl ON rl.qid = r.qid AND rl.doc_id = r.doc_id), "
        f"kw AS (SELECT item_id AS qid, {keywords('text', 4)} AS l FROM benchmark) SELECT qid, tp.doc_id, correct, coalesce(NOT correct AND len(l) > 0 AND len(list_filter(l, lambda w: contains(lower(d.text), w))) >= len(l) // 2 AND len(list_filter(l, lambda w: contains(lower(x.text), w))) >= len(l) // 2, false) AS extended FROM tp LEFT JOIN kw USING (qid) LEFT JOIN documents d ON d.doc_id = tp.doc_id LEFT JOIN documents x ON x.doc_id = want",
        "eval_ndcg_mrr_recall": f"{ranked}, {METRICS} SELECT qid, round(ndcg, 6) AS ndcg, round(ap, 6) AS ap, round(rr, 6) AS rr, round(recall, 6) AS recall, round(precision, 6) AS precision FROM mt",
        "eval_split_means": f"{ranked}, {METRICS} SELECT round(avg(m), 6) AS score FROM (SELECT qid % 3 AS split, avg(ndcg) AS m FROM mt GROUP BY 1)",
        "sts_pearson_spearman": "WITH p AS (SELECT round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS a, abs(a.label - b.label)::DOUBLE AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM p) SELECT count(*) AS n, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM r",
        "scaling_regression": f"SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM (SELECT n_chars::DOUBLE AS x, len({w1_})::DOUBLE AS y FROM documents)",
    }
