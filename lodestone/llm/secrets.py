"""Secret scans by multipart credential linking.

Parts of credentials are found with one alternation of patterns: access identifiers (cloud key ids, e-mail addresses,
labelled user or client ids), secrets (labelled assignments, bearer tokens, JSON web tokens, tokens of known prefixes, private key
blocks, URLs with a password, bare runs of hexadecimal digits, or of letters and digits mixed) and endpoints (URLs of any scheme,
IPv4 addresses, hosts with a port). A strong part (a cloud key id, a labelled assignment, a private key, a token, a URL with a
password) tells by itself.
A weak part is reported only where its complement is within ``window`` characters in the same scope, i.e. the same document:
for a secret an identifier or an endpoint, for an identifier or an endpoint a secret.

The link is an interval join on (scope, bucket of ``window`` characters): each part lies in the buckets it covers and
looks in those its widened interval covers, and a pair counts in the first bucket that it has in common, once. Only
parts are joined, never texts.

No pattern repeats a group without a small bound, and none walks further than a bound before it must match, so a text of any
kind takes time in proportion to its length and a constant stack.

Defined results. A null or empty text has no parts. A host has at most 253 characters and may have dots side by side; a private key at most 8 header lines. Rows repeating both id and text are one scope; rows repeating an id
with another text, and rows with a null id, are scopes of their own. Positions count characters from 0. Values are given by
SHA-256 only. Parts never overlap; at one place the earlier pattern of the list wins. Further columns are ignored by the scan
and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized, written

WINDOW = 256
MARK = "[REDACTED]"


def _mixed(more: str, least: int) -> str:
    """Runs of at least ``least`` letters (``more`` count as such) and digits that have both, walked letter by letter.

    A run's first digit, or its first letter, is among its first ``least`` + 64 characters; of a longer head of one class only that much is taken.
    """
    letter, digit, any_ = f"[A-Za-z{more}]", "[0-9]", f"[A-Za-z0-9{more}]"

    def from_(own: str, other: str) -> str:
        rest = f"{own}{{0,64}}{other}{any_}*"
        for n in range(least - 1, 0, -1):
            rest = f"(?:{other}{any_}{{{least - 1 - n},}}|{own}{rest})"
        return own + rest

    return f"(?:{from_(letter, digit)}|{from_(digit, letter)})"


_SCHEME = r"(?:[Hh][Tt][Tt][Pp][Ss]?|[A-Za-z][A-Za-z0-9+.-]{1,20})://"
#: (kind, role, strong, pattern), the first that matches at a place wins. The patterns mean the same to Java and RE2.
KINDS = (
    ("assignment", "secret", True, r"""(?:[Tt][Oo][Kk][Ee][Nn]|[Ss][Ee][Cc][Rr][Ee][Tt](?:[_-]?[Kk][Ee][Yy])?|[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Pp][Ww][Dd]|[Aa][Pp][Ii][_-]?[Kk][Ee][Yy]|[Aa][Cc][Cc][Ee][Ss][Ss][_-][Kk][Ee][Yy])["']?[ \t]*[=:][ \t]*(?:"[^"\s]{8,}"|'[^'\s]{8,}'|["']?[A-Za-z0-9+/_.~-]{8,}=*["']?)"""),
    ("quoted", "secret", True, r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Pp][Ww][Dd])[ \t]+(?:"[^"\s]{8,}"|'[^'\s]{8,}')"""),
    ("bearer", "secret", True, r"""[Bb][Ee][Aa][Rr][Ee][Rr][ \t]+[A-Za-z0-9+/_.~-]{16,}=*"""),
    ("jwt", "secret", True, r"""eyJ[A-Za-z0-9_-]{8,900}\.[A-Za-z0-9_-]{8,900}\.[A-Za-z0-9_-]+"""),
    ("token", "secret", True, r"""gh[pousr]_[A-Za-z0-9]{36,}"""),
    ("private_key", "secret", True, r"""-----BEGIN [A-Z ]*PRIVATE KEY-----(?:\s{0,8}[A-Za-z][A-Za-z0-9-]{0,63}:[^\r\n]*[\r\n]+){0,8}[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?"""),
    ("cloud_key_id", "identifier", True, r"""(?:AKIA|ASIA)[0-9A-Z]{16}"""),
    ("url_password", "secret", True, _SCHEME + r"""[^\s/:@"'<>]*:[^\s/@"'<>]+@[^\s"'<>]+"""),
    ("url", "endpoint", False, _SCHEME + r"""[^\s"'<>]+"""),
    ("email", "identifier", False, r"""[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}\.[A-Za-z0-9.-]{0,189}[A-Za-z0-9-]"""),
    ("account", "identifier", False, r"""(?:[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Uu][Ss][Ee][Rr](?:_?[Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt](?:_?[Ii][Dd])?)["']?[ \t]*[=:][ \t]*["']?[A-Za-z0-9_.-]{3,64}"""),
    ("ipv4", "endpoint", False, r"""[0-9]{1,3}(?:\.[0-9]{1,3}){3}"""),
    ("host_port", "endpoint", False, r"""(?:localhost|[A-Za-z0-9-]{1,63}\.[A-Za-z0-9.-]{0,189}[A-Za-z0-9-]):[0-9]{2,5}"""),
    ("hex", "secret", False, r"""[0-9a-f]{32,}|[0-9A-F]{32,}"""),
    ("base64", "secret", False, _mixed("+/", 32)),
    ("alphanumeric", "secret", False, _mixed("", 20)),
)
PATTERN = "|".join(f"(?:{p})" for *_, p in KINDS)
#: Every part has one of these; most texts have none and are passed over by this one look.
HINT = r"[@=:]|AKIA|ASIA|-----BEGIN|[0-9]\.[0-9]|[A-Za-z0-9+/]{20}|[Bb][Ee][Aa][Rr][Ee][Rr][ \t]|gh[pousr]_|eyJ|[Pp][Aa][Ss][Ss][Ww]|[Pp][Ww][Dd]"


def scope_key(id_col: str, text_col: str) -> Column:
    """128 bits of id and text."""
    return F.struct(F.xxhash64(F.col(id_col), F.col(text_col)).alias("one"), F.xxhash64(F.lit(1), F.col(text_col), F.col(id_col)).alias("two"))


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(scope, doc_id, kind, role, strong, start_at, end_at, fingerprint): all parts, strong or weak."""
    text = docs.filter(F.col(text_col).rlike(HINT)).select(scope_key(id_col, text_col).alias("scope"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    cut = text.select("scope", "doc_id", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("found"), F.split("text", PATTERN, -1).alias("between")).filter(F.size("found") > 0)
    each = cut.select("scope", "doc_id", F.posexplode(F.arrays_zip(F.col("found").alias("value"), F.transform("between", F.length).alias("gap"))).alias("i", "p")).filter("p.value is not null")
    each = each.select("scope", "doc_id", "i", F.col("p.value").alias("value"), F.col("p.gap").alias("gap")).dropDuplicates(["scope", "i"])
    # a part begins after all that is before it: the texts between, and the parts before it
    before = Window.partitionBy("scope").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.col("value")
    flat = each.withColumn("start_at", (F.sum(F.col("gap") + F.length("value")).over(before) - F.length("value")).cast("int"))
    kind = F.when(F.lit(False), F.lit(""))
    for name, _, _, pattern in KINDS:
        kind = kind.when(value.rlike(f"^(?:{pattern})$"), F.lit(name))
    flat = flat.select("scope", "doc_id", kind.alias("kind"), "start_at", (F.col("start_at") + F.length(value)).alias("end_at"), F.sha2(value, 256).alias("fingerprint"))
    role, strong = F.when(F.lit(False), F.lit("")), F.lit(False)
    for name, what, sure, _ in KINDS:
        role = role.when(F.col("kind") == name, F.lit(what))
        strong = strong | (F.lit(sure) & (F.col("kind") == name))
    return flat.select("scope", "doc_id", "kind", role.alias("role"), strong.alias("strong"), "start_at", "end_at", "fingerprint")


def link(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """Parts to report, with how many complements are within ``window`` and how far the nearest is."""
    low, high = F.floor((F.col("start_at") - window) / window), F.floor((F.col("end_at") + window) / window)
    left = found.select("scope", "role", "start_at", "end_at", low.alias("low"), F.explode(F.sequence(low, high)).alias("bucket"))
    first, last = F.floor(F.col("start_at") / window), F.floor(F.col("end_at") / window)
    right = found.select("scope", F.col("role").alias("r"), F.col("start_at").alias("s"), F.col("end_at").alias("e"), first.alias("first"), F.explode(F.sequence(first, last)).alias("bucket"))
    gap = F.greatest(F.col("s") - F.col("end_at"), F.col("start_at") - F.col("e"), F.lit(0))
    met = left.join(right, ["scope", "bucket"]).filter((F.col("role") == "secret") != (F.col("r") == "secret")).filter(F.col("bucket") == F.greatest("low", "first"))
    met = met.withColumn("gap", gap).filter(F.col("gap") <= window).groupBy("scope", "start_at").agg(F.count(F.lit(1)).alias("n_linked"), F.min("gap").cast("int").alias("nearest_gap"))
    out = found.join(met, ["scope", "start_at"], "left").withColumn("n_linked", F.coalesce("n_linked", F.lit(0).cast("bigint")))
    return out.filter(F.col("strong") | (F.col("n_linked") > 0))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, kind, role, strong, start_at, end_at, fingerprint, n_linked, nearest_gap): the reported parts."""
    found, _ = written(parts(docs, id_col, text_col), "parts")
    return link(found, window).select("doc_id", "kind", "role", "strong", "start_at", "end_at", "fingerprint", "n_linked", "nearest_gap")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", window: int = WINDOW) -> DataFrame:
    """``docs`` with every reported part replaced by ``MARK`` and, if there is such a column, the new length."""
    found, _ = written(parts(docs, id_col, text_col), "parts")
    spans = link(found, window).groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("start_at", "end_at"))).alias("_lodestone_spans")).withColumnRenamed("scope", "_lodestone_scope")
    spans = sized(spans, "spans")
    joined = docs.withColumn("_lodestone_scope", scope_key(id_col, text_col)).join(spans, "_lodestone_scope", "left")
    s, text = F.col("_lodestone_spans"), F.col(text_col)
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(s, i - 1)["end_at"])
    end = lambda i: F.coalesce(F.get(s, i)["start_at"], F.length(text))
    clean = F.when(s.isNull(), text).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.size(s)), lambda i: F.substring(text, begin(i) + 1, end(i) - begin(i))), MARK))
    out = joined.withColumn("_lodestone_clean", clean)
    columns = []
    for c, kind in docs.dtypes:
        if c == text_col:
            columns.append(F.col("_lodestone_clean").alias(c))
        elif c == length_col:
            columns.append(F.when(s.isNull(), F.col(c)).otherwise(F.length("_lodestone_clean")).cast(kind).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return out.select(*columns)


def oracle_sql(window: int = WINDOW) -> str:
    """The scan of ``documents`` in DuckDB's SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    kind = " ".join(f"WHEN regexp_full_match(value, {quote(p)}) THEN '{k}'" for k, _, _, p in KINDS)
    role = " ".join(f"WHEN kind = '{k}' THEN '{r}'" for k, r, _, _ in KINDS)
    strong = ", ".join(f"'{k}'" for k, _, s, _ in KINDS if s)
    return f"""
    WITH cut AS (SELECT doc_id, regexp_extract_all(text, {quote(PATTERN)}) AS found, string_split_regex(text, {quote(PATTERN)}) AS between_parts FROM documents),
    parted AS (SELECT doc_id, unnest(range(1, len(found) + 1)) AS i, found, between_parts FROM cut WHERE len(found) > 0),
    placed AS (SELECT doc_id, found[i] AS value, CAST(list_sum(list_transform(between_parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS INT) AS start_at FROM parted),
    kinds AS (SELECT doc_id, value, start_at, CAST(start_at + length(value) AS INT) AS end_at, CASE {kind} END AS kind FROM placed),
    parts AS (SELECT *, CASE {role} END AS role, kind IN ({strong}) AS strong, sha256(value) AS fingerprint FROM kinds),
    links AS (SELECT a.doc_id, a.start_at, count(*) AS n_linked, CAST(min(greatest(b.start_at - a.end_at, a.start_at - b.end_at, 0)) AS INT) AS nearest_gap
              FROM parts a JOIN parts b ON a.doc_id = b.doc_id AND (a.role = 'secret') <> (b.role = 'secret') AND greatest(b.start_at - a.end_at, a.start_at - b.end_at, 0) <= {window} GROUP BY 1, 2)
    SELECT p.doc_id, kind, role, strong, p.start_at, end_at, fingerprint, coalesce(n_linked, 0) AS n_linked, nearest_gap
    FROM parts p LEFT JOIN links l ON p.doc_id = l.doc_id AND p.start_at = l.start_at WHERE strong OR n_linked > 0"""
