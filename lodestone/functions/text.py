"""Tokenizers and scalar text functions as column expressions: JVM-side, no Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
TRAILING_PUNCTUATION = r"[!-/:-@\[-`{-~]+$"
STOPWORDS = tuple(
    "what when where which who why how the they them their known that this with from have been were being for was and are is his her she he "
    "a an of to in it on at by as or be do did does has had its".split()
)
#: The shorter list of the keyword operators.
KEYWORD_STOPWORDS = STOPWORDS[:29]
CONNECTORS = tuple("is are was were be been being the a an of to in on at by for with from and or as that which equals".split())
CODE_INTENT = ("passkey", "password", "passcode", "serial", "needle")
COMPOUNDS = {"passkey": ("pass", "key"), "passcode": ("pass", "code"), "password": ("pass", "word")}
_UNITS = "kg km cm mm ml mg gb mb kb hz bn mn bln".split()


def words(text: Column) -> Column:
    """W1: all runs of word characters, lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def space_words(text: Column) -> Column:
    """Pieces between white space, in order, as they are."""
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def _strip(word: Column) -> Column:
    return F.regexp_replace(word, TRAILING_PUNCTUATION, "")


def _long(word: Column) -> Column:
    return F.octet_length(word) >= 3


def terms(text: Column) -> Column:
    """W2, also the query tokenizer: lower-case pieces between white space without their trailing ASCII punctuation, of 3 bytes or more."""
    return F.filter(F.transform(F.split(F.lower(text), SPACE, -1), _strip), _long)


def normalized_text(text: Column) -> Column:
    """The pieces of 3 bytes or more, without trailing punctuation, joined by single spaces."""
    return F.array_join(F.transform(F.filter(F.split(F.lower(text), SPACE, -1), _long), _strip), " ")


def without_stopwords(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(*STOPWORDS))


def soundex(word: Column) -> Column:
    """The phonetic code: first character, then digits of letters that differ from the letter just before; 4 bytes, zero padded.

    Unlike the usual code, h and w separate like vowels, and a first letter of two bytes leaves room for two digits.
    """
    upper = F.upper(word)
    first = F.substring(upper, 1, 1)
    codes = F.translate(F.regexp_replace(upper, "[^BFPVCGJKQSXZDTLMNR]", "0"), "BFPVCGJKQSXZDTLMNR", "111122222222334556")
    runs = F.regexp_replace(codes, r"([0-9])\1+", "$1")
    digits = F.regexp_replace(F.substring(runs, 2, 1 << 30), "0", "")
    room = F.greatest(F.lit(4) - F.octet_length(first), F.lit(0))
    return F.when(word == "", "0000").otherwise(F.concat(first, F.rpad(F.substring(digits, F.lit(1), room), room, F.lit("0"))))


def is_code(word: Column) -> Column:
    """A code of 5 to 10 digits: no date, amount, ordinal, measure or letter."""
    clean = F.regexp_replace(word, r"[^\p{L}\p{N}]", "")
    digits = F.length(F.regexp_replace(clean, "[^0-9]", ""))
    return (
        ~word.rlike(r"[/\-$€£,±×÷]|^[(\[]")
        & F.octet_length(clean).between(5, 15)
        & ~F.lower(clean).rlike("^[0-9]+(?:st|nd|rd|th)$|^[0-9]*(?:" + "|".join(_UNITS) + ")$")
        & ~clean.rlike("[A-Za-z]")
        & digits.between(5, 10)
    )


def identifiers(text: Column) -> Column:
    """Words that look like identifiers by their share of capitals and digits, or by dashes and underscores."""
    edge = r"""[.,;:!?()\[\]{}"']+"""
    clean = F.transform(F.split(text, SPACE, -1), lambda w: F.regexp_replace(w, f"^{edge}|{edge}$", ""))

    def wanted(w: Column) -> Column:
        upper, digit, alpha = (F.length(F.regexp_replace(w, p, "")) for p in (r"[^\p{Lu}]", "[^0-9]", r"[^\p{L}]"))
        size, bytes_ = (alpha + digit).cast("double"), F.octet_length(w)
        shape = (upper / size > 0.5) | ((digit / size > 0.1) & (upper / size > 0.2)) | (digit / size > 0.3) | (w.rlike("[-_]") & (bytes_ >= 7))
        return (alpha + digit > 0) & (((bytes_ >= 5) & shape) | ((bytes_ >= 4) & (digit / size > 0.8)))

    return F.filter(clean, wanted)


def sorted_bigrams(tokens: Column) -> Column:
    """Neighbours in the sorted set of tokens, as structs (a, b)."""
    s = F.array_sort(F.array_distinct(tokens))
    n = F.size(s)
    # two shifted copies: an index into the sorted set would sort it again for every pair
    pairs = F.zip_with(F.slice(s, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(s, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.when(n >= 2, pairs).otherwise(F.array().cast("array<struct<a:string,b:string>>"))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.size(space_words(text)) * 1.3)).cast("bigint")


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", " ")


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _cut(text: Column, size: int, stride: int) -> Column:
    n = F.length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(stride)), lambda i: F.substring(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def passages_p1(text: Column, size: int = 512, stride: int = 256, least: int = 50) -> Column:
    """Overlapping passages whose trimmed text has at least ``least`` bytes; if none, the first one."""
    kept = F.filter(_cut(text, size, stride), lambda p: F.octet_length(_trim(p)) >= least)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.substring(text, 1, size)))


def passages_p2(text: Column, max_chars: int = 8000, size: int = 2000, stride: int = 1000, least: int = 100) -> Column:
    """Trimmed passages of the text without tags; of a text over ``max_chars`` four samples of it are cut."""
    plain = strip_html(text)
    n, quarter = F.length(plain), max_chars // 4
    center = F.floor(n * 3 / 4).cast("int")
    low = F.greatest(center - quarter // 2, F.lit(0))
    samples = F.concat_ws(
        " ", F.substring(plain, 1, quarter), F.substring(plain, F.floor(n / 4).cast("int") + 1, F.lit(quarter)),
        F.substring(plain, low + 1, F.least(center + quarter // 2, n) - low), F.substring(plain, F.greatest(n - quarter, F.lit(0)) + 1, F.lit(quarter)),
    )
    sampled = F.when(n > max_chars, samples).otherwise(plain)
    if size == 0 or stride == 0:
        return F.array(F.substring(sampled, 1, min(max_chars, 2000)))
    kept = F.filter(F.transform(_cut(sampled, size, stride), _trim), lambda p: F.octet_length(p) >= least)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.substring(sampled, 1, size)))


def super_chunks(text: Column, max_tokens: int = 512) -> Column:
    """Consecutive chunks of ``4 * max_tokens`` characters."""
    return _cut(text, 4 * max_tokens, 4 * max_tokens)


def keywords(text: Column, least: int = 2) -> Column:
    """Lower-case runs of letters and digits of ``least`` bytes or with a digit, without stop words; repeats stay."""
    runs = F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1)
    digit = (lambda w: w.rlike("[0-9]")) if least <= 2 else (lambda w: F.lit(False))
    return F.filter(runs, lambda w: ((F.octet_length(w) >= least) | digit(w)) & ~w.isin(*KEYWORD_STOPWORDS) & (w != ""))


def fallback_token_ids(text: Column, most: int = 510) -> Column:
    """Model-free token ids: 101, a polynomial hash of each word into 1000..30521, 102."""
    def one(w: Column) -> Column:
        raw = F.hex(F.encode(w, "utf-8"))
        bytes_ = F.transform(F.sequence(F.lit(1), F.octet_length(w)), lambda i: F.conv(F.substring(raw, 2 * i - 1, F.lit(2)), 16, 10).cast("bigint"))
        return (F.aggregate(bytes_, F.lit(0).cast("bigint"), lambda a, b: (a * 31 + b) % 4294967296) % 29522 + 1000).cast("int")

    ids = F.transform(F.slice(space_words(F.lower(text)), 1, most), one)
    return F.concat(F.array(F.lit(101)), ids, F.array(F.lit(102)))
