"""Vector arithmetic on array columns: dense products, normalisation, sign quantisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = (64, 128, 256, 384)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(a: Column) -> Column:
    """Each value over the vector's length, which counts as 1e-12 at least."""
    length = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / length)


def truncate(a: Column, dim: int, allowed: tuple[int, ...] = DIMENSIONS) -> Column:
    """The first ``dim`` values, normalised again."""
    if dim not in allowed:
        raise ValueError(f"dimension {dim} isn't one of {allowed}")
    return l2_normalize(F.slice(a, 1, dim))


def _pack(bits: Column) -> Column:
    """An array of 0 and 1 as 64-bit words, the first bit lowest."""
    start = F.struct(F.lit(0).cast("bigint").alias("w"), F.lit(0).alias("i"))
    add = lambda s, x: F.struct(s["w"].bitwiseOR(F.call_function("shiftleft", x.cast("bigint"), s["i"])).alias("w"), (s["i"] + 1).alias("i"))
    words = F.sequence(F.lit(0), F.floor((F.size(bits) - 1) / 64).cast("int"))
    return F.transform(words, lambda k: F.aggregate(F.slice(bits, k * 64 + 1, F.lit(64)), start, add)["w"])


def sign_bits(a: Column, mean: Column) -> Column:
    """One bit a dimension: whether the value is above the corpus mean."""
    return _pack(F.zip_with(a, mean, lambda x, m: (x.cast("double") - m > 0).cast("int")))


def shifted_bits(a: Column, mean: Column, scale: Column, views: int = 16) -> Column:
    """``views`` sign vectors, the i-th after adding (i / (views - 1) - 1/2) * scale."""
    one = lambda i: _pack(F.zip_with(a, mean, lambda x, m: (x.cast("double") - m + (i.cast("double") / (views - 1) - 0.5) * scale > 0).cast("int")))
    return F.transform(F.sequence(F.lit(0), F.lit(views - 1)), one)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def view_similarity(a: Column, b: Column, bits: int) -> Column:
    """Mean over the views of max(0, 1 - distance / bits)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.greatest(F.lit(0.0), 1 - hamming(x, y) / F.lit(float(bits)))), F.lit(0.0), lambda s, x: s + x) / F.size(a)
