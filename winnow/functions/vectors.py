"""Vectors as array columns; sums are taken in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a over its length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-300))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two bigints."""
    return F.bit_count(a.bitwiseXOR(b))


def sign_bits(a: Column, size: int = 64) -> Column:
    """The signs of the first 64 entries as bits of a bigint, entry 0 lowest; 1 where positive."""
    bits = F.zip_with(a, F.sequence(F.lit(0), F.lit(size - 1)), lambda x, k: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), k)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))
