"""Column functions that give the same value on every engine and every run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int | str, *keys: Column | str) -> Column:
    """Shuffle key: md5 of the seed and the keys, joined by bars."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def digest_int(key: Column) -> Column:
    """First 28 bits of a digest."""
    return F.conv(F.substring(key, 1, 7), 16, 10).cast("long")


def half_even(x: Column) -> Column:
    return F.rint(x).cast("long")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def hadamard(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(normalised(a), normalised(b))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def finite(a: Column, fill: float = 0.0) -> Column:
    """A vector without infinities: each is replaced."""
    return F.transform(a, lambda x: F.when(F.abs(x) == float("inf"), F.lit(fill)).otherwise(x))
