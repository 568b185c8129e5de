"""Vectors as arrays: signs, correlation, peaks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sign_words(values: Column, size: int = 64) -> Column:
    """The signs of a vector as 32-bit words in longs, lowest bit first."""

    def word(at: int) -> Column:
        bits = F.transform(F.slice(values, at + 1, 32), lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    return F.array(*[word(at) for at in range(0, size, 32)])


def sign_bytes(values: Column, size: int = 64) -> Column:
    """The same as bytes."""
    return F.unhex(F.array_join(F.transform(sign_words(values, size), lambda w: F.lpad(F.hex(w), 8, "0")), ""))


def pearson(a: Column, b: Column) -> Column:
    """The correlation of two vectors of one length; 0 where either has no variance."""
    n = F.size(a).cast("double")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    x, y = F.transform(a, lambda v: v.cast("double")), F.transform(b, lambda v: v.cast("double"))
    mx, my = total(x) / n, total(y) / n
    cross = total(F.zip_with(x, y, lambda p, q: p * q)) - n * mx * my
    norm = F.sqrt((total(F.transform(x, lambda v: v * v)) - n * mx * mx) * (total(F.transform(y, lambda v: v * v)) - n * my * my))
    return F.when(norm > 1e-9, cross / norm).otherwise(F.lit(0.0))


def peak(values: Column) -> Column:
    """The place, from 0, of the greatest value; the first on ties."""
    return F.array_position(values, F.array_max(values)) - 1
