"""Folds over arrays in built-in expressions, near-linear in the array's size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements up to which an array is folded in one go.
SHORT = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix(values: Column, op: Callable[[Column, Column], Column], zero: int) -> Column:
    """What op makes of zero and all elements before each one (integers).

    A fold that appends to an array copies it at each step, so of more than SHORT elements blocks
    of sqrt(n) are folded, then the blocks: about n * sqrt(n) elements are copied.
    """
    empty = F.struct(F.lit(zero).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))

    def fold(array: Column, of: Callable[[Column], Column]) -> Column:
        return F.aggregate(array, empty, lambda s, x: F.struct(op(s["at"], of(x)).cast("int").alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))

    def whole(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda b: F.slice(v, b * width + 1, width))
        return let(F.transform(blocks, lambda b: fold(b, lambda x: x)), lambda done: F.flatten(F.zip_with(done, fold(done, lambda d: d["at"])["out"], lambda d, before: F.transform(d["out"], lambda x: op(before, x).cast("int")))))

    return let(values, lambda v: F.when(F.size(v) > SHORT, whole(v)).otherwise(fold(v, lambda x: x)["out"]))


def sums_before(values: Column) -> Column:
    return prefix(values, lambda a, b: a + b, 0)


def most_before(values: Column, least: int = -1) -> Column:
    return prefix(values, lambda a, b: F.greatest(a, b), least)
