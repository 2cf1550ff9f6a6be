"""Helpers the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.functions.storage import SMALL, cut, input_bytes, range_parts, remove, shared_dir

__all__ = ["SMALL", "cut", "input_bytes", "range_parts", "remove", "shared_dir"]

#: Prefix of every internal column, so that extra input columns can't clash.
P = "__sl_"

#: A word is a run without ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """df, a stored table of narrow rows, to be broadcast if it was counted to be small."""
    return F.broadcast(df) if df.count() <= limit else df


def row_hash(text_col: str) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


#: A group of fewer rows than this is no hot one.
HOT = 1_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows joined with their group (one stored row of `groups` for each key; `size`, dropped here, counts its rows).

    Hot groups are broadcast, so that none meets in one task. They are those of over 1 / SMALL of all rows, so there are SMALL of
    them at most at any size of the input; the rest is joined by a shuffle.
    """
    over = F.col(size) > max(HOT, (groups.agg(F.sum(size)).first()[0] or 0) // SMALL)
    big = groups.where(over)
    if big.isEmpty():
        return rows.join(groups.drop(size), key)
    hot = rows.join(F.broadcast(big.drop(size)), key)
    cold = rows.join(F.broadcast(big.select(key)), key, "left_anti").join(groups.where(~over).drop(size), key)
    return hot.unionByName(cold)


def draw_below(n: Column, wanted: int, spare: float = 1.2) -> Column:
    """The signed 64-bit hash up to which about spare * wanted of n rows lie (all of them if n is small)."""
    share = F.lit(spare * wanted) / n
    return F.when(share >= 1, F.lit(2**63 - 1)).otherwise((share * F.lit(2.0**64) - F.lit(2.0**63)).cast("bigint"))


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


#: Bytes that A-Z are lowered in.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SLICE = 1 << 20


def slices(batches: Iterable[pa.RecordBatch], column: int, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about `limit` bytes of text at most, so that a task's memory doesn't follow the batch size; a longer text is alone."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(size.tolist()):
            if i > start and total + n > limit:
                yield b.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < b.num_rows:
            yield b.slice(start)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a, b: long), root the smallest node of its component.

    Alternating large-star and small-star steps, each a pre-aggregated minimum
    and a join on the node, so that a hub's edges are never gathered in one
    place and its join can be split. The loop ends when the edges stay the same.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
