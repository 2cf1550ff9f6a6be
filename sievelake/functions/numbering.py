"""Global row numbers without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions.storage import cut, range_parts


def numbered(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """df with 1, 2, ... in the given order.

    Rows are range-partitioned and sorted, numbered inside their partition, and
    shifted by the sizes of the partitions before; only these sizes, a row for
    each partition, meet in one place. The sorted rows are stored in the shared
    folder, so that both uses see the same partitions whatever executors are lost.
    """
    keys = [f"__k{i}" for i in range(len(order))]
    keyed = df.select("*", *[_plain(c).alias(k) for c, k in zip(order, keys)])
    by = [_directed(F.col(k), c) for c, k in zip(order, keys)]
    rows = cut(keyed.repartitionByRange(range_parts(df), *by).sortWithinPartitions(*by).withColumn("__i", F.monotonically_increasing_id()))
    part = F.shiftright("__i", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__part", before.alias("__before"))
    return rows.withColumn("__part", part).join(F.broadcast(sizes), "__part").withColumn(name, (F.col("__before") + F.col("__i").bitwiseAND((1 << 33) - 1) + 1).cast("bigint")).drop("__part", "__before", "__i", *keys)


class Desc:
    """A descending sort key for numbered()."""

    def __init__(self, column: Column):
        self.column = column


def _plain(c) -> Column:
    return c.column if isinstance(c, Desc) else c


def _directed(key: Column, c) -> Column:
    return key.desc() if isinstance(c, Desc) else key.asc()
