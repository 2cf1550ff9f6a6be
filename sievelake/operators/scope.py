"""Which lines and files a review may speak of. Null changed lines mean all lines, an empty array none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of tolerance for model findings; limits of lines in a file by tier; files in a whole-corpus review.
TOLERANCE = 2
MAX_LINES = {"cloud_llm": 800, "local_llm": 2000}
FILE_CAP = 50


def in_scope(changed: Column, line: Column) -> Column:
    return changed.isNull() | F.coalesce(F.array_contains(changed, line), F.lit(False))


def in_scope_range(changed: Column, first: Column, last: Column) -> Column:
    """Whether any changed line lies in [first, last]."""
    return changed.isNull() | F.coalesce(F.exists(changed, lambda x: (x >= first) & (x <= last)), F.lit(False))


def end_line(first: Column, last: Column) -> Column:
    """The last line; null and 0 mean the first one."""
    return F.coalesce(F.nullif(last, F.lit(0)), first)


def in_scope_near(changed: Column, first: Column, last: Column, tolerance: int = TOLERANCE) -> Column:
    return in_scope_range(changed, first - tolerance, end_line(first, last) + tolerance)


def live(targets: DataFrame) -> DataFrame:
    return targets.where(F.col("status") != "deleted")


def with_suffix(targets: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """Live targets whose path ends in one of the suffixes, as they are written."""
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | F.col("path").endswith(s)
    return live(targets).where(ends)


def size_reason(n_lines: Column, limit: int) -> Column:
    """Why a file is too large, or null."""
    return F.when(n_lines > limit, F.format_string("file too large (%d lines > %d)", n_lines, F.lit(limit)))


def readable(files: DataFrame, tier: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(files to review, skip rows): unreadable and oversized files are skipped with a reason."""
    most = MAX_LINES[tier] if limit is None else limit
    reason = F.when(F.col("content").isNull(), "could not read file").otherwise(size_reason(F.col("n_lines"), most))
    rows = files.withColumn("reason", reason)
    skips = rows.where("reason is not null").select(F.lit(tier).alias("tier"), "path", "reason", F.concat_ws(": ", F.lit(tier), "path", "reason").alias("entry"))
    return rows.where("reason is null").drop("reason"), skips


def over_cap(targets: DataFrame, cap: int = FILE_CAP, force: bool = False) -> int | None:
    """The number of live targets if it is over the cap and not forced; the scan ends past the cap."""
    if force or live(targets).limit(cap + 1).count() <= cap:
        return None
    return live(targets).count()
