"""Unified diffs as relations: file blocks, headers, statuses, changed lines."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from sievelake.functions.arrays import let
from sievelake.functions.text import LINE_ENDS, strip_side, unquoted

#: The forms of a file header (each side may be quoted on its own) and of a hunk header.
QUOTED = r'"(?:[^"\\]|\\.)*"'
HEADER = "^diff --git (?:" + "|".join(f"({old}) ({new})" for old, new in ((QUOTED, QUOTED), (QUOTED, "b/.+"), ("a/.+?", QUOTED), ("a/.+?", "b/.+"))) + ")$"
HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"
HUNK_START = re.compile(HUNK, re.ASCII)
#: Fixed value: the highest line number; a header of a higher one is none.
MOST = 2**31 - 1


def blocks(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """key, target_ord, diff_text: one row for each file of each diff."""
    parts = diffs.select(key, F.posexplode(F.split(text, r"(?m)(?=^diff --git )")).alias("target_ord", "diff_text"))
    return parts.where(F.col("diff_text").startswith("diff --git"))


def header(line: Column) -> Column:
    """struct(old, new) of a header line as it stands, or null; the most specific form that fits, all tried in one match."""
    sides = F.regexp_replace(line, HEADER, "$1$3$5$7\0$2$4$6$8")
    return let(sides, lambda x: F.when(~x.startswith("diff --git ") & x.contains("\0"), F.struct(F.substring_index(x, "\0", 1).alias("old"), F.substring_index(x, "\0", -1).alias("new"))))


def status(block: Column) -> Column:
    """By markers anywhere in the block, the first that is there."""
    return F.when(block.contains("new file mode"), "added").when(block.contains("deleted file mode"), "deleted").when(block.contains("rename from"), "renamed").otherwise("modified")


def item_status(renamed: Column, new: Column, deleted: Column) -> Column:
    """The status of a diff entry that has flags."""
    return F.when(renamed, "renamed").when(new, "added").when(deleted, "deleted").otherwise("modified")


def touched(block: str | None) -> list[int]:
    """The new file's line numbers that a block of a diff touches, sorted.

    A removed line stands for the line that follows it; lines before the first
    hunk, and in a hunk that starts at 0, count for nothing.
    """
    if block is None or "@@ -" not in block:
        return []
    found, at = set(), 0
    for line in block.splitlines():
        first = line[:1]
        if first == "@" and (m := HUNK_START.match(line)) and (start := int(m[1])) <= MOST:
            at = start
        elif at:
            minus = first == "-" and not line.startswith("---")
            if minus or first == "+" and not line.startswith("+++"):
                found.add(at)
            at += not minus
    return sorted(found)


@F.arrow_udf(ArrayType(IntegerType()))
def _changed_lines(block: pa.Array) -> pa.Array:
    return pa.array([touched(x) for x in block.to_pylist()], pa.list_(pa.int32()))


def changed_lines(block: Column) -> Column:
    """touched() of a column, in Arrow batches: a pass over the block's own lines, so nothing is exploded or shuffled."""
    return _changed_lines(block)


def line_numbers(parts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, line: a row for each line that a block touches."""
    return parts.select(*keys, F.explode(changed_lines(F.col(text))).alias("line"))


def targets(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """key, target_ord, path, status, diff_text, changed_lines, old_path: one row for each file whose header can be read."""
    parts = blocks(diffs, key, text)
    first = F.regexp_replace(F.substring_index("diff_text", "\n", 1), f"(?:{LINE_ENDS})[\\s\\S]*", "")
    # as a generator, so that the header is read once and not again in a filter
    parts = parts.select(key, "target_ord", "diff_text", F.explode(F.filter(F.array(header(first)), lambda x: x.isNotNull())).alias("__h"))
    side = lambda c: strip_side(unquoted(F.col(f"__h.{c}")))
    return parts.select(
        key, "target_ord", side("new").alias("path"), status(F.col("diff_text")).alias("status"), "diff_text", changed_lines(F.col("diff_text")).alias("changed_lines"), side("old").alias("__old")
    ).select(key, "target_ord", "path", "status", "diff_text", "changed_lines", F.when(F.col("status") == "renamed", F.col("__old")).alias("old_path"))
