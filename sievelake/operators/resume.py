"""Using an earlier run's results again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def skipped_paths(entries: DataFrame, tier: str) -> DataFrame:
    """path: what an entry "tier: path: reason" may name. A path may hold ": " itself, so each beginning that is followed by ": " counts; the prefix test becomes an equi-join."""
    head = f"{tier}: "
    rest = F.substr("entry", F.lit(len(head) + 1))
    parts = F.split(rest, ": ", -1)
    beginnings = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ": "))
    rows = entries.where(F.col("entry").startswith(head) & rest.contains(": "))
    return rows.select(F.explode(beginnings).alias("path")).distinct()


def succeeded(current: DataFrame, prior_files: DataFrame, entries: DataFrame, tier: str) -> DataFrame:
    """path: files that `tier` finished before and whose content hash is the same; entries are the earlier run's skip entries."""
    same = current.where("hash <> ''").join(prior_files.select("path", "hash"), ["path", "hash"], "left_semi")
    return same.join(skipped_paths(entries, tier), "path", "left_anti").select("path").distinct()


def remaining(targets: DataFrame, done: DataFrame) -> DataFrame:
    """The targets still to be reviewed, as often as they occur."""
    return targets.join(done.select("path"), "path", "left_anti")


def reused(prior_findings: DataFrame, done: DataFrame) -> DataFrame:
    return prior_findings.join(done.select(F.col("path").alias("file")), "file", "left_semi")


def resumed(old: DataFrame, new: DataFrame, order: str = "ord") -> DataFrame:
    """Reused findings, then new ones; `order` is kept within each."""
    return old.withColumn("part", F.lit(0)).unionByName(new.withColumn("part", F.lit(1)), allowMissingColumns=True).orderBy("part", order)


def hashes(files: DataFrame) -> Column:
    """Aggregate: a map from path to hash."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "sha256"))))
