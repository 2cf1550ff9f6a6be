"""Counts, order, gate and Markdown of a report's findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelake.functions import severity
from sievelake.functions.numbering import Desc, numbered
from sievelake.functions.text import md_code, md_inline


def severity_domain(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, k) for k, s in enumerate(severity.SEVERITIES)], "severity string, severity_rank int")


def counts_by_severity(findings: DataFrame) -> DataFrame:
    """severity, severity_rank, n for every severity, with zeros."""
    counts = findings.groupBy("severity").agg(F.count("*").alias("n"))
    return severity_domain(findings.sparkSession).join(counts, "severity", "left").select("severity", "severity_rank", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def summary(findings: DataFrame) -> DataFrame:
    """The counts that aren't zero, most severe first."""
    return counts_by_severity(findings).where("n > 0").orderBy(F.desc("severity_rank"))


def by_file(findings: DataFrame) -> DataFrame:
    """file, n, n_checks, worst (severity): pre-aggregated, nothing is collected."""
    rank = severity.rank(F.col("severity"))
    return findings.groupBy("file").agg(F.count("*").alias("n"), F.count_distinct("check_id").alias("n_checks"), severity.of_rank(F.max(rank)).alias("worst"))


def rollup(findings: DataFrame) -> DataFrame:
    """source, severity, n, n_files, level: counts by source and severity with subtotals, level being the grouping id.

    Rows are shuffled once, by file; there a file is counted for each pair, source and total that it is the
    first row of, so that all that goes on is a row for each source and severity.
    """
    each = findings.repartition("file").groupBy("file", "source", "severity").agg(F.count("*").alias("n"))
    order = Window.partitionBy("file").orderBy("source", "severity")
    known, first = F.col("file").isNotNull(), F.row_number().over(order) == 1
    fresh = first | ~F.lag("source").over(order).eqNullSafe(F.col("source"))
    marks = {"__0": known, "__1": known & fresh, "__3": known & first}
    small = each.select("source", "severity", "n", *[v.cast("bigint").alias(k) for k, v in marks.items()]).groupBy("source", "severity").agg(*[F.sum(x).alias(x) for x in ("n", *marks)])
    level = F.grouping_id().cast("bigint").alias("level")
    out = small.rollup("source", "severity").agg(*[F.sum(x).alias(x) for x in ("n", *marks)], level)
    return out.select("source", "severity", "n", F.when(F.col("level") == 0, F.col("__0")).when(F.col("level") == 1, F.col("__1")).otherwise(F.col("__3")).alias("n_files"), "level")


def totals(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("n_findings"), F.count_distinct("file").alias("n_files"))


def sort_keys() -> list[Column]:
    return [F.desc(severity.rank(F.col("severity"))), F.col("file"), F.col("line_start"), F.col("ord")]


def ordered(findings: DataFrame) -> DataFrame:
    """Most severe first, then by file and line; ties keep their order."""
    return findings.orderBy(*sort_keys())


def ranked(findings: DataFrame) -> DataFrame:
    """The findings with their place in that order."""
    return numbered(findings, [Desc(severity.rank(F.col("severity"))), F.col("file"), F.col("line_start"), F.col("ord")], "place")


def at_or_above(findings: DataFrame, level: str) -> DataFrame:
    if level not in severity.SEVERITIES:
        raise ValueError(f"unknown severity {level!r}")
    return findings.where(severity.rank(F.col("severity")) >= severity.SEVERITIES.index(level))


def exit_code(findings: DataFrame, level: str) -> int:
    """1 if any finding is that severe; the scan ends at the first one."""
    return int(not at_or_above(findings, level).isEmpty())


def markdown_row() -> Column:
    level = F.col("severity")
    return F.format_string("| %d | %s %s | `%s` (%s) | %s |", "line_start", severity.emoji(level), level, md_code(F.col("check_id")), md_code(F.col("source")), md_inline(F.col("title")))


def markdown_files(findings: DataFrame) -> DataFrame:
    """file, markdown: each file's section, files to be read in order of name. A section is one file's findings."""
    row = F.struct((-severity.rank(F.col("severity"))).alias("r"), F.col("line_start").alias("l"), F.col("ord").alias("o"), markdown_row().alias("t"))
    rows = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"])
    head = F.concat(F.lit("## `"), md_code(F.col("file")), F.lit("`\n\n| Line | Severity | Check | Title |\n|---|---|---|---|\n"))
    return findings.select("file", row.alias("x")).groupBy("file").agg(rows.alias("rows")).select("file", F.concat(head, F.array_join("rows", "\n"), F.lit("\n")).alias("markdown"))
