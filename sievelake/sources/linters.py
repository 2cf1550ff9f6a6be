"""Findings from the JSON that external analysers write.

A payload that isn't JSON, or isn't of the tool's shape, has no rows. The rows are
joined to the targets by path: other files' rows go. `outer` and `inner` are a
finding's place in its payload (of its file's entry, and in that), by which equal
findings keep their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.functions import severity
from sievelake.functions.text import relative
from sievelake.operators.scope import in_scope

RUFF = "array<struct<filename: string, code: string, message: string, location: struct<row: int>, end_location: struct<row: int>>>"
ESLINT = "array<struct<filePath: string, messages: array<struct<ruleId: string, message: string, line: int, endLine: int, severity: int>>>>"
SEMGREP = "struct<results: array<struct<check_id: string, path: string, start: struct<line: int>, end: struct<line: int>, extra: struct<message: string, severity: string>>>>"

COLUMNS = ["file", "check_id", "tier", "source", "severity", "title", "explanation", "line_start", "line_end", "raw", "outer", "inner"]


def _first_line(c: str):
    return F.substring_index(c, "\n", 1)


def ruff(payloads: DataFrame, root: str = "", payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    rows = payloads.select(*keep, F.lit(0).alias("outer"), F.posexplode(F.from_json(payload, RUFF)).alias("inner", "x"))
    code, message = F.col("x.code"), F.coalesce("x.message", F.lit(""))
    return _shaped(rows, keep, relative(F.col("x.filename"), root), F.concat(F.lit("RUFF-"), code), "ruff", severity.ruff(code), F.concat(code, F.lit(": "), _first_line("x.message")), message, "x.location.row", "x.end_location.row")


def eslint(payloads: DataFrame, root: str = "", payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    files = payloads.select(*keep, F.posexplode(F.from_json(payload, ESLINT)).alias("outer", "f"))
    rows = files.select(*keep, "outer", F.col("f.filePath").alias("p"), F.posexplode("f.messages").alias("inner", "x"))
    rule, message = F.coalesce(F.nullif(F.col("x.ruleId"), F.lit("")), F.lit("unknown")), F.coalesce("x.message", F.lit(""))
    return _shaped(rows, keep, relative(F.col("p"), root), F.concat(F.lit("ESLINT-"), rule), "eslint", severity.eslint(F.col("x.severity")), F.concat(rule, F.lit(": "), message), message, "x.line", "x.endLine")


def semgrep(payloads: DataFrame, root: str = "", payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    rows = payloads.select(*keep, F.lit(0).alias("outer"), F.posexplode(F.from_json(payload, SEMGREP)["results"]).alias("inner", "x"))
    rule = F.substring_index(F.coalesce("x.check_id", F.lit("semgrep-rule")), ".", -1)
    title = F.substring_index(F.coalesce(F.col("x.extra.message"), rule), "\n", 1)
    return _shaped(rows, keep, relative(F.col("x.path"), root), F.concat(F.lit("SEMGREP-"), rule), "semgrep", severity.semgrep(F.col("x.extra.severity")), title, F.coalesce("x.extra.message", F.lit("")), "x.start.line", "x.end.line")


def _shaped(rows, keep, file, check_id, source, level, title, explanation, first, last) -> DataFrame:
    return rows.select(
        *keep, file.alias("file"), check_id.alias("check_id"), F.lit("rules").alias("tier"), F.lit(source).alias("source"), level.alias("severity"),
        title.alias("title"), explanation.alias("explanation"), F.col(first).cast("int").alias("line_start"), F.col(last).cast("int").alias("line_end"), F.to_json("x").alias("raw"), "outer", "inner",
    ).where("line_start is not null")


def scoped(findings: DataFrame, targets: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """The findings in targets' files on lines that are in scope. The planner chooses the join: targets aren't small for sure."""
    side = targets.select(*on, F.col("path").alias("file"), "changed_lines")
    return findings.join(side, [*on, "file"]).where(in_scope(F.col("changed_lines"), F.col("line_start"))).drop("changed_lines")


TOOLS = {"ruff": ruff, "eslint": eslint, "semgrep": semgrep}
#: File suffixes that each tool and the house rules are given.
SUFFIXES = {"ruff": (".py",), "eslint": (".js", ".jsx", ".ts", ".tsx"), "house": (".py", ".js")}
