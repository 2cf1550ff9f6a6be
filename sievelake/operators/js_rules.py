"""Rules over JavaScript text, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.arrays import let, sums_before
from sievelake.functions.text import explode_lines, split_lines
from sievelake.operators.rules import hit, shaped
from sievelake.operators.scope import in_scope, in_scope_range

#: The patterns of the line rules, and what exempts a jQuery line.
HTML = r"(?i)<(input|button)[\s>]"
STYLE = r"""(?i)style\s*=\s*['"]"""
CONSOLE = r"console\.(log|debug)\s*\("
DEBUGGER = r"(?U)(?<![\w.])debugger\s*;"
JQUERY = r"(?<![\p{L}\p{N}_$])(?:\$|jQuery)\s*\("
SAFE = ("$wrapper", "frm.fields_dict")
CALL = r"frappe\s*\.\s*call\s*\("
HANDLED = r"(?U)(?i)\b(error|catch|fail|callback)\b"
FREEZE = r"(?U)\bfreeze\s*:"
WINDOW = 12

#: Our own credential rule: a secret-like name that is given a quoted value which is no placeholder.
SECRET = r"""(?i)(?:api_?key|secret|passw(?:or)?d|passwd|token|private_?key)["']?\s*[:=]\s*["']([^"'\s]{6,})["']"""
PLACEHOLDER = r"(?i)^(change_?me|example.*|your[_-].*|placeholder|dummy|x+|\*+|<.*>|\$\{.*\}|\{\{.*\}\}|none|null|test)$"


def credential(line: Column) -> Column:
    """Whether a line gives a secret-like name a quoted value that isn't a placeholder."""
    return F.exists(F.regexp_extract_all(line, F.lit(SECRET), F.lit(1)), lambda x: ~x.rlike(PLACEHOLDER))


def line_rules(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ("path", "changed_lines")) -> DataFrame:
    """Findings of the line rules: one pass over the lines, all rules at once. keep must have changed_lines."""
    lines = explode_lines(files, content, *keep)
    line, n = F.col("line"), F.col("lineno")
    jquery = line.rlike(JQUERY)
    for safe in SAFE:
        jquery = jquery & ~line.contains(safe)
    hits = F.array(hit(10, line.rlike(HTML), n), hit(11, line.rlike(STYLE), n), hit(12, line.rlike(CONSOLE), n), hit(13, line.rlike(DEBUGGER), n), hit(14, jquery, n), hit(16, credential(line), n))
    return shaped(lines.where(in_scope(F.col("changed_lines"), n)), hits, *[k for k in keep if k != "changed_lines"])


def call_rule(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ("path", "changed_lines")) -> DataFrame:
    """Calls, over line breaks too, without error handling in the WINDOW lines from where they begin.

    A match's line is one more than the line breaks before it, counted in the gaps
    that split() leaves between matches.
    """
    text = F.col(content)
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    matched = F.zip_with(F.transform(F.split(text, CALL, -1), breaks), F.transform(F.regexp_extract_all(text, F.lit(CALL), F.lit(0)), breaks), lambda gap, own: F.struct(gap.alias("gap"), own.alias("own")))

    def begun(m: Column) -> Column:
        return F.zip_with(sums_before(F.transform(m, lambda x: x["gap"] + x["own"])), m, lambda before, x: before + x["gap"] + 1)

    # each call takes its own window along, not the file's lines
    numbers = let(F.filter(matched, lambda x: x["own"].isNotNull()), begun)
    windows = let(split_lines(text), lambda lines: F.transform(numbers, lambda n: F.struct(n.alias("n"), F.slice(lines, n, F.lit(WINDOW)).alias("w"))))
    rows = files.where(text.rlike(CALL)).select(*keep, F.explode(windows).alias("__c"))
    rows = rows.select(*keep, F.col("__c.n").alias("n"), F.array_join("__c.w", "\n").alias("__t"), (F.col("__c.n") + F.size("__c.w") - 1).alias("__e"))
    open_ = ~F.col("__t").rlike(HANDLED) & ~F.col("__t").rlike(FREEZE) & in_scope_range(F.col("changed_lines"), F.col("n"), F.col("__e"))
    return shaped(rows, F.array(hit(15, open_, F.col("n"))), *[k for k in keep if k != "changed_lines"])
