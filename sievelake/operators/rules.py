"""The rule catalogue as a dimension table, and the house findings' common shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.functions import severity

#: Order, id, severity and title of each rule; the explanations are this library's.
RULES = (
    (1, "RULE-001", "medium", "Bare except clause", "Catches every exception, exits and interrupts included."),
    (2, "RULE-002", "high", "frappe.db.sql() built with string formatting", "Values put into SQL text can be injected; pass them as parameters."),
    (3, "RULE-003", "high", "Whitelisted method without a permission check", "Anyone signed in can call it; check permissions before acting."),
    (4, "RULE-004", "medium", "Database call inside a loop (possible N+1 query)", "One query an iteration; fetch the rows at once instead."),
    (5, "RULE-005", "medium", "Manual frappe.db.commit()", "Requests are committed by the framework; a commit of one's own leaves half-done work."),
    (6, "RULE-006", "low", "User-facing message not wrapped in _()", "The message can't be translated."),
    (7, "RULE-007", "low", "Leftover print() call", "Use a logger."),
    (8, "RULE-008", "medium", "Exception caught and silently discarded", "The error leaves no trace."),
    (9, "RULE-009", "high", "Hardcoded credential", "Secrets in code are readable by all who can read the code."),
    (10, "RULE-010", "medium", "Hardcoded HTML input/button", "Use the framework's controls."),
    (11, "RULE-011", "low", "Inline style attribute", "Use a class."),
    (12, "RULE-012", "low", "Leftover console.log()/console.debug()", "Debug output."),
    (13, "RULE-013", "high", "Leftover debugger statement", "Halts the page with open developer tools."),
    (14, "RULE-014", "low", "Direct jQuery DOM access", "Go through the form's own fields."),
    (15, "RULE-015", "low", "frappe.call() with no visible error handling", "A failed call goes unnoticed."),
    (16, "RULE-016", "high", "Hardcoded credential in JavaScript", "Scripts are sent to every visitor."),
    (17, "RULE-017", "low", "No test changes detected for this PR", "Application code changed, tests didn't."),
    (18, "RULE-018", "low", "Function longer than 50 lines", "Split it."),
)


def rules(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(RULES), "rule_ord int, check_id string, severity string, title string, explanation string")
    return rows.withColumn("severity_rank", severity.rank(F.col("severity")))


def hit(rule: int, found: Column, first: Column, last: Column | None = None, level: Column | None = None) -> Column:
    """One candidate of a row's hit array: null unless found."""
    return F.when(found, F.struct(F.lit(rule).alias("rule_ord"), first.cast("int").alias("line_start"), (first if last is None else last).cast("int").alias("line_end"), (F.lit(None).cast("string") if level is None else level).alias("level")))


def shaped(rows: DataFrame, hits: Column, *keep: str) -> DataFrame:
    """Findings of the hits that aren't null: all rules of a row are evaluated in one pass, and the rule table is looked up by its position."""
    each = rows.select(*keep, F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("h"))
    column = lambda k: F.element_at(F.array(*[F.lit(r[k]) for r in RULES]), F.col("h.rule_ord"))
    return each.select(
        *keep, F.col("h.rule_ord").alias("rule_ord"), column(1).alias("check_id"), F.lit("rules").alias("tier"), F.lit("house").alias("source"),
        F.coalesce("h.level", column(2)).alias("severity"), column(3).alias("title"), column(4).alias("explanation"), F.col("h.line_start").alias("line_start"), F.col("h.line_end").alias("line_end"),
    )
