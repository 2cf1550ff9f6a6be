"""Changes of application code that touch no test, decided for each change by one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.text import added_lines

#: Application suffixes, the forms of test paths, marks of test code, and thresholds.
SUFFIX = r"\.(py|js|jsx|ts|tsx)$"
TEST_PATHS = (r"(^|/)(test(_[^/]+)?|[^/]+_test)\.py$", r"(^|/)(test|[^/]+\.(test|spec)|[^/]+_test)\.(js|jsx|ts|tsx)$", r"(^|/)(tests?|__tests__)/")
MARKS = ("def test_", "test(", "it(", "describe(")
STUB, LEAST = 15, 5


def is_test_path(path: Column) -> Column:
    low, found = F.lower(path), F.lit(False)
    for form in TEST_PATHS:
        found = found | low.rlike(form)
    return low.rlike(SUFFIX) & found


def is_real_test(diff: Column, added: Column, status: Column) -> Column:
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | diff.contains(m)
    return F.when(marked, True).when(diff.contains("pass") & (added < STUB), False).when(added > STUB, True).otherwise((status == "modified") & (added > 0))


def untested(targets: DataFrame, key: str = "diff_id") -> DataFrame:
    """key, file (the application file with most added lines, the first of equals), n_added, n_files of changes without tests.

    targets: key, target_ord, path, status, diff_text, changed_lines. Whole-corpus
    targets (all changed_lines null) are no change.
    """
    test, alive = is_test_path(F.col("path")), F.col("status") != "deleted"
    rows = targets.select(key, "target_ord", "path", F.col("changed_lines").isNull().alias("whole"), added_lines(F.col("diff_text")).alias("added"), (alive & ~test & F.col("path").rlike(SUFFIX)).alias("app"),
                          (alive & test).alias("is_test"), "diff_text", "status")
    rows = rows.withColumn("real", F.col("is_test") & is_real_test(F.col("diff_text"), F.col("added"), F.col("status"))).drop("diff_text", "status")
    most = F.max_by(F.when(F.col("app"), F.col("path")), F.when(F.col("app"), F.struct("added", -F.col("target_ord"))))
    found = rows.groupBy(key).agg(F.every("whole").alias("whole"), F.sum(F.when(F.col("app"), F.col("added"))).alias("n_added"), F.count_if(F.col("app")).alias("n_files"), F.some("real").alias("tested"), most.alias("file"))
    return found.where(~F.col("whole") & (F.col("n_files") > 0) & (F.col("n_added") >= LEAST) & ~F.col("tested")).select(key, "file", "n_added", "n_files")


def findings(targets: DataFrame, key: str = "diff_id") -> DataFrame:
    from sievelake.operators.rules import hit, shaped

    return shaped(untested(targets, key), F.array(hit(17, F.lit(True), F.lit(1))), key, "file")
