"""Earlier reports as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.functions import jsonx, severity
from sievelake.sources.schemas import REPORT


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The one-row report of a JSON file; None if it is missing or malformed."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(path, wholetext=True)
        report = parse(rows, "value")
        return None if report.isEmpty() else report
    except AnalysisException:
        return None


def parse(rows: DataFrame, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Reports from JSON texts; texts that aren't objects give no row, fields of a wrong type are null."""
    report = F.from_json(F.col(text), REPORT, {"mode": "PERMISSIVE"})
    ok = F.get_json_object(text, "$").startswith("{")
    return rows.where(ok).select(*keep, report.alias("r")).select(*keep, "r.*")


def files(report: DataFrame, tier: str, mode: str) -> DataFrame:
    """path, hash of the files whose results of `tier` may be used again in `mode`."""
    usable = report.where((F.col("mode") == mode) & F.array_contains("tiers_run", tier) & F.col("skipped").isNotNull() & F.col("file_hashes").isNotNull())
    rows = usable.select(F.explode("files_reviewed").alias("path"), "file_hashes")
    return rows.select("path", F.try_element_at("file_hashes", F.col("path")).alias("hash")).where("hash <> ''").distinct()


def skipped(report: DataFrame) -> DataFrame:
    return report.select(F.explode("skipped").alias("entry"))


def findings(report: DataFrame, tier: str) -> DataFrame:
    """The report's findings of `tier`, typed; elements that are no objects or lack an id or a file go."""
    each = report.select(F.posexplode("findings").alias("ord", "v"))
    text = lambda key: F.try_variant_get("v", f"$.{key}", "string")
    number = lambda key, default=None: jsonx.json_int(F.try_variant_get("v", f"$.{key}", "variant"), default).cast("int")
    out = each.select(
        text("check_id").alias("check_id"), text("tier").alias("tier"), F.coalesce(text("source"), F.lit(tier)).alias("source"), severity.parse(text("severity")).alias("severity"),
        F.coalesce(text("title"), F.lit("")).alias("title"), F.coalesce(text("explanation"), F.lit("")).alias("explanation"), text("file").alias("file"), number("line_start", 1).alias("line_start"),
        number("line_end").alias("line_end"), text("suggestion").alias("suggestion"), F.to_json(F.try_variant_get("v", "$.raw", "variant")).alias("raw"), F.col("ord").cast("bigint").alias("ord"),
    )
    return out.where((F.col("tier") == tier) & (F.col("check_id") != "") & (F.col("file") != ""))
