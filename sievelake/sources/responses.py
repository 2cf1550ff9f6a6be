"""Findings from model responses: strict parsing, typed fields, run-wide ids, scope with tolerance."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.functions import jsonx, severity
from sievelake.functions.numbering import numbered
from sievelake.operators.scope import in_scope_near

PARSERS = {"chat": jsonx.chat_findings, "blocks": jsonx.block_findings}


def parsed(responses: DataFrame, protocol: str = "chat") -> DataFrame:
    """The rows with findings (JSON array) or reason added."""
    return responses.withColumn("__r", PARSERS[protocol](F.col("response"))).select(*responses.columns, "__r.findings", "__r.reason")


def skips(rows: DataFrame, tier: str) -> DataFrame:
    return rows.where("reason is not null").select(F.lit(tier).alias("tier"), "path", "reason", F.concat_ws(": ", F.lit(tier), "path", "reason").alias("entry"))


def findings(rows: DataFrame, tier: str, source: str, prefix: str, order: str = "file_ord") -> DataFrame:
    """One row for each finding of parsed responses that lies near a changed line.

    Ids count all findings of the run in order, those out of scope too, so they
    have gaps and don't depend on the scope.
    """
    each = rows.where("findings is not null").select("path", "changed_lines", F.col(order).alias("__f"), F.posexplode(F.variant_get(F.parse_json("findings"), "$", "array<variant>")).alias("__p", "v"))
    text = lambda key: F.try_variant_get("v", f"$.{key}", "string")
    whole = lambda key, default=None: jsonx.safe_int(F.try_variant_get("v", f"$.{key}", "variant"), default).cast("int")
    each = numbered(each, [F.col("__f"), F.col("__p")], "__n")
    out = each.select(
        F.format_string("%s-%03d", F.lit(prefix), "__n").alias("check_id"), F.lit(tier).alias("tier"), F.lit(source).alias("source"), severity.parse(text("severity")).alias("severity"),
        F.coalesce(text("title"), F.lit(f"{source} finding")).alias("title"), F.coalesce(text("explanation"), F.lit("")).alias("explanation"), F.col("path").alias("file"),
        whole("line_start", 1).alias("line_start"), whole("line_end").alias("line_end"), text("suggestion").alias("suggestion"), F.to_json("v").alias("raw"), "changed_lines", F.col("__n").alias("ord"),
    )
    return out.where(in_scope_near(F.col("changed_lines"), F.col("line_start"), F.col("line_end"))).drop("changed_lines")


def user_message(path, status, content, diff):
    """The request's text for one file."""
    head = F.concat(F.lit("File: "), path, F.lit("\nStatus: "), status, F.lit("\n\nFull file content:\n```\n"), content, F.lit("\n```"))
    changed = F.concat(F.lit("\n\nUnified diff of the change:\n```diff\n"), diff, F.lit("\n```"))
    whole = F.lit("\n\nNo diff included — this is a full-file audit, not a diff review. Review the entire file.")
    return F.concat(head, F.when(F.coalesce(diff, F.lit("")) != "", changed).otherwise(whole))


def requested(files: DataFrame, client: Callable[[], Callable[[str], tuple[str | None, str | None]]]) -> DataFrame:
    """path, response, error: one request for each row's message.

    client() is called once a task and returns a function from a message to
    (response, error); it waits by functions.retry itself. Write the result down
    before using it twice: a repeated task would ask again.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = client()
        for b in batches:
            got = [ask(m) for m in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([g[k] for g in got], pa.string()) for k in (0, 1)]], ["path", "response", "error"])

    return files.select("path", "message").mapInArrow(run, "path string, response string, error string")
