"""Reports of a review: JSON, Markdown, Word and console text, written under a name that no other run has.

Rows are made in parallel and fetched in order, a partition at a time, so a report is
written as a stream and none is ever whole in one row or task; save() writes the findings as
files of JSON lines without the driver.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions import severity
from sievelake.operators import report
from sievelake.plans import wordfile
from sievelake.plans.review import Review

#: A finding's fields in a report.
FIELDS = ("check_id", "tier", "source", "severity", "title", "explanation", "file", "line_start", "line_end", "suggestion", "raw", "also_flagged_by")


def finding_json(columns: Iterable[str]) -> Column:
    """A finding as a JSON object; raw is an object in it."""
    have = [c for c in FIELDS if c in columns]
    return F.to_json(F.struct(*[(F.parse_json("raw") if c == "raw" else F.col(c)).alias(c) for c in have]), {"ignoreNullFields": "false"})


def json_lines(findings: DataFrame) -> DataFrame:
    """place, json of each finding in the report's order."""
    return report.ranked(findings).select("place", finding_json(findings.columns).alias("json"))


def save(review: Review, uri: str) -> None:
    """The findings as JSON lines, by ranges of their order."""
    report.ordered(review.findings).select(finding_json(review.findings.columns).alias("value")).write.mode("errorifexists").text(uri)


def _list(rows: Iterable[str]) -> Iterator[str]:
    first = True
    for r in rows:
        yield ("\n    " if first else ",\n    ") + r
        first = False
    if not first:
        yield "\n  "


def as_json(review: Review, repo: str, files: DataFrame | None = None) -> Iterator[str]:
    """The report's text in parts. files (path, sha256) become its hashes."""
    said = lambda x: json.dumps(x, ensure_ascii=False)
    counts = {r.severity: r.n for r in report.counts_by_severity(review.findings).orderBy("severity_rank").collect()}
    took = (datetime.now(UTC) - review.started).total_seconds()
    head = {"repo_path": repo, "mode": review.mode, "base_ref": review.base_ref, "head_ref": review.head_ref, "generated_at": review.started.isoformat(), "tiers_run": review.tiers, "duration_seconds": took, "counts_by_severity": counts}
    yield "{\n" + "".join(f"  {said(k)}: {said(v)},\n" for k, v in head.items())
    yield '  "findings": ['
    yield from _list(r.json for r in report.ordered(review.findings).select(finding_json(review.findings.columns).alias("json")).toLocalIterator())
    yield '],\n  "files_reviewed": ['
    yield from _list(said(r.path) for r in review.files.select("path").orderBy("path").toLocalIterator())
    yield '],\n  "skipped": ['
    yield from _list(said(r.entry) for r in review.skips.orderBy("entry").toLocalIterator())
    yield '],\n  "file_hashes": {'
    if files is not None:
        yield from _list(f"{said(r.path)}: {said(r.sha256)}" for r in files.select("path", "sha256").where("sha256 is not null").orderBy("path").toLocalIterator())
    yield "}\n}\n"


def markdown_lines(review: Review) -> Iterator[str]:
    """The report's lines; files' sections are made in parallel and fetched in order."""
    counts = report.summary(review.findings).collect()
    total = sum(r.n for r in counts)
    said = ", ".join(f"{severity.EMOJI[r.severity]} {r.n} {r.severity}" for r in counts)
    yield from ("# PR Review Report", "", f"**{total} finding(s)** — {said}" if total else "**No findings.**", "", f"_Tiers run: {', '.join(review.tiers)}_", "")
    yield from (r.markdown for r in report.markdown_files(review.findings).orderBy("file").toLocalIterator())
    first = True
    for r in review.skips.orderBy("entry").toLocalIterator():
        if first:
            yield from ("## Skipped", "")
        first = False
        yield "- " + re.sub(r"[\r\n]", " ", r.entry)
    if not first:
        yield ""


def as_markdown(review: Review) -> str:
    return "\n".join(markdown_lines(review))


CONTROL = re.compile(r"[\x00-\x08\x0b-\x1f\x7f-\x9f]")


def inert(text: str | None) -> str:
    """Text of others for a terminal: one line, no control characters (and so no escape sequences), brackets of markup escaped."""
    return CONTROL.sub("", re.sub(r"[\r\n\t]+", " ", text or "")).replace("[", r"\[")


def inert_column(value: Column) -> Column:
    """inert() of a column."""
    line = F.regexp_replace(F.coalesce(value, F.lit("")), r"[\r\n\t]+", " ")
    return F.replace(F.regexp_replace(line, r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", ""), F.lit("["), F.lit("\\["))


def as_console(review: Review) -> str:
    """A line for each finding, grouped by file, and the counts."""
    out, at = [], None
    for r in report.ordered(review.findings).orderBy("file", F.desc(severity.rank(F.col("severity"))), "line_start", "ord").toLocalIterator():
        if r.file != at:
            out += ["", inert(r.file)]
            at = r.file
        out.append(f"  {r.line_start:>5}  {r.severity:<8}  {inert(r.check_id)} ({inert(r.source)})  {inert(r.title)}")
    total = report.totals(review.findings).first()
    out += ["", f"{total.n_findings} finding(s) in {total.n_files} file(s): " + ", ".join(f"{r.n} {r.severity}" for r in report.summary(review.findings).collect())]
    return "\n".join([*out, *(f"skipped: {inert(r.entry)}" for r in review.skips.orderBy("entry").toLocalIterator())]).lstrip("\n")


#: The reports' suffixes.
SUFFIXES = (".json", ".md", ".docx")


def claim(folder: str, base: str, suffixes: tuple[str, ...] = SUFFIXES) -> str:
    """The first of base, base-2, base-3, ... of which no file exists; the files are created at once, or none is."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    n = 1
    while True:
        name, made = base if n == 1 else f"{base}-{n}", []
        try:
            for s in suffixes:
                os.close(os.open(path := f"{folder}/{name}{s}", os.O_CREAT | os.O_EXCL | os.O_WRONLY))
                made.append(path)
            return name
        except FileExistsError:
            n += 1
        except BaseException:
            for path in made:
                os.unlink(path)
            raise
        for path in made:
            os.unlink(path)


def finish(review: Review, folder: str, repo: str, base: str, files: DataFrame | None = None, level: str = "high") -> tuple[str, int]:
    """Writes all reports and returns their name and the exit code; an unknown level is found after they are written. If one can't be written, none stays."""
    name = claim(folder, base)
    path = f"{folder}/{name}"
    try:
        with open(f"{path}.json", "w", encoding="utf-8") as f:
            f.writelines(as_json(review, repo, files))
        with open(f"{path}.md", "w", encoding="utf-8") as f:
            f.writelines(line + "\n" for line in markdown_lines(review))
        with open(f"{path}.docx", "wb") as f:
            wordfile.write(f, *word_parts(review, repo))
    except BaseException:
        for suffix in SUFFIXES:
            Path(path + suffix).unlink(missing_ok=True)
        raise
    return name, review.gate(level)


def word_parts(review: Review, repo: str) -> tuple[str, list[tuple[str, str]], Iterator[tuple[str, list[tuple]]], list[str]]:
    """Title, summary rows, (file, its findings) in order, skip entries."""
    counts = report.summary(review.findings).collect()
    took = (datetime.now(UTC) - review.started).total_seconds()
    summary = [("Repo", repo), ("Mode", review.mode), ("Base ref", review.base_ref or "-"), ("Head ref", review.head_ref or "-"), ("Tiers run", ", ".join(review.tiers) or "-"), ("Files reviewed", str(review.files.count())), ("Duration", f"{took:.1f}s")]
    summary += [(f"{r.severity.title()} findings", str(r.n)) for r in counts]

    def by_file() -> Iterator[tuple[str, list[tuple]]]:
        at, rows = None, []
        for r in review.findings.orderBy("file", F.desc(severity.rank(F.col("severity"))), "line_start", "ord").toLocalIterator():
            if rows and r.file != at:
                yield at, rows
                rows = []
            at = r.file
            rows.append((r.line_start, r.severity, f"{r.check_id} ({r.source})", r.title))
        if rows:
            yield at, rows

    return f"Generated: {review.started.isoformat()}", summary, by_file(), [r.entry for r in review.skips.orderBy("entry").toLocalIterator()]
