"""Whole-corpus and change reviews as composed DataFrame transforms: run() is a whole review by its settings, review() what it is made of."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.functions.storage import cut
from sievelake.operators import coverage, js_rules, merge, py_rules, report, scope
from sievelake.sources import analysers, config, linters, models, reports
from sievelake.sources.schemas import FINDING, FINDING_COLUMNS


@dataclass
class Review:
    """A finished plan: nothing has run yet but what its sources needed."""

    mode: str
    findings: DataFrame
    files: DataFrame
    skips: DataFrame
    tiers: list[str] = field(default_factory=lambda: ["rules"])
    base_ref: str | None = None
    head_ref: str | None = None
    started: datetime = field(default_factory=lambda: datetime.now(UTC))
    outcomes: list[DataFrame] = field(default_factory=list)
    reused: int = 0

    def gate(self, level: str = "high") -> int:
        return report.exit_code(self.findings, level)


def empty_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FINDING).withColumns({"tier_ord": F.lit(0), "runner_ord": F.lit(0), "a": F.lit(""), "b": F.lit(0), "c": F.lit(0)})


def house(files: DataFrame) -> DataFrame:
    """Findings of the house rules. files: path, status, changed_lines, content."""
    python = scope.with_suffix(files, (".py",)).where("content is not null")
    script = scope.with_suffix(files, (".js",)).where("content is not null")
    a = py_rules.rules(py_rules.nodes(python)).withColumnRenamed("node_id", "pos")
    b = js_rules.line_rules(script).unionByName(js_rules.call_rule(script)).withColumn("pos", F.col("line_start"))
    return a.unionByName(b).withColumnRenamed("path", "file")


def _complete(rows: DataFrame, tier: int, runner: int, a: str, b: str, c: str) -> DataFrame:
    """The finding columns and the keys of the order in which findings are merged."""
    have = {x.split(" ")[0]: x.split(" ")[1] for x in FINDING.split(", ")}
    columns = [F.col(n).cast(t) if n in rows.columns else F.lit(None).cast(t).alias(n) for n, t in have.items()]
    return rows.select(*[c_.alias(n) for c_, n in zip(columns, FINDING_COLUMNS)], F.lit(tier).alias("tier_ord"), F.lit(runner).alias("runner_ord"), F.col(a).cast("string").alias("a"), F.col(b).cast("int").alias("b"), F.col(c).cast("int").alias("c"))


def review(files: DataFrame, mode: str, linter_output: dict[str, DataFrame] | None = None, models: list[DataFrame] | None = None, skips: DataFrame | None = None, root: str = "", rules: config.Rules | None = None) -> Review:
    """files: path, status, diff_text, changed_lines, content (and target_ord in a change). linter_output: payloads by tool. models: findings of model tiers, with ord. rules: which of the rules run."""
    rules = rules or config.Rules()
    spark = files.sparkSession
    parts = []
    for k, (tool, ingest) in enumerate(linters.TOOLS.items()):
        if linter_output and tool in linter_output:
            targets = scope.with_suffix(files, linters.SUFFIXES[tool]) if tool in linters.SUFFIXES else scope.live(files)
            parts.append(_complete(linters.scoped(ingest(linter_output[tool], root), targets), 0, k, "file", "outer", "inner"))
    if rules.enabled and rules.house_rules:
        parts.append(_complete(house(files), 0, 3, "file", "rule_ord", "pos"))
    if mode == "diff" and rules.enabled and rules.test_coverage:
        change = files.withColumn("diff_id", F.lit(0)).withColumn("target_ord", F.col("target_ord") if "target_ord" in files.columns else F.lit(0))
        parts.append(_complete(coverage.findings(change), 0, 4, "file", "rule_ord", "line_start"))
    for k, rows in enumerate(models or []):
        parts.append(_complete(rows, 1 + k, 0, "file", "part" if "part" in rows.columns else "ord", "ord"))
    every = empty_findings(spark)
    for p in parts:
        every = every.unionByName(p)
    # the order within a block of a file is all that the merge looks at
    every = every.withColumn("ord", F.struct("tier_ord", "runner_ord", "a", "b", "c"))
    every = every.withColumn("ord", F.hex(F.encode(F.format_string("%03d %03d %s %09d %09d", "tier_ord", "runner_ord", "a", F.coalesce("b", F.lit(0)), F.coalesce("c", F.lit(0))), "utf-8")))
    found = merge.merged(every.drop("tier_ord", "runner_ord", "a", "b", "c"))
    return Review(mode, found, files.select("path"), skips if skips is not None else spark.createDataFrame([], "tier string, path string, reason string, entry string"))


class Refused(ValueError):
    """The cloud tier would ask about more files than its cap."""


def run(files: DataFrame, mode: str, settings: config.Config, root: str, resume_from: str | None = None, force_cloud: bool = False, clients: dict[str, Callable] | None = None, allow_local: Callable[[], str | None] = lambda: None) -> Review:
    """A review by its settings: rules, analysers that are there, and the model tiers that are enabled and there; what is missing is skipped with its reason.

    files: path, status, diff_text, changed_lines, content. clients: by tier, what makes a function from a message to (response, error).
    allow_local: None if the local tier may run, else why not. Refused is raised before anything is asked.
    """
    spark = files.sparkSession
    if settings.cloud.enabled and (n := scope.over_cap(files, settings.cloud.audit_file_cap, force_cloud)) is not None:
        raise Refused(f"the cloud tier would ask about {n} files (the cap is {settings.cloud.audit_file_cap})")
    skips: list[str] = []
    prior = None
    if resume_from is not None and (prior := reports.load(spark, resume_from)) is None:
        skips.append(f"--resume-from: could not read or parse {resume_from}")
    tiers, linted = [], {}
    rules = settings.rules
    if rules.enabled:
        tiers.append("rules")
        linted, missing = analysers.outputs(files, root, {"ruff": rules.ruff, "eslint": rules.eslint, "semgrep": rules.semgrep})
        skips += missing
    answered = []
    for tier, label in ((models.local(settings.local), "local tier"), (models.cloud(settings.cloud), "cloud tier")):
        if not tier.enabled:
            continue
        reason = tier.missing() if not (clients and tier.name in clients) else None
        if reason := reason or (allow_local() if tier.name == "local_llm" else None):
            skips.append(f"{label}: {reason}")
            continue
        answered.append(models.run(tier, files, mode, prior, (clients or {}).get(tier.name)))
        tiers.append(tier.name)
    entries = spark.createDataFrame([(None, None, None, s, k) for k, s in enumerate(skips)], "tier string, path string, reason string, entry string, k int").drop("k")
    for a in answered:
        entries = entries.unionByName(a.skips)
    out = review(files, mode, linted, [a.findings for a in answered], entries, root, rules)
    out.findings = cut(out.findings)  # analysers run once, however many reports are written
    out.tiers, out.outcomes, out.reused = tiers, [a.outcomes for a in answered], sum(a.reused for a in answered)
    return out


def audit_files(spark: SparkSession, root: str) -> DataFrame:
    """All files below a folder (or of a git work tree's lists, if git is there), with their contents."""
    from sievelake.sources import git, trees

    try:
        return trees.read_files(git.repo_files(spark, root), root)
    except (ValueError, OSError):
        files = trees.contents(spark, root)
        return trees.read_targets(trees.manifest(files.select("path"), files.select("path").limit(0)), files)


def diff_files(spark: SparkSession, repo: str, base: str | None = None, staged: bool = False) -> DataFrame:
    """The files that a change touches, with their contents."""
    from sievelake.sources import git, trees

    return trees.read_files(git.diff_targets(spark, repo, base, staged), repo)


def audit(spark: SparkSession, root: str, **options) -> Review:
    return review(audit_files(spark, root), "audit", root=root, **options)


def diff(spark: SparkSession, repo: str, base: str | None = None, staged: bool = False, **options) -> Review:
    out = review(diff_files(spark, repo, base, staged), "diff", root=repo, **options)
    out.base_ref, out.head_ref = base, "INDEX" if staged else "HEAD"
    return out
