"""The command line: python -m sievelake diff|audit ...; exits with 0, with 1 if findings reach the threshold, with 2 if the review can't be made."""

from __future__ import annotations

import argparse
import contextlib
import dataclasses
import getpass
import os
import re
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.functions import text
from sievelake.operators import placement
from sievelake.plans import render, review
from sievelake.sources import config, git, trees, urls


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("sievelake", description="Reviews source code: a change, or a whole tree.")
    commands = top.add_subparsers(dest="command", required=True)
    for name, about in (("diff", "review a change: staged, against a base, or a pull request"), ("audit", "review all files")):
        p = commands.add_parser(name, help=about)
        p.add_argument("--repo-path", default=".", help="the work tree")
        p.add_argument("--repo-url", help="clone this instead")
        p.add_argument("--branch", help="branch of --repo-url")
        p.add_argument("--config", help="settings")
        p.add_argument("--cloud", action="store_true", help="ask the cloud model too")
        p.add_argument("--local", action="store_true", help="ask the local model too")
        p.add_argument("--force-cloud", action="store_true", help="whatever the number of files")
        p.add_argument("--force-local", action="store_true", help="even if the local model would run on this machine")
        p.add_argument("--device", help="the device that the local model is to run on")
        p.add_argument("--output-dir", default="./reports", help="folder of the reports")
        p.add_argument("--resume-from", help="an earlier report whose model results are used again")
        if name == "diff":
            p.add_argument("--base-ref", help="what the change is compared with (main)")
            p.add_argument("--staged", action="store_true", help="review what is staged")
            p.add_argument("--pr", help="a pull request's URL, or its number at the work tree's origin")
    return top


class Wrong(Exception):
    """A review that can't be made: exit code 2."""


def settings_of(args: argparse.Namespace) -> config.Config:
    s = config.load(args.config)
    on = lambda part, flag: dataclasses.replace(part, enabled=part.enabled or flag)
    return dataclasses.replace(s, cloud=on(s.cloud, args.cloud), local=on(s.local, args.local))


def one(spark: SparkSession, *columns):
    return spark.range(1).select(*columns).first()


def pull_request_of(spark: SparkSession, args: argparse.Namespace) -> int | None:
    """The pull request's number; its URL's repository becomes --repo-url."""
    if getattr(args, "pr", None) is None:
        return None
    found = one(spark, urls.pull_request(F.lit(args.pr)).alias("p")).p
    if found is not None:
        if args.repo_url and args.repo_url != found.repo_url:
            raise Wrong(f"--repo-url ({args.repo_url!r}) and the repository of --pr ({found.repo_url!r}) aren't the same")
        args.repo_url = found.repo_url
        return found.number
    if not re.fullmatch(r"\s*[+-]?\d+\s*", args.pr):
        raise Wrong(f"--pr takes a number or a pull request's URL, not {args.pr!r}")
    return int(args.pr)


def ask_terminal(url: str, attempt: int) -> tuple[str, str] | None:
    print(f"Credentials for {url} ({attempt} of {git.PROMPTS}); an empty name gives up.", file=sys.stderr)
    user = input("Name: ").strip()
    return (user, getpass.getpass("Token: ")) if user else None


def local_gate(spark: SparkSession, local: config.Local, force: bool, device: str | None, tool: Callable[..., str | None]) -> str | None:
    """Why the local tier doesn't run, or None: a model server on this machine is only used if that is confirmed or forced."""
    if local.provider != "lm_studio" or not local.model or force:
        return None
    frame = lambda t: spark.createDataFrame([(t or "null",)], "payload string")
    models = spark.createDataFrame([(local.model,)], "model string")
    where = placement.located(models, placement.peers(frame(tool("link", "status", "--json"))), placement.loaded_models(frame(tool("ps", "--json"))))
    row = where.select("placement", "devices", placement.gate(F.col("placement"), F.lit(local.provider), F.col("model"), F.lit(force), F.lit(device)).alias("action")).first()
    if row.action == "proceed":
        return None
    labels = [*row.devices, "local"]
    if row.action == "choose":
        options = spark.createDataFrame([(local.model, k, x) for k, x in enumerate(labels)], "model string, ord int, label string")
        label = placement.chosen(options, models.withColumn("device", F.lit(device)), "model").first().label
        if label and label != "local" and tool("link", "set-preferred-device", label) is not None or label == "local":
            return None
        return f"no device answers to {device!r} (there are: {', '.join(labels)})"
    return f"{local.model} would run on this machine ({row.placement}); confirm with --force-local"


def lms(*args: str) -> str | None:
    """Output of the model server's own program, or None."""
    import shutil
    import subprocess

    if shutil.which("lms") is None:
        return None
    done = subprocess.run(["lms", *args], capture_output=True, text=True, check=False, timeout=30)
    return done.stdout if done.returncode == 0 else None


def run(spark: SparkSession, argv: list[str], clients: dict | None = None, say: Callable[[str], None] = print, ask: git.Credentials | None = None, tool: Callable[..., str | None] = lms) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        with contextlib.ExitStack() as stack:
            return _run(spark, args, stack, clients, say, ask, tool)
    except (Wrong, ValueError) as e:
        say(f"Error: {e}")
        return 2


def _run(spark, args, stack, clients, say, ask, tool) -> int:
    mode = args.command
    if mode == "diff" and args.staged and args.pr is not None:
        raise Wrong("--staged and --pr exclude each other")
    number, settings = pull_request_of(spark, args), settings_of(args)
    label = one(spark, text.repo_label(F.lit(args.repo_url or ""), F.lit(Path(args.repo_path).resolve().name)))[0]
    source = stack.enter_context(git.clone(args.repo_url, args.branch, ask)) if args.repo_url else str(Path(args.repo_path).resolve())
    tree, base, head = source, None, None
    if mode == "audit":
        files = review.audit_files(spark, tree)
    elif number is not None:
        tree, base = stack.enter_context(git.pull_request(source, number, args.base_ref, ask=ask))
        files, head = review.diff_files(spark, tree, base), f"pull/{number}"
    else:
        base = None if args.staged else args.base_ref or "main"
        if base is not None:
            try:
                git.git(source, "rev-parse", "--verify", "--end-of-options", base + "^{commit}")
            except ValueError:
                raise Wrong(f"no such reference: {base!r}") from None
        files, head = review.diff_files(spark, tree, base, args.staged), None if args.staged else "HEAD"
    files = files.cache()
    try:
        if files.isEmpty():
            say("No files found to audit." if mode == "audit" else "No changed files found.")
            return 0
        gate = lambda: local_gate(spark, settings.local, args.force_local, args.device, tool)
        done = review.run(files, mode, settings, tree, args.resume_from, args.force_cloud, clients, gate)
        done.base_ref, done.head_ref = base, head
        for outcomes in done.outcomes:
            rows = outcomes.orderBy("path").collect() if outcomes.limit(1001).count() <= 1000 else []
            for k, r in enumerate(rows):
                say(f"  ({k + 1}/{len(rows)}) {render.inert(r.path)}: {render.inert(r.outcome)}")
        if done.reused:
            say(f"Resumed: {done.reused} file(s) weren't asked about again.")
        say(render.as_console(done))
        name = one(spark, text.report_basename(F.lit(label), F.lit(number).cast("string"), F.lit(mode), F.lit(done.started.replace(tzinfo=None))))[0]
        hashed = trees.with_facts(files.select("path", "content"))
        name, code = render.finish(done, args.output_dir, source, name, hashed, settings.thresholds.fail_on_severity)
        say(f"Reports: {os.path.join(args.output_dir, name)}" + ", ".join(render.SUFFIXES))
        return code
    finally:
        files.unpersist()


def main() -> None:
    spark = SparkSession.builder.appName("sievelake").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    code = run(spark, sys.argv[1:], ask=ask_terminal if sys.stdin.isatty() else None)
    spark.stop()
    sys.exit(code)


if __name__ == "__main__":
    main()
