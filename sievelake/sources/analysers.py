"""Running external analysers: batches of files in, their JSON out, one payload a batch.

A tool runs where its batch is, in the work tree, which all executors must be able to
read (in local mode they do). Only programs on the PATH are run, never one
that the reviewed tree brings along. What a tool writes is read by sources/linters.py.
"""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from sievelake.operators import scope
from sievelake.sources.linters import SUFFIXES


@dataclass(frozen=True)
class Analyser:
    """command: its arguments before the paths; fine: the exit codes after which its output counts (any if None); configs: files of which the tree must have one."""

    name: str
    command: tuple[str, ...]
    fine: tuple[int, ...] | None = None
    configs: tuple[str, ...] = ()

    def missing(self, root: str) -> str | None:
        """Why the tool can't run here, or None."""
        if self.configs and not any((Path(root) / c).is_file() for c in self.configs):
            return f"no {self.name} config found in repo"
        if shutil.which(self.command[0]) is None:
            return f"{self.name} {'binary ' if self.configs else ''}not found on PATH"
        return None


#: The tools' arguments, exit codes and names of configuration files.
ANALYSERS = (
    Analyser("ruff", ("ruff", "check", "--output-format=json", "--"), (0, 1)),
    Analyser("eslint", ("eslint", "--format=json", "--"), None, tuple("eslint.config.js eslint.config.mjs eslint.config.cjs .eslintrc .eslintrc.js .eslintrc.cjs .eslintrc.json .eslintrc.yml .eslintrc.yaml".split())),
    Analyser("semgrep", ("semgrep", "--config=auto", "--metrics=off", "--json", "--quiet", "--")),
)
#: Files given to one call.
BATCH = 500


def payloads(tool: Analyser, files: DataFrame, root: str, batch: int = BATCH) -> DataFrame:
    """payload: what the tool wrote about each batch of the targets that are its business."""
    suffixes = SUFFIXES.get(tool.name)
    program = shutil.which(tool.command[0])  # the one that was looked for, whatever a worker's PATH is
    paths = (scope.with_suffix(files, suffixes) if suffixes else scope.live(files)).select("path")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [x for x in b.column(0).to_pylist() if x is not None]
            for k in range(0, len(names), batch):
                done = subprocess.run([program, *tool.command[1:], *names[k : k + batch]], cwd=root, capture_output=True, check=False)
                if tool.fine is None or done.returncode in tool.fine:
                    yield pa.RecordBatch.from_arrays([pa.array([done.stdout.decode("utf-8", "replace")])], ["payload"])

    return paths.mapInArrow(run, "payload string")


def outputs(files: DataFrame, root: str, wanted: dict[str, bool]) -> tuple[dict[str, DataFrame], list[str]]:
    """Payloads of each tool that is wanted and there, and the skip entries of those that aren't there."""
    out, skips = {}, []
    for tool in ANALYSERS:
        if not wanted.get(tool.name, True):
            continue
        if reason := tool.missing(root):
            skips.append(f"rules: {tool.name}: {reason}")
        else:
            out[tool.name] = payloads(tool, files, root)
    return out, skips
