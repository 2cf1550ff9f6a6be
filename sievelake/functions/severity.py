"""Severities are strings with a rank; comparisons are made on the rank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ordered severities, tiers and tool severities.
SEVERITIES = ("info", "low", "medium", "high", "critical")
TIERS = {"rules": 1, "local_llm": 2, "cloud_llm": 3}
SEMGREP = {"ERROR": "high", "WARNING": "medium", "INFO": "low"}
EMOJI = {"critical": "🛑", "high": "🔴", "medium": "🟡", "low": "🔵", "info": "⚪"}
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"


def lookup(column: Column, table: dict, default) -> Column:
    """The value of a small fixed table; null and other keys give the default."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, column), F.lit(default))


def parse(column: Column) -> Column:
    """Trimmed, lower-cased severity; anything unknown is medium."""
    name = F.lower(F.btrim(column, F.lit(WHITE)))
    return F.when(name.isin(*SEVERITIES), name).otherwise("medium")


def rank(column: Column) -> Column:
    return lookup(column, {s: k for k, s in enumerate(SEVERITIES)}, -1)


def of_rank(column: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), column + 1)


def ruff(code: Column) -> Column:
    """By the code's beginning, the first that holds."""
    high = code.startswith("S") | code.startswith("E9") | code.startswith("F82")
    return F.when(high, "high").when(code.startswith("F") | code.startswith("B"), "medium").otherwise("low")


def semgrep(level: Column) -> Column:
    return lookup(F.coalesce(level, F.lit("WARNING")), SEMGREP, "medium")


def eslint(level: Column) -> Column:
    return F.when(level == 2, "medium").otherwise("low")


def tier_priority(tier: Column) -> Column:
    return lookup(tier, TIERS, 0)


def emoji(severity: Column) -> Column:
    return lookup(severity, EMOJI, "")
