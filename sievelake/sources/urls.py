"""Predicates and parsers over URLs and error texts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The form of a pull request's URL; what error texts of failed sign-ins contain.
PULL = r"^(https?://[^/\s]+/[^/\s]+/[^/\s]+?)(?:\.git)?/pull/(\d+)(?:/.*)?/?$"
AUTH_ERRORS = (
    "authentication failed", "could not read username", "could not read password", "terminal prompts disabled",
    "permission denied (publickey)", "not found", "invalid username or password", "403",
)


def pull_request(url: Column) -> Column:
    """struct(repo_url, number), or null if it isn't a pull request's URL."""
    text = F.btrim(url)
    return F.when(text.rlike(PULL), F.struct(F.regexp_extract(text, PULL, 1).alias("repo_url"), F.regexp_extract(text, PULL, 2).try_cast("bigint").alias("number")))


def cloneable(url: Column) -> Column:
    """False for empty URLs, options and transport helpers."""
    marker = F.instr(url, "::")
    helper = (marker > 0) & ~F.substr(url, F.lit(1), marker - 1).contains("/")
    return F.coalesce((url != "") & ~url.startswith("-") & ~helper, F.lit(False))


def auth_error(text: Column) -> Column:
    low, out = F.lower(text), F.lit(False)
    for marker in AUTH_ERRORS:
        out = out | low.contains(marker)
    return out


def base_ref(override: Column, looked_up: Column) -> Column:
    return F.coalesce(override, looked_up, F.lit("main"))
