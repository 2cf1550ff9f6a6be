"""Waits between attempts at a rate-limited service."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Retries, first and longest wait in seconds.
RETRIES, FIRST, LONGEST = 5, 2.0, 60.0


def retry_after(header: Column) -> Column:
    """Seconds asked for, 0 at least; null if the header isn't a number."""
    seconds = F.btrim(header).try_cast("double")
    return F.when(seconds < 0, 0.0).otherwise(seconds)


def wait(asked: Column, delay: Column) -> Column:
    """The wait: what was asked for (0 counts as nothing asked) or else the delay, LONGEST at most."""
    return F.least(F.coalesce(F.nullif(asked, F.lit(0.0)), delay), F.lit(LONGEST))


def schedule(retries: Column | int = RETRIES) -> Column:
    """The delays of the retries: doubled each time up to LONGEST."""
    n = retries if isinstance(retries, Column) else F.lit(retries)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.least(F.lit(FIRST) * F.pow(F.lit(2.0), k), F.lit(LONGEST)))).otherwise(F.array().cast("array<double>"))
