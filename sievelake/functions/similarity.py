"""Ratcliff-Obershelp similarity of titles; it isn't symmetric: the new title comes first."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Fixed value: the least ratio of similar titles.
SIMILAR = 0.6


@lru_cache(maxsize=100_000)
def ratio(new: str, old: str) -> float:
    return SequenceMatcher(None, new.lower(), old.lower()).ratio()


@F.pandas_udf(DoubleType())
def title_ratio(new: pd.Series, old: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else ratio(a, b) for a, b in zip(new, old)], dtype="float64")
