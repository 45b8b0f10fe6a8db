"""Normalised Indel similarity 2 * LCS / (length + length): an Arrow UDF, and a native form for short strings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of `a`."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for ch in b:
        hit = open_ & places.get(ch, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()


def ratio(a: str | None, b: str | None) -> float:
    a, b = a or "", b or ""
    return 1.0 if a == b else 2.0 * lcs(a, b) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of normalised strings; equal ones (also both empty) give 1."""
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def length_bound(a: Column, b: Column, least: float) -> Column:
    """Whether lengths allow a similarity of `least`: no pair is lost by this filter."""
    la, lb = F.length(a), F.length(b)
    return (F.least(la, lb) >= F.greatest(la, lb) * (least / (2 - least))) | (a == b)
