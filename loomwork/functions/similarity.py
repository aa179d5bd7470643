"""Similarities of strings, in Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro(a: str, b: str) -> float:
    """Jaro similarity: matches within half the longer length, transpositions halved."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used, strict=True) if u]
    swapped = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    """Jaro similarity raised by a common prefix of up to four characters, for similarities above 0.7."""
    s = jaro(a, b)
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return s + prefix * weight * (1 - s) if s > 0.7 else s


def indel_ratio(a: str, b: str) -> float:
    """100 (1 - insertions and deletions / sum of lengths)."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        above = 0
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], above + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


@lru_cache(200_000)
def _score(name: str, a: str, b: str) -> float:
    return {"jaro_winkler": jaro_winkler, "token_sort": token_sort_ratio}[name](a, b)


def _column(name: str, a: Column | str, b: Column | str) -> Column:
    @F.pandas_udf("double")
    def similarity(x: pd.Series, y: pd.Series) -> pd.Series:
        from loomwork.functions.similarity import _score

        return pd.Series([None if p is None or q is None else _score(name, p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return similarity(a, b)


def jaro_winkler_column(a: Column | str, b: Column | str) -> Column:
    return _column("jaro_winkler", a, b)


def token_sort_column(a: Column | str, b: Column | str) -> Column:
    return _column("token_sort", a, b)
