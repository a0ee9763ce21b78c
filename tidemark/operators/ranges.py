"""Views of key ranges, ordered and reverse scans, and paging.  All filters are on the key, and so reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def head(rows: DataFrame, end, inclusive: bool = False) -> DataFrame:
    return rows.where(F.col("k") <= F.lit(end) if inclusive else F.col("k") < F.lit(end))


def tail(rows: DataFrame, start, inclusive: bool = True) -> DataFrame:
    return rows.where(F.col("k") >= F.lit(start) if inclusive else F.col("k") > F.lit(start))


def slice_(rows: DataFrame, start=None, start_inclusive: bool = True, end=None, end_inclusive: bool = False) -> DataFrame:
    """Rows between two keys; None is no limit.  Views nest: limits of all filters hold."""
    out = rows if start is None else tail(rows, start, start_inclusive)
    return out if end is None else head(out, end, end_inclusive)


def scan(rows: DataFrame, reverse: bool = False, start=None, inclusive: bool = True, order: Column | None = None) -> DataFrame:
    """Rows in key order, or against it, from a start on.  ``order`` replaces the key's own order."""
    if start is not None:
        rows = head(rows, start, inclusive) if reverse else tail(rows, start, inclusive)
    key = F.col("k") if order is None else order
    return rows.orderBy(key.desc() if reverse else key.asc())


def page(rows: DataFrame, after=None, size: int = 1000) -> DataFrame:
    """The next rows in key order, strictly after the last key of the page before."""
    return scan(rows if after is None else tail(rows, after, inclusive=False)).limit(size)
