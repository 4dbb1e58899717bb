"""Window operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[Column], n: int,
          rank_col: str | None = None) -> DataFrame:
    """First ``n`` rows per group after sorting by ``order_by``.

    ``row_number() <= n`` lets Catalyst insert a partial ``WindowGroupLimit``
    before the shuffle, so each map task forwards at most ``n`` rows per group;
    a hot group never reaches one reducer whole. Give a unique tie-break as
    the last ``order_by`` entry for a deterministic cut.
    """
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    rn = rank_col or "__rn"
    out = df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= n)
    return out if rank_col else out.drop(rn)


def peaks(df: DataFrame, partition_by: Sequence[str], cols: Sequence[str],
          suffixes: dict | None = None) -> DataFrame:
    """Per-group max/min flags and mean.

    For each ``c``: ``<c>_max`` is ``c`` on rows equal to the group maximum
    (ties all kept), else NULL; likewise ``<c>_min``; ``<c>_avg`` is the group
    mean on every row. Intended for grid-bounded inputs (one row per group
    member of a parameter grid), where a window partition is small.
    """
    w = Window.partitionBy(*partition_by)
    out = df
    names = suffixes or {}
    for c in cols:
        stem = names.get(c, c)
        out = out.withColumns({
            f"{stem}_max": F.when(F.col(c) == F.max(c).over(w), F.col(c)),
            f"{stem}_min": F.when(F.col(c) == F.min(c).over(w), F.col(c)),
            f"{stem}_avg": F.avg(c).over(w),
        })
    return out
