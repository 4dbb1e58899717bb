"""Dense grids, densify and fixed-key pivots.

A grid is the cartesian product of parameter lists (cities, days, labels),
generated with ``explode`` (no join): its size is bounded by the report
parameters, never by the data, so it is always safe to broadcast.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kpiloom.functions.semantics import zero_fill


def values_frame(spark: SparkSession, name: str, values: Sequence, dtype=None) -> DataFrame:
    """One-column frame of parameter values."""
    dtype = dtype or StringType()
    return spark.createDataFrame([(v,) for v in values], StructType([StructField(name, dtype, True)]))


def date_series(spark: SparkSession, start: dt.date, end: dt.date, name: str = "date") -> DataFrame:
    """Inclusive 1-day series ``start .. end``."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias(name))


def _values_col(values) -> Column:
    """Array column of parameter values: a list/tuple of literals, or a
    ``(start_date, end_date)`` pair given as ``DateRange``."""
    if isinstance(values, DateRange):
        return F.sequence(F.lit(values.start), F.lit(values.end))
    return F.array(*[F.lit(v) for v in values])


class DateRange:
    """Inclusive day range used as a grid dimension."""

    def __init__(self, start: dt.date, end: dt.date):
        self.start, self.end = start, end


def expand(df: DataFrame, **dims) -> DataFrame:
    """Attach every combination of parameter values to each row of ``df``.

    ``expand(df, city=[...], date=DateRange(a, b))`` is the cartesian product
    of ``df`` with the parameter lists, generated by ``explode`` within each
    row (no join, no shuffle); the output is ``|df|`` times the product of the
    list lengths, all bounded by the report parameters.
    """
    for name, values in dims.items():
        df = df.withColumn(name, F.explode(_values_col(values)))
    return df


def param_grid(spark: SparkSession, **dims) -> DataFrame:
    """Grid of all combinations of parameter lists (``expand.grid``), in the
    given column order, e.g. ``param_grid(spark, city=cities, date=DateRange(a, b))``."""
    base = spark.range(1).select()
    return expand(base, **dims)


def densify(agg: DataFrame, grid: DataFrame, keys: Sequence[str], fill_cols: Sequence[str] = (),
            fill_value=0, unique: bool = True) -> DataFrame:
    """Every grid cell once; measures from ``agg`` where present.

    ``agg`` rows outside the grid vanish (right join onto the grid). Plan: the
    aggregate is first reduced to grid cells by a semi-join against the
    broadcast grid (streams the aggregate, no shuffle of it). With
    ``unique=True`` (``agg`` has one row per key, e.g. it is grouped by
    ``keys``) that remainder has at most one row per grid cell -- a bound set
    by the parameters -- so it is broadcast into the final left join too.
    """
    keys = list(keys)
    inside = agg.join(F.broadcast(grid.select(*keys)), keys, "left_semi")
    out = grid.join(F.broadcast(inside) if unique else inside, keys, "left")
    return zero_fill(out, list(fill_cols), fill_value) if fill_cols else out


def pivot_fixed(df: DataFrame, keys: Sequence[str], pivot_col: str, value_col: str,
                values: Sequence, names: dict | None = None, agg: str = "sum") -> DataFrame:
    """Long -> wide with a fixed list of pivot values.

    Listing the values keeps the output schema independent of the data and
    avoids the extra job Spark runs to discover them. ``names`` renames the
    pivoted columns (value -> column name).
    """
    fn = {"sum": F.sum, "first": F.first, "max": F.max}[agg]
    out = df.groupBy(*keys).pivot(pivot_col, list(values)).agg(fn(value_col))
    if names:
        out = out.withColumnsRenamed({str(v): names[v] for v in values if v in names})
    return out


def date_span(df: DataFrame, col: str, name: str = "date") -> DataFrame:
    """Every day between the first and last date of ``df[col]`` (inclusive),
    one row per day. The bounds come from one global min/max aggregate; the
    series size is the number of days spanned, not the number of rows."""
    bounds = df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    return bounds.select(F.explode(F.sequence("__lo", "__hi")).alias(name))
