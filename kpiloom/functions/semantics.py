"""Column helpers with the NULL semantics the reports rely on.

All helpers return plain Catalyst expressions (no UDF), so they stay inside
whole-stage codegen and are pushed down where Spark can push them.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def if_else(cond: Column, yes, no) -> Column:
    """Conditional whose NULL condition yields NULL (not the else branch)."""
    return F.when(cond, _lit(yes)).when(~cond, _lit(no))


def in_set(c, values: Iterable) -> Column:
    """Total membership: NULL input gives FALSE, never NULL."""
    return F.coalesce(_col(c).isin(list(values)), F.lit(False))


def not_in_set(c, values: Iterable) -> Column:
    """Total non-membership: a NULL input is kept (TRUE)."""
    return ~in_set(c, values)


def sql_not_in(c, values: Iterable) -> Column:
    """SQL ``NOT IN`` as a filter: NULL input is dropped."""
    return _col(c).isNotNull() & ~_col(c).isin(list(values))


def strict_sum(c) -> Column:
    """Sum that is NULL when any input is NULL and 0 on an empty group."""
    c = _col(c)
    return F.when(F.count(F.lit(1)) == F.count(c), F.coalesce(F.sum(c), F.lit(0)))


def n_distinct(c) -> Column:
    """Exact distinct count that counts NULL as one value."""
    c = _col(c)
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))


def ratio(a, b) -> Column:
    """a / b, NULL when b is 0 or NULL (instead of Inf/NaN or an error)."""
    return F.try_divide(_col(a), _col(b))


def fill_missing(c, default, is_float: bool = False) -> Column:
    """NULL (and NaN for floating columns) -> default."""
    c = _col(c)
    if is_float:
        return F.when(c.isNull() | F.isnan(c), _lit(default)).otherwise(c)
    return F.coalesce(c, _lit(default))


def zero_fill(df, cols: Sequence[str], value=0):
    """Replace NULL/NaN by ``value`` in ``cols``; other columns untouched."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    return df.withColumns({
        c: fill_missing(c, value, isinstance(types[c], (DoubleType, FloatType)))
        for c in cols
    })


def path_part(c, delim: str, n: int, i: int) -> Column:
    """Piece ``i`` (1-based) of splitting into at most ``n`` pieces.

    The last piece holds the rest of the text; a missing piece is ''. A NULL
    input stays NULL. ``delim`` is a literal string.
    """
    import re

    c = _col(c)
    parts = F.split(c, re.escape(delim), n)
    return F.when(c.isNotNull(), F.coalesce(F.get(parts, i - 1), F.lit("")))


def blank_to_null(c, min_len: int = 2) -> Column:
    """Text shorter than ``min_len`` characters becomes NULL."""
    c = _col(c)
    return F.when(F.length(c) >= min_len, c)


def bucket(c, thresholds: Sequence, labels: Sequence[str]) -> Column:
    """Label by ``c <= t_i``; above the last threshold gets the last label.

    ``len(labels) == len(thresholds) + 1``. NULL input stays NULL.
    """
    c = _col(c)
    out = F
    for t, lab in zip(thresholds, labels):
        out = out.when(c <= F.lit(t), F.lit(lab))
    return out.when(c > F.lit(thresholds[-1]), F.lit(labels[-1]))


def flag_decode(c) -> Column:
    """BIT(1)/boolean flag -> 1/0 integer, NULL stays NULL."""
    c = _col(c)
    return F.when(c, F.lit(1)).when(~c, F.lit(0))


def to_day(c) -> Column:
    """Timestamp -> date (time of day dropped)."""
    return F.to_date(_col(c))


def channel_of_delivery_method(c) -> Column:
    """delivery_method code -> table4 channel column name, NULL stays NULL."""
    from kpiloom.params import DELIVERY_METHOD_LABELS as L

    c = _col(c)
    return F.when(c == 0, L[0]).when(c == 1, L[1]).when(~c.isin(0, 1), L[2])


def ship_status_simple(c) -> Column:
    """shipping_status -> returned / refused / normal, NULL stays NULL."""
    from kpiloom.params import SHIPPING_REFUSED, SHIPPING_RETURNED

    c = _col(c)
    return (F.when(in_set(c, SHIPPING_RETURNED), "returned")
            .when(c == SHIPPING_REFUSED, "refused")
            .when(c != SHIPPING_REFUSED, "normal"))


def weekend_window_start(d) -> Column:
    """Monday -> the Saturday before, any other day -> the day before."""
    d = _col(d)
    return F.when(F.weekday(d) == 0, F.date_sub(d, 2)).otherwise(F.date_sub(d, 1))


def money(c, scale: int | None) -> Column:
    """Round a monetary aggregate when a report scale is configured."""
    return F.round(c, scale) if scale is not None else c
