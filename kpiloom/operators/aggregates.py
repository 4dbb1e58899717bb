"""Aggregation building blocks.

All of them are ``groupBy``/``groupingSets`` aggregates, so Spark runs a
partial (map-side) aggregate before the shuffle: a hot key costs one row per
map task, not a third of the input in one reducer. Distinct counts are
planned as an aggregate on (keys, value) first, which spreads a hot key over
its distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVEL_COL = "level"


def first_by(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str] | None = None,
             out: str | None = None) -> DataFrame:
    """First ``value`` per key.

    ``order=None``: first after an ascending sort of ``value`` itself with
    NULLs last, i.e. ``min(value)``. With ``order``: the value on the row with
    the smallest ``order`` tuple (SQL expressions), NULL included (``min_by``); this pins the
    otherwise arrival-order dependent ``first``.
    """
    out = out or value
    if order is None:
        agg = F.min(value)
    else:
        key = F.struct(*map(F.expr, order))
        agg = F.min_by(F.col(value), key)
    return df.groupBy(*keys).agg(agg.alias(out))


def cohort_counts(df: DataFrame, keys: Sequence[str], user: str, first_col: str,
                  order: Sequence[str] | None = None, out_date: str = "date",
                  out_count: str = "count") -> DataFrame:
    """First event per (keys, user), then users per (keys, first date)."""
    firsts = first_by(df, [*keys, user], first_col, order, out=out_date)
    return firsts.groupBy(*keys, out_date).agg(F.count(F.lit(1)).alias(out_count))


def _level_of(gid_col: str, n: int) -> Column:
    # grouping sets are prefixes of the level keys, so the level is the number
    # of keys kept: n - popcount(grouping_id)
    return (F.lit(n) - F.bit_count(F.col(gid_col))).cast("int")


def level_sets(df: DataFrame, levels: Sequence[str], aggs: Sequence[Column],
               include_total: bool = True, empty: dict | None = None) -> DataFrame:
    """Aggregate at each prefix of ``levels`` and at the grand total.

    Equivalent to ``rollup(*levels)`` (one Expand + one partial/final
    aggregate, a single pass over ``df``), but the result carries ``level``
    (0 = total, 1 = first key, ...) computed from ``grouping_id()``, so a NULL
    key in the data is never mistaken for a subtotal. ``rollup`` returns no
    total row on empty input; here the total row always exists: on empty
    input its measures come from ``empty`` (e.g. counts 0), others NULL.
    """
    levels = list(levels)
    n = len(levels)
    sets = ([[]] if include_total else []) + [levels[: i + 1] for i in range(n)]
    grouped = (df.groupingSets(sets, *levels)
               .agg(*aggs, F.grouping_id(*levels).alias("__gid"))
               .withColumn(LEVEL_COL, _level_of("__gid", n)).drop("__gid"))
    if not include_total:
        return grouped
    # the total row of the data (absent on empty input) or else a default row
    # (measures from ``empty``, others NULL): stack both, keep the preferred
    empty = empty or {}
    types = {f.name: f.dataType for f in grouped.schema.fields}
    cols = grouped.columns
    default = df.sparkSession.range(1).select(*[
        (F.lit(0).cast(types[c]) if c == LEVEL_COL else F.lit(empty.get(c)).cast(types[c])).alias(c)
        for c in cols])
    both = (grouped.filter(F.col(LEVEL_COL) == 0).withColumn("__pref", F.lit(1))
            .unionByName(default.withColumn("__pref", F.lit(0))))
    total = both.agg(F.max_by(F.struct(*cols), F.col("__pref")).alias("__t")).select("__t.*")
    return grouped.filter(F.col(LEVEL_COL) > 0).unionByName(total)


def users_by_level(df: DataFrame, levels: Sequence[str], user: Sequence[str], day: str) -> DataFrame:
    """One row per user and level where the user occurs: (``user``, level, ``levels``, days).

    Each user is one row with its set of (levels, day); the levels' rows are
    made from that set, so distinct users of all levels come from one shuffle
    of the distinct facts and nothing is expanded before it. ``days`` is the
    set of the user's days there; a NULL day is no day. A user seen in two
    cities has one row in the total and one for each city; NULL keys are keys
    like others, and a NULL user is one user. The set of one user is bounded by
    areas times days, whatever the number of its rows.
    """
    levels = list(levels)
    seen = df.groupBy(*user).agg(F.collect_set(F.struct(*levels, F.col(day).alias("__day"))).alias("__seen"))

    def rows_of(n: int) -> Column:
        kept = levels[:n]

        def row(k: Column) -> Column:
            here = F.filter("__seen", lambda x: _all_same(x, k, kept)) if kept else F.col("__seen")
            days = F.array_compact(F.array_distinct(F.transform(here, lambda x: x["__day"])))
            keys = [(k[c] if c in kept else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in levels]
            return F.struct(F.lit(n).alias(LEVEL_COL), *keys, days.alias("days"))

        if not kept:
            return F.array(row(None))
        return F.transform(F.array_distinct(F.transform("__seen", lambda x: F.struct(*[x[c].alias(c) for c in kept]))), row)

    return seen.select(*user, F.explode(F.concat(*[rows_of(n) for n in range(len(levels) + 1)])).alias("__row")).select(*user, "__row.*")


def _all_same(x: Column, k: Column, names: Sequence[str]) -> Column:
    out = x[names[0]].eqNullSafe(k[names[0]])
    for c in names[1:]:
        out = out & x[c].eqNullSafe(k[c])
    return out


def repeat_rate(df: DataFrame, levels: Sequence[str], user: str, day: str, min_days: int = 2,
                count_name: str = "user_count", repeat_name: str = "repeat_count",
                rate_name: str = "repeat_rate") -> DataFrame:
    """Users and users active on >= ``min_days`` distinct days, per level.

    One row a user with all its levels (``users_by_level``), then counts per
    level: a user seen in two cities counts once in the total and once per
    city, and counts are never summed across levels. Days may be any number
    and lie anywhere; a NULL day is no day.
    """
    per_user = users_by_level(df, levels, [user], day)
    out = (per_user.groupBy(LEVEL_COL, *levels)
           .agg(F.count(F.lit(1)).alias(count_name),
                F.count_if(F.size("days") >= min_days).alias(repeat_name)))
    return out.withColumn(rate_name, F.try_divide(F.col(repeat_name), F.col(count_name)))


def append_total(df: DataFrame, label_col: str, label: str, group_keys: Sequence[str],
                 sums: Sequence[str]) -> DataFrame:
    """Append rows ``label_col = label`` holding the sums of ``sums`` per
    ``group_keys`` (re-aggregating already dense rows)."""
    total = (df.groupBy(*group_keys).agg(*[F.sum(c).alias(c) for c in sums])
             .withColumn(label_col, F.lit(label)))
    return df.unionByName(total, allowMissingColumns=False) if set(df.columns) == set(total.columns) \
        else df.unionByName(total, allowMissingColumns=True)
