"""Joins and filters as DataFrame -> DataFrame functions.

Broadcast policy: only frames whose size is bounded by report parameters
(grids, literal lists) get an explicit ``broadcast`` hint. Data-dependent
dimensions are joined plainly: Catalyst broadcasts them when their estimated
size is under ``spark.sql.autoBroadcastJoinThreshold`` and AQE re-plans with
runtime sizes; beyond that the join stays a shuffled sort-merge join whose hot
keys are split by AQE skew handling.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.functions.keys import key_values, keys_like, same_type
from kpiloom.functions.semantics import sql_not_in


def _as_list(on) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def in_window(df: DataFrame, col: str, start: dt.date, end: dt.date,
              closed: str = "right", timestamp: bool = False) -> DataFrame:
    """Keep rows with ``col`` in the report window.

    ``closed='right'``: ``start < col <= end``; ``closed='both'``:
    ``start <= col <= end``. With ``timestamp=True`` the column is a raw
    timestamp and the end bound is ``end 23:59:59`` (time-of-day kept; a
    start-day row after midnight passes ``> start``). Plain comparisons with
    literals, so Parquet/JDBC scans receive them as pushed filters.
    """
    c = F.col(col)
    if timestamp:
        # built from text: a wall-clock literal, independent of the session time zone
        lo = F.lit(f"{start.isoformat()} 00:00:00").cast("timestamp_ntz")
        hi = F.lit(f"{end.isoformat()} 23:59:59").cast("timestamp_ntz")
    else:
        lo, hi = F.lit(start), F.lit(end)
    lower = (c >= lo) if closed == "both" else (c > lo)
    return df.filter(lower & (c <= hi))


class Accounts(NamedTuple):
    """Accounts to exclude: a one-column frame (or None) and literals added to it."""

    frame: DataFrame | None
    literals: list


def exclude_accounts(df: DataFrame, accounts, key: str = "username") -> DataFrame:
    """SQL ``key NOT IN (accounts)``: drops listed accounts and NULL keys.

    ``accounts`` is a literal list (pushed into the scan), a one-column
    DataFrame (anti-join; the list grows with the business, so no collect),
    or ``Accounts`` with both.
    """
    if isinstance(accounts, Accounts):
        df = exclude_accounts(df, accounts.literals, key)
        return df if accounts.frame is None else exclude_accounts(df, accounts.frame, key)
    if isinstance(accounts, DataFrame):
        first = accounts.columns[0]
        acc = accounts.select(F.col(first).alias("__acc")).filter(F.col("__acc").isNotNull())
        return (df.filter(F.col(key).isNotNull())
                .join(acc, F.col(key) == F.col("__acc"), "left_anti"))
    return df.filter(sql_not_in(key, accounts))


def keep_matching(df: DataFrame, keys_df: DataFrame, left_on: str, right_on: str | None = None) -> DataFrame:
    """Semi-join: keep rows of ``df`` whose key occurs in ``keys_df``."""
    right_on = right_on or left_on
    k = keys_df.select(F.col(right_on).alias("__k"))
    a, b = same_type(df, left_on, k, "__k")
    return df.join(k, a == b, "left_semi")


def lookup(df: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """Left join with a dimension on one key of the same name; the key keeps the type it has in ``df``."""
    d = dim.withColumnRenamed(on, "__lk")
    a, b = same_type(df, on, d, "__lk")
    return df.join(d, a == b, "left").drop("__lk")


def left_join_renamed(df: DataFrame, other: DataFrame, left_on: str, right_on: str,
                      how: str = "left") -> DataFrame:
    """Equi-join on differently named keys; the right key column is dropped."""
    o = other.withColumnRenamed(right_on, "__rk")
    a, b = same_type(df, left_on, o, "__rk")
    return df.join(o, a == b, how).drop("__rk")


def null_safe_left_join(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """Left join where NULL keys match NULL keys (``<=>``)."""
    keys = _as_list(on)
    o = other.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = c if cond is None else cond & c
    return df.join(o, cond, "left").drop(*[f"__r_{k}" for k in keys])


def mark(df: DataFrame, members: DataFrame, on: str, name: str, members_on: str | None = None) -> DataFrame:
    """Add a 0/1 column: 1 when ``df[on]`` occurs in ``members``.

    ``members`` is deduplicated first so the join never fans out.
    """
    members_on = members_on or on
    m = keys_like(members.select(F.col(members_on).alias("__m")), "__m", df.schema[on].dataType)
    m = m.filter(F.col("__m").isNotNull()).distinct().withColumn(name, F.lit(1))
    a, b = same_type(df, on, m, "__m")
    out = df.join(m, a == b, "left").drop("__m")
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def drop_suffix_users(df: DataFrame, cond_col: str, cond_values, user_col: str, pattern: str) -> DataFrame:
    """Drop rows where ``cond_col`` equals one of ``cond_values`` and the user
    matches ``pattern``. Three-valued, as in ``filter(!(a == v & regex))``:
    a NULL ``cond_col`` with a matching user is dropped too."""
    if not list(cond_values):
        return df
    vals = key_values(df, cond_col, cond_values)
    # spellings that no id has are never equal, but a NULL id stays undecided
    hit = F.col(cond_col).isin(vals) if vals else F.when(F.col(cond_col).isNotNull(), F.lit(False))
    return df.filter(~(hit & F.col(user_col).rlike(pattern)))


def join_with_suffix(left: DataFrame, right: DataFrame, on, how: str = "left",
                     suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Join keeping both copies of same-named non-key columns, renamed with
    ``suffixes`` (``name`` -> ``name_x`` / ``name_y``), instead of leaving two
    ambiguous columns."""
    keys = _as_list(on)
    common = (set(left.columns) & set(right.columns)) - set(keys)
    lx = left.withColumnsRenamed({c: c + suffixes[0] for c in common})
    ry = right.withColumnsRenamed({c: c + suffixes[1] for c in common})
    return lx.join(ry, keys, how)
