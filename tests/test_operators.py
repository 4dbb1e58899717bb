"""Operator-level tests on inline frames."""

import datetime as dt

from pyspark.sql import functions as F

from helpers import rows
from kpiloom.operators import aggregates as A
from kpiloom.operators import grid as G
from kpiloom.operators import relational as J


def test_repeat_rate_user_in_two_cities(spark):
    d = dt.date
    df = spark.createDataFrame([("c1", "x", "u", d(2024, 1, 1)), ("c2", "y", "u", d(2024, 1, 2)),
                                ("c1", "x", "v", d(2024, 1, 1)), ("c1", "x", "v", d(2024, 1, 1))],
                               "city string, district string, username string, day date")
    out = A.repeat_rate(df, ["city", "district"], "username", "day")
    got = rows(out, "level", "city", "district", "user_count", "repeat_count")
    # total: u has 2 days -> repeat; per city u has 1 day each
    assert got == [(0, None, None, 2, 1), (1, "c1", None, 2, 0), (1, "c2", None, 1, 0),
                   (2, "c1", "x", 2, 0), (2, "c2", "y", 1, 0)]


def test_densify_drops_outside_grid(spark):
    grid = G.param_grid(spark, city=["a", "b"], k=["x"])
    agg = spark.createDataFrame([("a", "x", 1), ("z", "x", 5)], "city string, k string, v long")
    out = G.densify(agg, grid, ["city", "k"], ["v"])
    assert rows(out) == [("a", "x", 1), ("b", "x", 0)]


def test_pivot_fixed_stable_schema(spark):
    df = spark.createDataFrame([("a", "m1", 1.0), ("a", "m1", 2.0)], "city string, m string, v double")
    out = G.pivot_fixed(df, ["city"], "m", "v", ["m1", "m2"], {"m1": "one", "m2": "two"})
    assert out.columns == ["city", "one", "two"]
    assert rows(out) == [("a", 3.0, None)]


def test_param_grid_and_expand(spark):
    g = G.param_grid(spark, city=["a", "b"], day=G.DateRange(dt.date(2024, 1, 1), dt.date(2024, 1, 3)), m=["x", "y"])
    assert g.columns == ["city", "day", "m"] and g.count() == 12
    assert "Join" not in g._jdf.queryExecution().executedPlan().toString()
    base = spark.createDataFrame([("c1",), ("c2",)], "cate string")
    assert G.expand(base, city=["a", "b", "c"]).count() == 6


def test_date_series_and_span(spark):
    s = G.date_series(spark, dt.date(2024, 1, 1), dt.date(2024, 1, 7))
    assert s.count() == 7
    df = spark.createDataFrame([(dt.date(2024, 1, 3),), (dt.date(2024, 1, 1),)], "d date")
    assert [r.date for r in G.date_span(df, "d").collect()] == [dt.date(2024, 1, d) for d in (1, 2, 3)]


def test_mark_dedupes_members(spark):
    df = spark.createDataFrame([("1",), ("2",), (None,)], "sn string")
    mem = spark.createDataFrame([("1",), ("1",), (None,)], "sn string")
    assert rows(J.mark(df, mem, "sn", "flag")) == [(None, 0), ("1", 1), ("2", 0)]


def test_in_window_timestamp_quirk(spark):
    T = dt.datetime
    df = spark.createDataFrame([(T(2024, 1, 1, 0, 0),), (T(2024, 1, 1, 0, 1),), (T(2024, 1, 7, 23, 59, 59),),
                                (T(2024, 1, 8, 0, 0),)], "ts timestamp_ntz")
    out = J.in_window(df, "ts", dt.date(2024, 1, 1), dt.date(2024, 1, 7), timestamp=True)
    # the start day after midnight passes "> start"
    assert out.count() == 2
    assert J.in_window(df, "ts", dt.date(2024, 1, 1), dt.date(2024, 1, 7), closed="both", timestamp=True).count() == 3


def test_join_with_suffix(spark):
    a = spark.createDataFrame([("1", "d", "pa")], "sn string, dealer_id string, name string")
    b = spark.createDataFrame([("d", "S1", "sup")], "dealer_id string, sn string, supplier string")
    out = J.join_with_suffix(a, b, "dealer_id")
    assert sorted(out.columns) == ["dealer_id", "name", "sn_x", "sn_y", "supplier"]


def test_append_total(spark):
    df = spark.createDataFrame([("a", "e1", 1), ("b", "e1", 2)], "city string, eff string, n long")
    out = A.append_total(df, "city", "ALL", ["eff"], ["n"])
    assert rows(out) == [("ALL", "e1", 3), ("a", "e1", 1), ("b", "e1", 2)]


def test_top_n_uses_group_limit(spark):
    from kpiloom.operators.windows import top_n

    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    agg = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    out = top_n(agg, ["g"], [F.col("v").desc(), F.col("g")], 5)
    assert out.count() == 15
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
