"""Measures by level in one pass: table2 plans no Expand and runs few jobs."""

import uuid

from helpers import SF_SMALL, rows
from kpiloom.operators.aggregates import LEVEL_COL, repeat_rate, users_by_level
from kpiloom.plans import reports as R
from kpiloom.plans.facts import KeyedFrames, Model
from kpiloom.sources.bindings import kpi_params, test_raw_tables as bound_tables


def test_users_have_one_row_a_level(spark):
    df = spark.createDataFrame([("a", "x", "u", 1), ("a", "x", "u", 1), ("a", "y", "u", 2), ("b", None, "u", 2), ("a", "x", "v", None),
                                (None, None, None, 3)], "city string, district string, user string, day int")
    got = {(r.user, r[LEVEL_COL], r.city, r.district): sorted(r.days) for r in users_by_level(df, ["city", "district"], ["user"], "day").collect()}
    assert got == {("u", 0, None, None): [1, 2], ("u", 1, "a", None): [1, 2], ("u", 1, "b", None): [2], ("u", 2, "a", "x"): [1], ("u", 2, "a", "y"): [2],
                   ("u", 2, "b", None): [2], ("v", 0, None, None): [], ("v", 1, "a", None): [], ("v", 2, "a", "x"): [],
                   (None, 0, None, None): [3], (None, 1, None, None): [3], (None, 2, None, None): [3]}
    assert rows(repeat_rate(df, ["city", "district"], "user", "day").filter("level = 0"), "user_count", "repeat_count") == [(3, 1)]
    assert users_by_level(df.limit(0), ["city"], ["user"], "day").count() == 0


def test_table2_plans_no_expand_and_runs_few_jobs(spark, tmp_path):
    m = Model(bound_tables(spark, SF_SMALL, "events"), kpi_params())
    k: KeyedFrames = m.keyed
    lazy = R.report_visits_orders(m, with_level=True)
    assert "Expand" not in lazy._jdf.queryExecution().executedPlan().toString()
    for name in ("orders_window", "logins_window"):   # stored, as a daily run has them
        path = f"{tmp_path}/{name}"
        getattr(k, name).write.parquet(path)
        k.__dict__[name] = spark.read.parquet(path)
    for name in ("order_days", "login_days"):
        k.__dict__.pop(name, None)
    df = R.report_visits_orders(m, with_level=True)
    assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "table2")
    try:
        got = sorted(map(str, df.collect()))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert 0 < len(jobs) < 15
    assert got == sorted(map(str, lazy.collect()))
