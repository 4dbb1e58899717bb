"""Property tests: operators vs brute force on random, skewed small frames
(one city holds a large share of the rows)."""

import datetime as dt
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kpiloom.functions.semantics import n_distinct, strict_sum
from kpiloom.operators.aggregates import level_sets, repeat_rate
from kpiloom.operators.windows import top_n

CITIES = ["hot", "a", "b", None]
row = st.tuples(
    st.sampled_from(CITIES + ["hot"] * 4),                 # skew: "hot" dominates
    st.sampled_from(["d1", "d2", None]),
    st.sampled_from(["u1", "u2", "u3", "u4", None]),
    st.integers(0, 3),
    st.one_of(st.none(), st.floats(0, 100, allow_nan=False).map(lambda x: round(x, 2))),
)
SET = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
SCHEMA = "city string, district string, user string, day int, v double"


def _df(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@SET
@given(st.lists(row, max_size=40))
def test_level_sets_matches_brute_force(spark, data):
    out = level_sets(_df(spark, data), ["city", "district"],
                     [F.count(F.lit(1)).alias("n"), n_distinct("user").alias("u"), strict_sum("v").alias("s")],
                     empty={"n": 0, "u": 0, "s": 0.0})
    got = {(r.level, r.city, r.district): (r.n, r.u, r.s) for r in out.collect()}
    groups = defaultdict(list)
    for c, d, u, day, v in data:
        groups[(0, None, None)].append((u, v))
        groups[(1, c, None)].append((u, v))
        groups[(2, c, d)].append((u, v))
    exp = {}
    for k, rs in groups.items():
        vs = [v for _, v in rs]
        s = None if any(v is None for v in vs) else sum(vs)
        exp[k] = (len(rs), len({u for u, _ in rs}), s)
    if not data:
        exp = {(0, None, None): (0, 0, 0)}
    assert set(got) == set(exp)
    for k in exp:
        n, u, s = got[k]
        assert (n, u) == exp[k][:2]
        assert (s is None and exp[k][2] is None) or abs(s - exp[k][2]) < 1e-6


@SET
@given(st.lists(row, max_size=40))
def test_repeat_rate_matches_brute_force(spark, data):
    out = repeat_rate(_df(spark, data), ["city", "district"], "user", "day")
    got = {(r.level, r.city, r.district): (r.user_count, r.repeat_count) for r in out.collect()}
    days = defaultdict(set)
    for c, d, u, day, v in data:
        days[(0, None, None, u)].add(day)
        days[(1, c, None, u)].add(day)
        days[(2, c, d, u)].add(day)
    exp = defaultdict(lambda: [0, 0])
    for (lvl, c, d, u), ds in days.items():
        exp[(lvl, c, d)][0] += 1
        exp[(lvl, c, d)][1] += len(ds) >= 2
    assert got == {k: tuple(v) for k, v in exp.items()}


@SET
@given(st.lists(row, max_size=40), st.integers(1, 4))
def test_top_n_matches_brute_force(spark, data, n):
    df = _df(spark, data).groupBy("city", "user").agg(F.count(F.lit(1)).alias("q"))
    out = top_n(df, ["city"], [F.col("q").desc(), F.col("user").asc_nulls_last()], n)
    got = sorted(((r.city or ""), (r.user or "~"), r.q) for r in out.collect())
    counts = defaultdict(int)
    for c, d, u, day, v in data:
        counts[(c, u)] += 1
    per = defaultdict(list)
    for (c, u), q in counts.items():
        per[c].append((-q, (u is None, u or ""), u))
    exp = []
    for c, lst in per.items():
        for negq, _, u in sorted(lst)[:n]:
            exp.append(((c or ""), (u or "~"), -negq))
    assert got == sorted(exp)


@SET
@given(st.lists(row, max_size=40))
def test_repeat_rate_equals_plain_counts(spark, data):
    df = _df(spark, data).withColumn("d", F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("day")))
    a = repeat_rate(df, ["city", "district"], "user", "d")
    days = {}
    for r in df.collect():
        for key in ((0, None, None), (1, r.city, None), (2, r.city, r.district)):
            days.setdefault((key, r.user), set()).add(r.d)
    want = {}
    for (key, _), seen in days.items():
        n, again = want.get(key, (0, 0))
        want[key] = (n + 1, again + (len(seen - {None}) >= 2))
    assert {(r.level, r.city, r.district): (r.user_count, r.repeat_count) for r in a.collect()} == want


def test_repeat_rate_over_any_days(spark):
    d = dt.date
    df = spark.createDataFrame([("u", d(2024, 1, 1)), ("u", d(2024, 1, 1)), ("u", d(2024, 3, 31)), ("v", d(2024, 1, 2))], "u string, d date")
    assert [(r.user_count, r.repeat_count) for r in repeat_rate(df, [], "u", "d").collect()] == [(2, 1)]
