"""NULL-semantics traps on inline frames."""

import datetime as dt

from pyspark.sql import functions as F

from helpers import rows
from kpiloom.functions import semantics as S


def test_t1_if_else_null_condition_gives_null(spark):
    df = spark.createDataFrame([(1,), (None,), (5,)], "d int")
    out = df.select("d", S.if_else(F.col("d") <= 1, "a", "b").alias("x"))
    assert rows(out) == [(None, None), (1, "a"), (5, "b")]


def test_t1_bucket_null_stays_null(spark):
    df = spark.createDataFrame([(0,), (2,), (3,), (4,), (None,)], "d int")
    out = df.select("d", S.bucket("d", (1, 2, 3), ["1", "2", "3", "3+"]).alias("b"))
    assert rows(out) == [(None, None), (0, "1"), (2, "2"), (3, "3"), (4, "3+")]


def test_t2_total_membership(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    inn = df.select("x", S.in_set("x", ["a"]).alias("i"), S.not_in_set("x", ["a"]).alias("n"))
    assert rows(inn) == [(None, False, True), ("a", True, False), ("b", False, True)]
    # !x %in% excl keeps the NULL row
    assert rows(df.filter(S.not_in_set("x", ["a"])), "x") == [(None,), ("b",)]


def test_t3_sql_not_in_drops_null(spark):
    from kpiloom.operators.relational import exclude_accounts

    df = spark.createDataFrame([("u1",), ("t1",), (None,)], "username string")
    assert rows(exclude_accounts(df, ["t1"])) == [("u1",)]
    acc = spark.createDataFrame([("t1",), (None,)], "a string")
    assert rows(exclude_accounts(df, acc)) == [("u1",)]


def test_t4_null_safe_join(spark):
    from kpiloom.operators.relational import null_safe_left_join

    a = spark.createDataFrame([("c", None, 1), ("c", "d", 2)], "city string, district string, v int")
    b = spark.createDataFrame([("c", None, 10), ("c", "d", 20)], "city string, district string, w int")
    out = null_safe_left_join(a, b, ["city", "district"])
    assert rows(out, "v", "w") == [(1, 10), (2, 20)]


def test_t5_strict_sum(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 3.0)], "k string, v double")
    out = df.groupBy("k").agg(S.strict_sum("v").alias("s"))
    assert rows(out) == [("a", None), ("b", 5.0)]
    empty = df.filter(F.lit(False)).agg(S.strict_sum("v").alias("s"))
    assert empty.collect()[0]["s"] == 0


def test_t6_ratio_zero_denominator_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (3.0, 2.0)], "a double, b double")
    out = df.select(S.ratio("a", "b").alias("r"))
    assert rows(out) == [(None,), (None,), (1.5,)]


def test_t7_n_distinct_counts_null(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("a", "x"), ("b", "y")], "k string, v string")
    out = df.groupBy("k").agg(S.n_distinct("v").alias("n"))
    assert rows(out) == [("a", 2), ("b", 1)]


def test_t8_first_by_order_keeps_null_value(spark):
    from kpiloom.operators.aggregates import first_by
    from kpiloom.plans.reports import ARRIVAL

    d = dt.date
    df = spark.createDataFrame([("u", d(2024, 1, 1), "9", None), ("u", d(2024, 1, 1), "10", d(2024, 1, 2)),
                                ("v", d(2024, 1, 5), "9", d(2024, 1, 6))],
                               "u string, create_date date, id string, paid date")
    out = first_by(df, ["u"], "paid", order=ARRIVAL, out="first_paid")
    assert rows(out) == [("u", None), ("v", d(2024, 1, 6))]
    out_min = first_by(df, ["u"], "paid", out="first_paid")
    assert rows(out_min) == [("u", d(2024, 1, 2)), ("v", d(2024, 1, 6))]


def test_t9_fanout_kept(spark):
    from kpiloom.operators.relational import left_join_renamed

    o = spark.createDataFrame([("1",), ("2",)], "id string")
    lg = spark.createDataFrame([("1", 15), ("1", 15), ("2", 18)], "order_id string, type int")
    assert left_join_renamed(o, lg, "id", "order_id").count() == 3


def test_t10_total_row_on_empty_input(spark):
    from kpiloom.operators.aggregates import level_sets

    df = spark.createDataFrame([], "city string, district string, m string")
    out = level_sets(df, ["city", "district"], [F.count(F.lit(1)).alias("n")], empty={"n": 0})
    assert rows(out, "level", "city", "n") == [(0, None, 0)]


def test_t10_null_district_is_not_a_subtotal(spark):
    from kpiloom.operators.aggregates import level_sets

    df = spark.createDataFrame([("c", None), ("c", "d"), ("c", "d")], "city string, district string")
    out = level_sets(df, ["city", "district"], [F.count(F.lit(1)).alias("n")])
    assert rows(out, "level", "city", "district", "n") == [
        (0, None, None, 3), (1, "c", None, 3), (2, "c", None, 1), (2, "c", "d", 2)]


def test_t11_conversion_rate_stays_numeric(spark):
    df = spark.createDataFrame([(1, 0), (1, 2)], "p long, u long")
    out = df.select(S.ratio("p", "u").alias("r"))
    assert out.schema["r"].dataType.typeName() == "double"
    assert rows(out) == [(None,), (0.5,)]


def test_t18_sort_nulls_last(spark):
    df = spark.createDataFrame([(None,), ("b",), ("a",)], "c string")
    assert [r.c for r in df.orderBy(F.col("c").asc_nulls_last()).collect()] == ["a", "b", None]


def test_t19_top_n_tie_break_by_name(spark):
    from kpiloom.operators.windows import top_n

    df = spark.createDataFrame([("c", "b", 5.0), ("c", "a", 5.0), ("c", "z", 9.0), ("d", "q", 1.0)],
                               "city string, name string, q double")
    out = top_n(df, ["city"], [F.col("q").desc_nulls_last(), F.col("name").asc_nulls_last()], 2)
    assert rows(out, "city", "name") == [("c", "a"), ("c", "z"), ("d", "q")]


def test_compound_not_three_valued(spark):
    from kpiloom.operators.relational import drop_suffix_users

    df = spark.createDataFrame([("970", "aX"), ("970", "a"), (None, "bX"), (None, "b"), ("1", "cX")],
                               "area_id string, username string")
    out = drop_suffix_users(df, "area_id", ["970"], "username", "X$")
    # NOT(NULL AND TRUE) is NULL -> dropped; NOT(NULL AND FALSE) is TRUE -> kept
    assert rows(out) == [(None, "b"), ("1", "cX"), ("970", "a")]


def test_path_part_fixed_split(spark):
    df = spark.createDataFrame([("a,b,c,d",), ("a,b",), ("a",), (None,)], "p string")
    out = df.select(*[S.path_part("p", ",", 3, i).alias(f"p{i}") for i in (1, 2, 3)])
    assert rows(out) == [(None, None, None), ("a", "", ""), ("a", "b", ""), ("a", "b", "c,d")]


def test_flag_decode_and_weekday_rule(spark):
    df = spark.createDataFrame([(True, dt.date(2024, 1, 29)), (False, dt.date(2024, 1, 30)), (None, None)],
                               "g boolean, d date")
    out = df.select(S.flag_decode("g").alias("f"), S.weekend_window_start("d").alias("s"))
    assert rows(out) == [(None, None), (0, dt.date(2024, 1, 29)), (1, dt.date(2024, 1, 27))]


def test_zero_fill_nan_and_null(spark):
    df = spark.createDataFrame([(float("nan"), None), (None, 3)], "a double, b long")
    out = S.zero_fill(df, ["a", "b"])
    assert rows(out) == [(0.0, 0), (0.0, 3)]
