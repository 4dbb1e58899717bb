"""Native join keys, item facts by order id, and the reduction of the order history."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from helpers import SF_ORACLE, rows
from kpiloom.functions.keys import key, key_values, keys_like, text_ids
from kpiloom.operators.reduction import bit_filter, keep_possible
from kpiloom.operators.relational import drop_suffix_users, keep_matching, left_join_renamed, lookup, mark
from kpiloom.plans.facts import KeyedFrames, Model
from kpiloom.plans.reports import sell_through, top_products
from kpiloom.sources.bindings import sales_params, test_raw_tables as bound_tables
from kpiloom.sources.raw import RAW_SCHEMAS, RawTables
from rawfixture import AREA, ORDER, PARAMS, raw_tables

IDS = "id order_id member_id area_id product_id sn cate_id dealer_id".split()


@pytest.fixture
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


@pytest.fixture
def stored(spark):
    """Frames of the sales binding with their dimensions written and their items by order id."""
    k = KeyedFrames(bound_tables(spark, SF_ORACLE, "orders"), sales_params())
    k.prepare()
    k.store_items()
    return k


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ids_stay_native_inside_and_are_text_outside(spark):
    m = Model(bound_tables(spark, SF_ORACLE, "orders"), sales_params())
    for name in ("orders", "items", "order_log", "members", "logins", "contract", "sales_detail", "delivery_orders", "dealers"):
        inner, outer = getattr(m.keyed, name), getattr(m, name)
        found = [c for c in outer.columns if c in IDS]
        assert found and {outer.schema[c].dataType for c in found} == {StringType()}
        assert {inner.schema[c].dataType for c in found if c != "cate_id" and (name, c) != ("dealers", "sn")} == {LongType()}, name
        assert outer.columns == inner.columns


def test_items_by_order_id_meet_orders_without_an_exchange(spark, stored, no_broadcast):
    p = plan(stored.sales_detail)
    assert "BroadcastHashJoin" not in p
    assert not re.search(r"hashpartitioning\(order_id", p)     # neither semi-join nor join moves the items
    assert len(re.findall(r"Exchange hashpartitioning\(sn#", p)) == 1    # the items move once
    p = plan(stored.items_month)
    assert not re.search(r"hashpartitioning\(order_id", p)
    assert len(re.findall(r"Exchange hashpartitioning\(sn#", p)) == 1
    casts = re.findall(r"cast\((?:order_id|sn|id|area_id)#\d+L? as string\)", p)
    assert casts == []


def test_stored_items_give_the_same_facts(spark, stored):
    lazy = KeyedFrames(bound_tables(spark, SF_ORACLE, "orders"), sales_params())
    for name in ("items", "sales_detail", "items_month"):
        assert rows(getattr(stored, name)) == rows(getattr(lazy, name)), name


def test_the_window_reduces_the_order_history(spark, stored):
    items = stored.items_all
    wanted = items.select("order_id").distinct().count()
    reduced, history = stored.orders_of(items), stored.orders
    assert "Subquery" in plan(reduced) and "shiftrightunsigned" in plan(reduced)
    read, all_rows = reduced.count(), history.count()
    kept = keep_matching(history, items, "id", "order_id").count()
    assert kept <= read <= kept + 0.02 * all_rows and read <= wanted * 1.1 < all_rows / 10
    assert keep_matching(reduced, items, "id", "order_id").count() == kept
    # the rows behind the filter, as the executed plan of the 30-day detail counts them
    for df in (stored.items_month, stored.items):
        assert "shiftrightunsigned" in plan(df)


def test_reports_read_the_reduced_history(spark, stored):
    m = Model(bound_tables(spark, SF_ORACLE, "orders"), sales_params())
    lazy = rows(top_products(m)), rows(sell_through(m))
    m.keyed.store_items()
    assert (rows(top_products(m)), rows(sell_through(m))) == lazy


def test_bit_filter_keeps_all_and_drops_most(spark):
    history = spark.range(60_000).select(F.col("id").alias("k"), F.lit("x").alias("w")).union(spark.sql("SELECT CAST(NULL AS bigint), 'n'"))
    wanted = spark.range(0, 60_000, 500).select(F.col("id").alias("w")).union(spark.sql("SELECT CAST(NULL AS bigint)"))
    for power in (8, 12, 20):
        got = {r.k for r in keep_possible(history, "k", wanted, "w", power).collect()}
        assert got >= set(range(0, 60_000, 500)) and None not in got
    assert len(got) < 200
    assert keep_possible(history, "k", wanted.limit(0), "w", 8).count() == 0
    words = bit_filter(wanted, "w", 8).first()["words"]
    assert len(words) == 4 and any(words)
    assert keep_possible(history, "w", wanted, "w", 8).count() == 60_001    # keys of two types are left to the join


def test_text_ids_in_the_source_still_work(spark):
    """The same tables with ids as text (one of them not a number) give the same reports."""
    def texted(name, frame):
        ids = {"id", "orders", "member", "area", "product", "sn", "operator", "dealer"} & {f.name for f in RAW_SCHEMAS[name] if f.dataType == LongType()}
        return frame.withColumns({c: F.col(c).cast("string") for c in ids}) if ids else frame

    raw = raw_tables(spark)
    back = RawTables(**{n: texted(n, getattr(raw, n)) for n in RAW_SCHEMAS}, test_accounts=raw.test_accounts, campaign_products=raw.campaign_products)
    mixed = RawTables(**{n: texted(n, getattr(raw, n)) if n in ("area", "order_item") else getattr(raw, n) for n in RAW_SCHEMAS},
                      test_accounts=raw.test_accounts, campaign_products=raw.campaign_products)
    a = Model(raw, PARAMS, snapshot=False)
    for other in (back, mixed):
        b = Model(other, PARAMS, snapshot=False)
        for name in ("orders", "orders_window", "logins_window", "sales_detail", "delivery_orders", "members"):
            assert rows(getattr(a, name)) == rows(getattr(b, name)), name


def test_literal_ids_take_the_type_of_the_column(spark):
    df = spark.createDataFrame([(970, "aX"), (971, "bX"), (None, "cX"), (970, "d")], "area_id long, username string")
    assert key_values(df, "area_id", ("970", "0970", "x", 7)) == [970, 7]
    assert key_values(df.select(F.col("area_id").cast("string").alias("area_id")), "area_id", ("970", 7)) == ["970", "7"]
    assert rows(drop_suffix_users(df, "area_id", ("970",), "username", "X$")) == [(970, "d"), (971, "bX")]
    assert rows(drop_suffix_users(df, "area_id", ("none",), "username", "X$")) == [(970, "aX"), (970, "d"), (971, "bX")]
    assert drop_suffix_users(df, "area_id", (), "username", "X$").count() == 4


def test_lists_and_joins_of_two_types(spark):
    ids = spark.createDataFrame([(1, "a"), (12, "b"), (None, "c")], "sn long, v string")
    texts = spark.createDataFrame([("1",), ("012",), ("x",), (None,), ("1",)], "sn string")
    assert rows(keys_like(texts, "sn", LongType())) == [(1,), (1,)]
    assert keys_like(texts, "sn", StringType()) is texts
    assert rows(mark(ids, texts, "sn", "m"), "v", "m") == [("a", 1), ("b", 0), ("c", 0)]
    assert rows(keep_matching(ids, texts, "sn"), "v") == [("a",)]
    dim = spark.createDataFrame([("1", "one"), ("012", "no")], "sn string, name string")
    assert rows(lookup(ids, dim, "sn"), "v", "name") == [("a", "one"), ("b", None), ("c", None)]
    assert lookup(ids, dim, "sn").schema["sn"].dataType == LongType()
    other = dim.withColumnRenamed("sn", "k")
    assert rows(left_join_renamed(ids, other, "sn", "k"), "v", "name") == [("a", "one"), ("b", None), ("c", None)]


def test_text_ids_casts_only_ids(spark):
    df = spark.createDataFrame([(1, 2, 3.5, 4, dt.date(2024, 1, 1))], "sn_x long, id int, sub_total double, sale_x long, day date")
    assert [t for _, t in text_ids(df).dtypes] == ["string", "string", "double", "bigint", "date"]
    assert text_ids(df.select("day")).columns == ["day"]
    narrow = spark.createDataFrame([], "a smallint, b decimal(12,0), c decimal(12,2), d double")
    assert [narrow.select(key(narrow, c)).dtypes[0][1] for c in "abcd"] == ["bigint", "bigint", "string", "string"]


def test_wide_ids_keep_their_value(spark):
    wide = [(2 ** 62 + i, *r[1:]) if i < 2 else r for i, r in enumerate(ORDER)]
    m = Model(raw_tables(spark, order=wide, area=AREA), PARAMS, snapshot=False)
    assert str(2 ** 62) in {r.id for r in m.orders.collect()}
