"""Binding of the driver's TPC-H-like test tables to the raw source tables.

Every raw table is a lazy projection/aggregation of the Parquet test tables,
so the work of each report grows with the data. The same rules are written
independently as SQL in ``kpiloom.oracle`` for the DuckDB check.

=====================  ======================================================
raw table              bound to
=====================  ======================================================
area                   one area per customer: path ``region,nation,segment``;
                       plus one per nation: path ``region,nation`` (no
                       district), id ``-(nationkey+1)``
member                 customer (first login: 2024-01-01 + custkey % 37 days,
                       NULL when custkey % 11 = 0)
login                  events (all), username from customer
app_log                events; method = event_type, snapshot = props
order (kpi)            events with event_type 'purchase'; status 1 + id % 4;
                       paid date NULL when id % 7 = 0
order (sales)          orders; status F/O/P -> 1/2/3; shipping status by the
                       first character of the priority 1..5 -> 1,4,8,7,0
order_item             lineitem; create date = its order's date; gift =
                       returnflag 'R'; sale factor = line number
order_log              lineitem per order: 15 = first ship date of 'F' lines,
                       18 = last ship date of 'O' lines
product                part: dealer = partkey % 10, delivery = size % 3,
                       category = leaf (type, brand, name)
product_category       3 levels: type (code length 2), brand (4), name (6)
dealer                 supplier
contract_product       distinct (nation area of the supplier, part) of
                       lineitem; marketable when linestatus 'O'
campaign products      parts of brand 'Brand#1'
=====================  ======================================================
"""

from __future__ import annotations

import datetime as dt
from dataclasses import replace
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.params import ReportParams
from kpiloom.session import app_id
from kpiloom.sources.raw import LazyRawTables

TEST_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# Fixed test parameters (geography and rule targets on the test tables).
TEST_PROVINCES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
TEST_CITIES = ("NATION_0", "NATION_1", "NATION_2", "NATION_3", "MIDDLE EAST")
TEST_MUNICIPALITIES = ("MIDDLE EAST",)
TEST_EXCLUDED_DISTRICTS = ("FURNITURE",)
TEST_CAMPAIGN_CITIES = ("NATION_1", "NATION_2", "NATION_6", "NATION_7")
TEST_CAMPAIGN_EXCLUDED_DISTRICTS = ("BUILDING",)
TEST_ACCOUNTS = ("Customer#000000003", "Customer#000000005", "Customer#000000008")
TEST_X_AREAS = ("977",)
TEST_DROPPED_AREAS = ("13", "29", "41")
TEST_X_PATTERN = "7$"
TEST_X_DISTRICT = "HOUSEHOLD"
TEST_CATEGORIES = {"ECONOMY": "economy", "LARGE": "large", "MEDIUM": "medium", "PROMO": "promo",
                   "SMALL": "small", "STANDARD": "standard"}
TEST_CAMPAIGN_BRAND = "Brand#1"


def kpi_params() -> ReportParams:
    """Parameters for tables 1-2 (events span 2024-01-01 .. 2024-01-30)."""
    return ReportParams(
        report_date=dt.date(2024, 1, 30), provinces=TEST_PROVINCES, cities=TEST_CITIES,
        excluded_districts=TEST_EXCLUDED_DISTRICTS, municipalities=TEST_MUNICIPALITIES,
        test_accounts=TEST_ACCOUNTS, x_area_ids=TEST_X_AREAS, dropped_area_ids=TEST_DROPPED_AREAS,
        x_user_pattern=TEST_X_PATTERN, x_district=TEST_X_DISTRICT, category_columns=TEST_CATEGORIES,
        app_login_method="signup", app_success_prefix='{"k": 1', money_scale=2, quantity_scale=6,
    )


def early_params() -> ReportParams:
    """Parameters for table 1: an early report date, so that buyers are first seen inside its week."""
    return replace(kpi_params(), report_date=dt.date(2024, 1, 7))


def sales_params() -> ReportParams:
    """Parameters for tables 3-4, supplements and the campaign report
    (orders span 1995-01-01 .. 2001-08-01). Log dates are far apart on the
    test data, so the delivery buckets use 30/180/365 days."""
    return ReportParams(
        report_date=dt.date(2001, 7, 31), provinces=TEST_PROVINCES, cities=TEST_CITIES,
        excluded_districts=TEST_EXCLUDED_DISTRICTS, municipalities=TEST_MUNICIPALITIES,
        test_accounts=TEST_ACCOUNTS, x_area_ids=TEST_X_AREAS, dropped_area_ids=TEST_DROPPED_AREAS,
        x_user_pattern=TEST_X_PATTERN, x_district=TEST_X_DISTRICT, category_columns=TEST_CATEGORIES,
        delivery_thresholds=(30, 180, 365), delivery_labels=("d30", "d180", "d365", "d365+"),
        in_transit_label="in_transit", money_scale=2, quantity_scale=6,
        campaign_start=dt.date(2001, 6, 1), campaign_end=dt.date(2001, 7, 31),
        campaign_provinces=TEST_PROVINCES, campaign_cities=TEST_CAMPAIGN_CITIES,
        campaign_excluded_districts=TEST_CAMPAIGN_EXCLUDED_DISTRICTS,
    )


_LOADED: dict[tuple[str, str], dict[str, DataFrame]] = {}
_LOADED_LOCK = threading.Lock()


def load_test_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The test tables as DataFrames, read once per application and folder
    (DataFrames are immutable plans; re-reading only repeats the footer
    reads and schema resolution)."""
    key = (app_id(spark), sf_dir)
    with _LOADED_LOCK:
        if key not in _LOADED:
            _LOADED[key] = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TEST_TABLES}
        return _LOADED[key]


def _username(t: dict[str, DataFrame]) -> DataFrame:
    return t["customer"].select(F.col("c_custkey").alias("__ck"), F.col("c_name").alias("username"))


def bind_area(t) -> DataFrame:
    geo = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")) \
        .select("n_nationkey", "n_name", "r_name")
    cust = t["customer"].join(geo, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.concat_ws(",", "r_name", "n_name", "c_mktsegment").alias("name_path"))
    nat = geo.select((-(F.col("n_nationkey") + 1)).cast("bigint").alias("id"), F.col("n_name").alias("name"),
                     F.concat_ws(",", "r_name", "n_name").alias("name_path"))
    return cust.unionByName(nat)


def bind_member(t) -> DataFrame:
    c = F.col("c_custkey")
    first = F.when(c % 11 != 0, F.timestamp_add("DAY", (c % 37).cast("int"),
                                                 F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
    return t["customer"].select(
        c.alias("id"), F.col("c_name").alias("name"), F.col("c_name").alias("username"),
        F.concat(F.lit("LIC"), c.cast("string")).alias("licence_code"),
        F.col("c_mktsegment").alias("shop_name"),
        F.concat(F.lit("street "), F.col("c_nationkey").cast("string")).alias("address"),
        c.alias("area"), first.alias("first_login_date"), first.alias("login_date"))


def bind_login(t) -> DataFrame:
    e = t["events"]
    return e.join(_username(t), F.col("user_id") == F.col("__ck"), "left").select(
        F.col("user_id").alias("member"), "username", F.col("user_id").alias("area"),
        F.concat(F.lit("10.0.0."), (F.col("event_id") % 256).cast("string")).alias("login_ip"),
        F.col("ts").alias("login_date"), F.lit(None).cast("timestamp_ntz").alias("first_login_date"))


def bind_app_log(t) -> DataFrame:
    return t["events"].select(
        F.col("ts").alias("create_date"), F.col("user_id").alias("operator"),
        F.col("event_type").alias("come_from"), F.col("event_type").alias("method_name"),
        F.col("props").alias("snap_shot"))


def bind_order_events(t) -> DataFrame:
    e = t["events"].filter(F.col("event_type") == "purchase")
    eid = F.col("event_id")
    return e.join(_username(t), F.col("user_id") == F.col("__ck"), "left").select(
        eid.alias("id"), F.concat(F.lit("E"), eid.cast("string")).alias("sn"),
        F.col("ts").alias("create_date"),
        F.when(eid % 7 != 0, F.col("ts")).alias("paid_date"),
        F.lit(None).cast("timestamp_ntz").alias("returns_date"),
        (eid % 4 + 1).cast("int").alias("order_status"),
        F.col("user_id").alias("member"), "username", F.col("user_id").alias("area"),
        F.col("value").alias("original_amount"),
        F.lit(None).cast("string").alias("payment_method"), F.lit(None).cast("string").alias("shipping_method"),
        F.lit(None).cast("int").alias("shipping_status"), (eid % 3).cast("int").alias("delivery_method"))


def bind_order_orders(t) -> DataFrame:
    o = t["orders"]
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2) \
        .when(F.col("o_orderstatus") == "P", 3)
    pr = F.substring("o_orderpriority", 1, 1)
    ship = F.when(pr == "1", 1).when(pr == "2", 4).when(pr == "3", 8).when(pr == "4", 7).when(pr == "5", 0)
    return o.join(_username(t), F.col("o_custkey") == F.col("__ck"), "left").select(
        k.alias("id"), F.concat(F.lit("SO"), k.cast("string")).alias("sn"),
        F.col("o_orderdate").alias("create_date"), F.col("o_orderdate").alias("paid_date"),
        F.lit(None).cast("timestamp_ntz").alias("returns_date"), status.cast("int").alias("order_status"),
        F.col("o_custkey").alias("member"), "username", F.col("o_custkey").alias("area"),
        F.col("o_totalprice").alias("original_amount"),
        F.lit(None).cast("string").alias("payment_method"), F.lit(None).cast("string").alias("shipping_method"),
        ship.cast("int").alias("shipping_status"), (k % 3).cast("int").alias("delivery_method"))


def bind_order_item(t) -> DataFrame:
    od = t["orders"].select(F.col("o_orderkey"), F.col("o_orderdate"))
    return t["lineitem"].join(od, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderdate").alias("create_date"), F.col("l_orderkey").alias("orders"),
        F.col("l_partkey").alias("sn"), F.col("l_partkey").alias("product"),
        F.col("l_quantity").alias("quantity"), F.col("l_linenumber").cast("double").alias("sale_factor"),
        F.col("l_quantity").alias("sale_quantity"), (F.col("l_returnflag") == "R").alias("is_gift"),
        F.col("l_extendedprice").alias("sub_total"))


def bind_order_log(t) -> DataFrame:
    li = t["lineitem"]
    typ = F.when(F.col("l_linestatus") == "F", 15).when(F.col("l_linestatus") == "O", 18)
    return (li.select("l_orderkey", "l_shipdate", typ.alias("type"))
            .filter(F.col("type").isNotNull())
            .groupBy("l_orderkey", "type")
            .agg(F.min("l_shipdate").alias("__first"), F.max("l_shipdate").alias("__last"))
            .select(F.when(F.col("type") == 15, F.col("__first")).otherwise(F.col("__last")).alias("create_date"),
                    F.col("type").cast("int").alias("type"), F.col("l_orderkey").alias("orders")))


def bind_product(t) -> DataFrame:
    p = t["part"]
    leaf = F.concat_ws("|", "p_type", "p_brand", "p_name")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("sn"), F.col("p_name").alias("name"),
                    F.col("p_brand").alias("brand"), leaf.alias("product_category"),
                    F.col("p_size").cast("double").alias("sale_factor"), (F.col("p_partkey") % 10).alias("dealer"),
                    (F.col("p_size") % 3).cast("int").alias("delivery_method"))


def bind_product_category(t) -> DataFrame:
    p = t["part"]
    l1 = F.col("p_type")
    l2 = F.concat_ws("|", "p_type", "p_brand")
    l3 = F.concat_ws("|", "p_type", "p_brand", "p_name")
    lvl1 = p.select(l1.alias("id"), F.lit("11").alias("code"), F.col("p_type").alias("name"),
                    F.lit(",").alias("tree_path"))
    lvl2 = p.select(l2.alias("id"), F.lit("2222").alias("code"), F.col("p_brand").alias("name"),
                    F.concat(F.lit(","), l1, F.lit(",")).alias("tree_path"))
    lvl3 = p.select(l3.alias("id"), F.lit("333333").alias("code"), F.col("p_name").alias("name"),
                    F.concat(F.lit(","), l1, F.lit(","), l2, F.lit(",")).alias("tree_path"))
    return lvl1.unionByName(lvl2).unionByName(lvl3).distinct()


def bind_dealer(t) -> DataFrame:
    s = t["supplier"]
    return s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("D"), F.col("s_suppkey").cast("string")).alias("sn"),
                    F.col("s_name").alias("name"))


def bind_contract_product(t) -> DataFrame:
    s = t["supplier"].select("s_suppkey", "s_nationkey")
    return (t["lineitem"].join(s, F.col("l_suppkey") == F.col("s_suppkey"))
            .select((-(F.col("s_nationkey") + 1)).cast("bigint").alias("area"),
                    F.col("l_partkey").alias("product"),
                    F.when(F.col("l_linestatus") == "O", 1).otherwise(0).cast("int").alias("is_marketable"))
            .distinct())


def bind_campaign_products(t) -> DataFrame:
    return t["part"].filter(F.col("p_brand") == TEST_CAMPAIGN_BRAND).select(F.col("p_partkey").cast("string").alias("sn"))


def test_raw_tables(spark: SparkSession, sf_dir: str, order_source: str = "orders") -> LazyRawTables:
    """Raw tables bound to ``sf_dir`` (built on first use); ``order_source``
    is 'orders' (sales reports) or 'events' (visit/order KPI tables)."""
    t = load_test_tables(spark, sf_dir)
    bind_order = bind_order_orders if order_source == "orders" else bind_order_events
    return LazyRawTables({
        "order": lambda: bind_order(t), "order_item": lambda: bind_order_item(t),
        "order_log": lambda: bind_order_log(t), "area": lambda: bind_area(t), "member": lambda: bind_member(t),
        "app_log": lambda: bind_app_log(t), "product": lambda: bind_product(t),
        "product_category": lambda: bind_product_category(t), "dealer": lambda: bind_dealer(t),
        "contract_product": lambda: bind_contract_product(t), "login": lambda: bind_login(t),
        "test_accounts": lambda: spark.createDataFrame([(a,) for a in TEST_ACCOUNTS], "account string"),
        "campaign_products": lambda: bind_campaign_products(t),
    })
