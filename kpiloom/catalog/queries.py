"""Named queries over the driver's test tables, one per operator / report.

Each entry is ``(spark, sf_dir) -> DataFrame`` and reads the whole bound
tables (see ``kpiloom.sources.bindings``). Visit/order KPI queries (tables
1-2) use the events binding and its parameters; sales, logistics,
supplement and campaign queries use the orders binding.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.functions.keys import text_ids
from kpiloom.functions.semantics import (
    flag_decode, if_else, in_set, money, n_distinct, not_in_set, ratio, strict_sum, to_day,
    weekend_window_start, zero_fill,
)
from kpiloom.operators.aggregates import LEVEL_COL, append_total, first_by
from kpiloom.operators.grid import DateRange, date_span, densify, expand, param_grid, pivot_fixed
from kpiloom.operators.relational import (
    drop_suffix_users, in_window, join_with_suffix, left_join_renamed, lookup, mark, null_safe_left_join,
)
from kpiloom.operators.windows import peaks
from kpiloom.params import ALL_CITIES_LABEL, CHANNEL_COLUMNS, CHANNELS
from kpiloom.plans import reports as R
from kpiloom.plans.dims import area_levels, city_districts
from kpiloom.plans.facts import Model, run_snapshot_base
from kpiloom.session import app_id
from kpiloom.sources import ingest
from kpiloom.sources.bindings import early_params, kpi_params, sales_params, test_raw_tables

Query = Callable[[SparkSession, str], DataFrame]


# One Model per (application, folder, binding): like a daily run, every
# report plans against the same (immutable) logical frames. Nothing is
# cached at execution time.
_MODELS: dict[tuple, Model] = {}
_MODELS_LOCK = threading.RLock()


def _model(spark: SparkSession, sf_dir: str, kind: str, params, **kw) -> Model:
    key = (app_id(spark), sf_dir, kind, repr(params), tuple(sorted(kw.items())))
    with _MODELS_LOCK:
        if key not in _MODELS:
            kw.setdefault("use_account_table", False)   # the binding's accounts are literals
            kw.setdefault("snapshot", run_snapshot_base(spark, sf_dir, kind, uuid.uuid4().hex))
            _MODELS[key] = Model(test_raw_tables(spark, sf_dir, kind), params, **kw)
        return _MODELS[key]


def fresh_run() -> None:
    """Forget the models: the next query is the first of a new run and writes its dimensions anew."""
    with _MODELS_LOCK:
        _MODELS.clear()


def kpi_model(spark: SparkSession, sf_dir: str, **kw) -> Model:
    return _model(spark, sf_dir, "events", kpi_params(), **kw)


def early_model(spark: SparkSession, sf_dir: str, **kw) -> Model:
    return _model(spark, sf_dir, "events", early_params(), **kw)


def sales_model(spark: SparkSession, sf_dir: str, **kw) -> Model:
    return _model(spark, sf_dir, "orders", sales_params(), **kw)


def _k(fn) -> Query:
    return lambda spark, sf: text_ids(fn(kpi_model(spark, sf)))


def _e(fn) -> Query:
    return lambda spark, sf: text_ids(fn(early_model(spark, sf)))


def _s(fn) -> Query:
    return lambda spark, sf: text_ids(fn(sales_model(spark, sf)))


# ---- sources and ingest (S1-S13) ------------------------------------------
def q_scan_project(m: Model) -> DataFrame:
    return m.products


def q_scan_full(m: Model) -> DataFrame:
    return ingest.scan_area(m.raw.area)


def q_lookup_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    return sales_model(spark, sf, use_account_table=True).orders


def q_scan_range_open(m: Model) -> DataFrame:
    return ingest.scan_order_items(m.raw.order_item, m.p.month_start, m.p.report_date)


def q_scan_range_closed(m: Model) -> DataFrame:
    return ingest.scan_order_items(m.raw.order_item, m.p.campaign_start, m.p.campaign_end, closed="both",
                                   derive_cases=False)


def q_exclude_accounts(m: Model) -> DataFrame:
    return ingest.scan_members(m.raw.member, m.accounts)


def q_semi_area(m: Model) -> DataFrame:
    return m.members


def q_semi_orders(m: Model) -> DataFrame:
    return m.items


def q_scan_equality(m: Model) -> DataFrame:
    return m.contract


def q_json_prefix(m: Model) -> DataFrame:
    return m.app


def q_cast_ids(m: Model) -> DataFrame:
    return m.dealers


def q_flag_decode(m: Model) -> DataFrame:
    it = m.raw.order_item.select(flag_decode("is_gift").alias("is_gift"))
    return it.groupBy("is_gift").agg(F.count(F.lit(1)).alias("n"))


def q_date_trunc_day(m: Model) -> DataFrame:
    return (m.raw.app_log.select(to_day("create_date").alias("day"))
            .groupBy("day").agg(F.count(F.lit(1)).alias("n")))


def q_cases_sold(m: Model) -> DataFrame:
    return m.items.select("order_id", "sn", "sale_quantity")


# ---- projections (P1-P9) --------------------------------------------------
def q_drop_cols(m: Model) -> DataFrame:
    return m.orders.drop("payment_method", "shipping_method", "returns_date")


def q_rename_cols(m: Model) -> DataFrame:
    return m.order_log.withColumnsRenamed({"create_date": "log_date", "type": "log_type"})


def q_localized_headers(m: Model) -> DataFrame:
    return R.top_products(m, localized=True)


def q_join_suffix(m: Model) -> DataFrame:
    prod = m.keyed.products.filter(F.col("delivery_method") == 1).select("sn", "dealer_id", "name")
    return join_with_suffix(prod, m.keyed.dealers, "dealer_id")


# ---- filters (F1-F7) ------------------------------------------------------
def q_filter_and(m: Model) -> DataFrame:
    return m.orders.filter((F.col("order_status") == 1) & (F.col("shipping_status") != 0)) \
        .select("id", "create_date", "order_status", "shipping_status")


def q_window_filter(m: Model) -> DataFrame:
    return in_window(m.orders, "create_date", m.p.week_start, m.p.report_date).select("id", "create_date",
                                                                                       "area_id")


def q_member_in(m: Model) -> DataFrame:
    return m.orders.filter(in_set("order_status", (1, 2, 4))).select("id", "order_status")


def q_member_not_in(m: Model) -> DataFrame:
    return area_levels(ingest.scan_area(m.raw.area), m.p.municipalities).filter(
        not_in_set("district", m.p.excluded_districts))


def q_compound_not(m: Model) -> DataFrame:
    o = ingest.scan_orders(m.raw.order, m.accounts)
    return drop_suffix_users(o, "area_id", m.p.x_area_ids, "username", m.p.x_user_pattern).select("id", "username",
                                                                                                    "area_id")


def q_null_filter(m: Model) -> DataFrame:
    return city_districts(m.area, m.p)


def q_tree_levels(m: Model) -> DataFrame:
    c = m.categories
    return c.filter(F.length("code").isin(2, 4)).select(
        "cate_id", "name", F.when(F.length("code") == 2, 1).otherwise(2).alias("tree_level"))


# ---- joins (J1-J11) -------------------------------------------------------
def q_left_join_dim(m: Model) -> DataFrame:
    return lookup(m.keyed.logins.select("member_id", "area_id", "login_date"), m.keyed.area, "area_id")


def q_left_join_renamed(m: Model) -> DataFrame:
    it = m.keyed.items.select("order_id", "sn", "sub_total")
    return left_join_renamed(it, m.keyed.orders.select("id", "order_status", "create_date"), "order_id", "id")


def q_left_join_multi(m: Model) -> DataFrame:
    return R.delivery_by_status(m).join(R.delivery_by_channel(m), ["city", "delivery_effect"], "left")


def _channel_long(m: Model) -> DataFrame:
    sd = m.sales_in_window.filter(in_set("city", m.p.cities)).withColumnRenamed("create_date", "date")
    return sd.groupBy("city", "date", "method").agg(money(strict_sum("sub_total"), m.p.money_scale).alias("amount"))


def q_densify_grid(m: Model) -> DataFrame:
    s = m.raw.order.sparkSession
    grid = param_grid(s, city=list(m.p.cities), date=DateRange(m.p.week_dates()[0], m.p.report_date),
                      method=list(CHANNELS))
    return densify(_channel_long(m), grid, ["city", "date", "method"], ["amount"], 0.0)


def q_mark_join(m: Model) -> DataFrame:
    return mark(m.keyed.products.select("sn", "name"), m.keyed.campaign_products, "sn", "campaign_prod")


def q_fanout_join(m: Model) -> DataFrame:
    o = in_window(m.keyed.orders, "create_date", m.p.week_start, m.p.report_date).filter(in_set("order_status", (1, 2)))
    return left_join_renamed(o.select("id"), m.keyed.order_log, "id", "order_id")


def q_null_safe_join(m: Model) -> DataFrame:
    today = m.items_today.groupBy("city", "name").agg(
        money(strict_sum("quantity"), m.p.quantity_scale).alias("today_quantity"))
    return null_safe_left_join(R.month_sold(m), today, ["city", "name"])


def q_cross_grid(m: Model) -> DataFrame:
    cate1 = m.categories.filter(F.length("code") == 2).select(F.col("name").alias("cate1")).distinct()
    # the level-1 list comes from the data; each of its rows is expanded with the parameter lists
    return expand(cate1, city=list(m.p.cities), date=DateRange(m.p.week_dates()[0], m.p.report_date))


def q_totals_row(m: Model) -> DataFrame:
    day = m.p.report_date
    v = m.logins_window.filter(F.col("login_date") == F.lit(day)).agg(
        F.count(F.lit(1)).alias("total_visitors"), n_distinct("member_id").alias("unique_visitors"))
    o = m.orders_window.filter(F.col("create_date") == F.lit(day)).agg(
        n_distinct("username").alias("people_count"), F.count(F.lit(1)).alias("total_quant"))
    w = m.orders_window.agg(money(strict_sum("original_amount"), m.p.money_scale).alias("wkly_total_amount"))
    # cbind of one-row totals: stack them (missing columns NULL) and fold to one row
    parts = v.unionByName(o, allowMissingColumns=True).unionByName(w, allowMissingColumns=True)
    return parts.agg(*[F.max(c).alias(c) for c in ("total_visitors", "unique_visitors", "people_count",
                                                     "total_quant", "wkly_total_amount")])


# ---- aggregates (A1-A17) --------------------------------------------------
def q_global_agg(m: Model) -> DataFrame:
    return m.items_month.agg(F.count(F.lit(1)).alias("n_items"),
                             money(strict_sum("sub_total"), m.p.money_scale).alias("amount"),
                             n_distinct("order_id").alias("n_orders"))


def q_group_one(m: Model) -> DataFrame:
    return m.items_month.groupBy("city").agg(F.count(F.lit(1)).alias("n_items"),
                                             money(strict_sum("sub_total"), m.p.money_scale).alias("amount"))


def q_group_multi(m: Model) -> DataFrame:
    return m.items_month.groupBy("city", "method").agg(
        F.count(F.lit(1)).alias("n_items"), money(strict_sum("sub_total"), m.p.money_scale).alias("amount"))


def q_strict_sum(m: Model) -> DataFrame:
    paid = F.when(F.col("paid_date").isNotNull(), F.col("original_amount"))
    return m.orders.groupBy("username").agg(money(strict_sum(paid), m.p.money_scale).alias("paid_amount"))


def q_distinct_count(m: Model) -> DataFrame:
    o = lookup(m.keyed.orders, m.keyed.area, "area_id")
    return o.groupBy("city").agg(n_distinct("paid_date").alias("paid_days"))


def _repeat_level(level: int):
    def q(m: Model) -> DataFrame:
        return R.repeat_visit_rate(m).filter(F.col(LEVEL_COL) == level)
    return q


def q_first_per_key_min(m: Model) -> DataFrame:
    return first_by(m.app, ["member_id"], "login_date", out="first_login_date")


def q_first_per_key_ordered(m: Model) -> DataFrame:
    return first_by(m.orders, ["username"], "paid_date", order=R.ARRIVAL, out="first_paid_date")


def q_avg_ticket(m: Model) -> DataFrame:
    o = lookup(in_window(m.keyed.orders, "create_date", m.p.month_start, m.p.report_date), m.keyed.area, "area_id")
    out = o.groupBy("city").agg(money(strict_sum("original_amount"), m.p.money_scale).alias("amount"),
                                F.count(F.lit(1)).alias("n_orders"))
    return out.withColumn("avg_ticket", ratio(F.col("amount"), F.col("n_orders")))


def q_total_row_append(m: Model) -> DataFrame:
    st = R.delivery_by_status(m)
    return append_total(st, "city", ALL_CITIES_LABEL, ["delivery_effect"], ["returned", "refused", "normal"])


def q_distinct_rows(m: Model) -> DataFrame:
    return m.sales_detail.select("city", "method").distinct()


# ---- windows, sorts, set operations ---------------------------------------
def _daily_dense(m: Model, facts: DataFrame, date_col: str, value) -> DataFrame:
    s = m.raw.order.sparkSession
    grid = param_grid(s, city=list(m.p.cities), date=DateRange(m.p.week_dates()[0], m.p.report_date))
    agg = (facts.filter(in_set("city", m.p.cities)).withColumnRenamed(date_col, "date")
           .groupBy("city", "date").agg(value.alias("v")))
    return densify(agg, grid, ["city", "date"], ["v"])


def q_peak_flags(m: Model) -> DataFrame:
    d = _daily_dense(m, m.logins_window, "login_date", F.count(F.lit(1)))
    return peaks(d.withColumnRenamed("v", "visits"), ["city"], ["visits"])


def q_partition_mean(m: Model) -> DataFrame:
    from pyspark.sql import Window

    d = _daily_dense(m, m.orders_window, "create_date", F.count(F.lit(1)))
    return d.withColumnRenamed("v", "orders").withColumn(
        "orders_avg", F.avg("orders").over(Window.partitionBy("city")))


def q_sort_asc(m: Model) -> DataFrame:
    return R.month_sold(m).orderBy(F.col("city").asc_nulls_last(), F.col("name").asc_nulls_last())


def q_sort_desc(m: Model) -> DataFrame:
    return m.campaign_sales.select("order_id", "sn", "campaign_prod", "sub_total").orderBy(
        F.col("campaign_prod").desc(), "order_id", "sn")


def _first_logins(m: Model) -> tuple[DataFrame, DataFrame]:
    app_first = lookup(first_by(m.keyed.app, ["member_id"], "login_date", out="first_login_date"),
                       m.keyed.members.select("member_id", "area_id"), "member_id")
    pc = m.keyed.members.select("member_id", "first_login_date", "area_id")
    return app_first, pc


def q_union_distinct(m: Model) -> DataFrame:
    a, b = _first_logins(m)
    return a.unionByName(b).distinct()


def q_union_all(m: Model) -> DataFrame:
    a, b = _first_logins(m)
    return a.unionByName(b)


# ---- reshape --------------------------------------------------------------
def q_pivot_fixed(m: Model) -> DataFrame:
    wide = pivot_fixed(m.items_month, ["city"], "method", "sub_total", CHANNELS, CHANNEL_COLUMNS, agg="sum")
    return wide.select("city", *[money(F.col(c), m.p.money_scale).alias(c) for c in CHANNEL_COLUMNS.values()])


def q_date_series(m: Model) -> DataFrame:
    days = m.raw.app_log.select(to_day("create_date").alias("date"))
    counts = days.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    return date_span(days, "date").join(counts, "date", "left").transform(lambda d: zero_fill(d, ["n"]))


# ---- scalar functions -----------------------------------------------------
def q_if_else_null(m: Model) -> DataFrame:
    return m.orders.select("id", if_else(F.col("paid_date") == F.col("create_date"), "same_day", "later")
                           .alias("paid_when"))


def q_zero_fill(m: Model) -> DataFrame:
    return _daily_dense(m, m.orders_window, "create_date", F.count(F.lit(1))).withColumnRenamed("v", "orders")


def q_regex_suffix(m: Model) -> DataFrame:
    return m.members.select("member_id", "username", F.col("username").rlike(m.p.x_user_pattern).alias("x_user"))


def q_path_split(m: Model) -> DataFrame:
    return area_levels(ingest.scan_area(m.raw.area), m.p.municipalities)


def q_delivery_days(m: Model) -> DataFrame:
    return m.delivery_orders.select("id", "shipping_date", "complete_date", "duration")


def q_delivery_buckets(m: Model) -> DataFrame:
    return m.delivery_orders.select("id", "duration", "delivery_effect")


def q_status_map(m: Model) -> DataFrame:
    from kpiloom.functions.semantics import channel_of_delivery_method, ship_status_simple

    return m.orders.select("id", ship_status_simple("shipping_status").alias("ship_status_simple"),
                           channel_of_delivery_method("delivery_method").alias("method"))


def q_conversion_rate(m: Model) -> DataFrame:
    return R.report_visits_orders(m).select("city", "district", "people_count", "unique_visitors", "conv_rate")


def q_report_window(m: Model) -> DataFrame:
    o = in_window(m.orders, "create_date", m.p.month_start, m.p.report_date)
    return o.groupBy("create_date").agg(F.count(F.lit(1)).alias("n_orders"))


def q_weekend_window(m: Model) -> DataFrame:
    d = m.orders.select("create_date").distinct()
    return d.select(F.col("create_date").alias("run_date"),
                    weekend_window_start("create_date").alias("window_start"),
                    F.date_sub("create_date", 1).alias("window_end"))


# ---- composite reports ----------------------------------------------------
def q_orders_window(m: Model) -> DataFrame:
    return m.orders_window


def q_logins_window(m: Model) -> DataFrame:
    return m.logins_window


def q_log_events(m: Model) -> DataFrame:
    return m.shipped.withColumn("event", F.lit("shipped")).withColumnRenamed("shipping_date", "event_date") \
        .unionByName(m.completed.withColumn("event", F.lit("completed"))
                     .withColumnRenamed("complete_date", "event_date"))


def _sink_dir(spark: SparkSession, name: str) -> str:
    from kpiloom.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark)}/sinks/{name}-{uuid.uuid4().hex}"


def q_sink_csv_report(spark: SparkSession, sf: str) -> DataFrame:
    """Z1: table4 written as a CSV report (header, NULL as NA), read back."""
    from kpiloom.sources.sinks import csv_report

    path = _sink_dir(spark, "table4")
    report = R.report_delivery(sales_model(spark, sf))
    csv_report(report, path, single_file=True)
    return spark.read.schema(report.schema).option("header", True).option("nullValue", "NA").csv(path)


def q_sink_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """Z2/Z3: three supplement reports written and committed as one dated bundle, all read back."""
    from kpiloom.sources.sinks import read_bundle, write_bundle

    m = sales_model(spark, sf)
    base = _sink_dir(spark, "bundle")
    frames = {"top_products": R.top_products(m), "channel_counts": R.channel_counts(m), "sell_through": R.sell_through(m)}
    write_bundle(frames, base, m.p.report_date, small=tuple(frames))
    back = [read_bundle(spark, base, name).withColumn("report", F.lit(name)) for name in frames]
    return back[0].unionByName(back[1], allowMissingColumns=True).unionByName(back[2], allowMissingColumns=True)


def q_report_visits_orders(m: Model) -> DataFrame:
    return R.report_visits_orders(m, with_level=True)


def q_rollup_visits(m: Model) -> DataFrame:
    return R.rollup_visits(m)


QUERIES: dict[str, Query] = {
    # sources
    "scan_project": _s(q_scan_project),
    "scan_full": _s(q_scan_full),
    "lookup_exclusion": q_lookup_exclusion,
    "scan_range_open": _s(q_scan_range_open),
    "scan_range_closed": _s(q_scan_range_closed),
    "exclude_accounts": _s(q_exclude_accounts),
    "semi_area": _s(q_semi_area),
    "semi_orders": _s(q_semi_orders),
    "scan_equality": _s(q_scan_equality),
    "json_prefix": _k(q_json_prefix),
    "cast_ids": _s(q_cast_ids),
    "flag_decode": _s(q_flag_decode),
    "date_trunc_day": _k(q_date_trunc_day),
    "cases_sold": _s(q_cases_sold),
    # projections
    "drop_cols": _s(q_drop_cols),
    "rename_cols": _s(q_rename_cols),
    "localized_headers": _s(q_localized_headers),
    "category_tree": _s(lambda m: m.prod_cate),
    "channel_map": _s(lambda m: m.channel),
    "join_suffix": _s(q_join_suffix),
    # filters
    "filter_and": _s(q_filter_and),
    "window_filter": _s(q_window_filter),
    "member_in": _s(q_member_in),
    "member_not_in": _s(q_member_not_in),
    "compound_not": _s(q_compound_not),
    "null_filter": _s(q_null_filter),
    "tree_levels": _s(q_tree_levels),
    # joins
    "left_join_dim": _k(q_left_join_dim),
    "left_join_renamed": _s(q_left_join_renamed),
    "left_join_multi": _s(q_left_join_multi),
    "densify_grid": _s(q_densify_grid),
    "mark_join": _s(q_mark_join),
    "fanout_join": _s(q_fanout_join),
    "null_safe_join": _s(q_null_safe_join),
    "cross_grid": _s(q_cross_grid),
    "totals_row": _k(q_totals_row),
    # aggregates
    "global_agg": _s(q_global_agg),
    "group_one": _s(q_group_one),
    "group_multi": _s(q_group_multi),
    "strict_sum": _k(q_strict_sum),
    "distinct_count": _k(q_distinct_count),
    "repeat_rate_total": _k(_repeat_level(0)),
    "repeat_rate_city": _k(_repeat_level(1)),
    "repeat_rate_district": _k(_repeat_level(2)),
    "first_per_key_min": _k(q_first_per_key_min),
    "first_per_key_ordered": _k(q_first_per_key_ordered),
    "avg_ticket": _s(q_avg_ticket),
    "rollup_visits": _k(q_rollup_visits),
    "rollup_orders": _k(R.rollup_orders),
    "rollup_weekly": _k(R.rollup_weekly),
    "total_row_append": _s(q_total_row_append),
    "distinct_rows": _s(q_distinct_rows),
    "new_login_cohort": _e(R.new_login_cohort),
    "new_buyer_cohort": _e(R.new_buyer_cohort),
    # windows, sorts, sets, reshape
    "peak_flags": _k(q_peak_flags),
    "partition_mean": _k(q_partition_mean),
    "topk_per_group": _s(R.top_products),
    "sort_asc": _s(q_sort_asc),
    "sort_desc": _s(q_sort_desc),
    "union_distinct": _k(q_union_distinct),
    "union_all": _k(q_union_all),
    "pivot_fixed": _s(q_pivot_fixed),
    "date_series": _k(q_date_series),
    # scalar functions
    "if_else_null": _k(q_if_else_null),
    "zero_fill": _k(q_zero_fill),
    "regex_suffix": _k(q_regex_suffix),
    "path_split": _s(q_path_split),
    "delivery_days": _s(q_delivery_days),
    "delivery_buckets": _s(q_delivery_buckets),
    "status_map": _s(q_status_map),
    "conversion_rate": _k(q_conversion_rate),
    "report_window": _s(q_report_window),
    "weekend_window": _s(q_weekend_window),
    "sold_sku_count": _s(R.sold_sku_count),
    # dimensions, facts, reports
    "area_dim": _s(lambda m: m.area),
    "orders_clean": _k(lambda m: m.orders),
    "items_clean": _s(lambda m: m.items),
    "orders_window": _k(q_orders_window),
    "logins_window": _k(q_logins_window),
    "report_new_users": _e(R.report_new_users),
    "repeat_visit_rate": _k(R.repeat_visit_rate),
    "repeat_order_rate": _k(R.repeat_order_rate),
    "report_visits_orders": _k(q_report_visits_orders),
    "sales_detail": _s(lambda m: m.sales_detail),
    "channel_daily": _s(R.channel_daily),
    "category_daily_self": _s(R.category_daily_self),
    "category_daily_platform": _s(R.category_daily_platform),
    "report_sales": _s(R.report_sales),
    "log_events": _s(q_log_events),
    "delivery_orders": _s(lambda m: m.delivery_orders),
    "delivery_by_status": _s(R.delivery_by_status),
    "delivery_by_channel": _s(R.delivery_by_channel),
    "report_delivery": _s(R.report_delivery),
    "items_month": _s(lambda m: m.items_month),
    "month_sold": _s(R.month_sold),
    "channel_orders": _s(R.channel_orders),
    "channel_buyers": _s(R.channel_buyers),
    "channel_counts": _s(R.channel_counts),
    "sell_through": _s(R.sell_through),
    "campaign_detail": _s(R.campaign_detail),
    "campaign_summary": _s(lambda m: R.campaign_summary(m, localized=True)),
    "campaign_share": _s(R.campaign_share),
    # sinks (write, then read back; rows-only check)
    "sink_csv_report": q_sink_csv_report,
    "sink_bundle": q_sink_bundle,
}
