"""Ingest: raw source tables -> typed logical frames.

Each reader projects only the columns the reports use (Catalyst prunes the
scan to them), renames to the logical names, truncates datetimes to dates and applies the source-side predicates (time
ranges, NOT IN lists, IN-area semi-joins, equality flags), all as plain
filters that reach the Parquet/JDBC scan. Ids keep their native type
(``kpiloom.functions.keys``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.functions.keys import key
from kpiloom.functions.semantics import flag_decode, ratio, to_day
from kpiloom.operators.relational import exclude_accounts, in_window, keep_matching
from kpiloom.params import ReportParams


def _txt(c: str, alias: str | None = None):
    return F.col(c).cast("string").alias(alias or c)


def scan_orders(raw_order: DataFrame, accounts, window: tuple[dt.date, dt.date] | None = None,
                closed: str = "right", with_sn: bool = False) -> DataFrame:
    """Order rows with logical names and types; account filter at the source.

    ``window``: optional source-side range on the raw datetime
    (``closed='right'``: ``(a, b 23:59:59]``; ``'both'``: ``[a, b 23:59:59]``).
    """
    o = raw_order
    if window is not None:
        o = in_window(o, "create_date", window[0], window[1], closed=closed, timestamp=True)
    o = exclude_accounts(o, accounts, "username")
    cols = [key(o, "id"),
            to_day("create_date").alias("create_date"), to_day("paid_date").alias("paid_date"),
            to_day("returns_date").alias("returns_date"), F.col("order_status").cast("int").alias("order_status"),
            key(o, "member", "member_id"), _txt("username"), key(o, "area", "area_id"),
            F.col("original_amount").cast("double").alias("original_amount"),
            _txt("payment_method"), _txt("shipping_method"),
            F.col("shipping_status").cast("int").alias("shipping_status"),
            F.col("delivery_method").cast("int").alias("delivery_method")]
    if with_sn:
        cols.insert(1, _txt("sn", "order_sn"))
    return o.select(*cols)


def scan_order_items(raw_item: DataFrame, start: dt.date, end: dt.date, closed: str = "right",
                     derive_cases: bool = True) -> DataFrame:
    """Items in the source-side range; gift flag decoded to 1/0.

    ``derive_cases``: sale_quantity is recomputed as quantity / sale_factor
    (NULL when the factor is 0), overwriting the stored column; otherwise the
    stored sale_quantity is kept.
    """
    it = in_window(raw_item, "create_date", start, end, closed=closed, timestamp=True)
    cases = (ratio(F.col("quantity").cast("double"), F.col("sale_factor").cast("double")) if derive_cases
             else F.col("sale_quantity").cast("double"))
    return it.select(
        to_day("create_date").alias("create_date"), key(it, "orders", "order_id"), key(it, "sn"),
        key(it, "product", "product_id"), F.col("quantity").cast("double").alias("quantity"),
        F.col("sale_factor").cast("double").alias("sale_factor"),
        cases.alias("sale_quantity"),
        flag_decode("is_gift").alias("is_gift"), F.col("sub_total").cast("double").alias("sub_total"))


def scan_order_log(raw_log: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    lg = in_window(raw_log, "create_date", start, end, closed="right", timestamp=True)
    return lg.select(to_day("create_date").alias("create_date"), F.col("type").cast("int").alias("type"),
                     key(lg, "orders", "order_id"))


def scan_area(raw_area: DataFrame) -> DataFrame:
    return raw_area.select(key(raw_area, "id"), _txt("name"), _txt("name_path"))


def scan_members(raw_member: DataFrame, accounts, areas: DataFrame | None = None,
                 require_login: bool = False) -> DataFrame:
    m = raw_member
    if require_login:
        m = m.filter(F.col("login_date").isNotNull())
    m = exclude_accounts(m, accounts, "username")
    m = m.select(key(m, "id", "member_id"), _txt("name"), _txt("username"), _txt("licence_code"),
                 _txt("shop_name"), _txt("address"), key(m, "area", "area_id"),
                 to_day("first_login_date").alias("first_login_date"))
    if areas is not None:
        m = keep_matching(m, areas, "area_id")
    return m


def scan_app_log(raw_app: DataFrame, p: ReportParams) -> DataFrame:
    """App login events: the login method and a success prefix of the JSON
    snapshot (a prefix test on the text, not a JSON parse)."""
    pre = p.app_success_prefix
    a = raw_app.filter((F.col("method_name") == p.app_login_method)
                       & (F.substring("snap_shot", 1, len(pre)) == F.lit(pre)))
    return a.select(to_day("create_date").alias("login_date"), key(a, "operator", "member_id"),
                    _txt("come_from", "platform_type"))


def scan_logins(raw_login: DataFrame, accounts, areas: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    lg = in_window(raw_login, "login_date", start, end, closed="right", timestamp=True)
    lg = exclude_accounts(lg, accounts, "username")
    lg = lg.select(key(lg, "member", "member_id"), _txt("username"), key(lg, "area", "area_id"), _txt("login_ip"),
                   to_day("login_date").alias("login_date"), to_day("first_login_date").alias("first_login_date"))
    return keep_matching(lg, areas, "area_id")


def scan_products(raw_product: DataFrame) -> DataFrame:
    return raw_product.select(key(raw_product, "id", "product_id"), key(raw_product, "sn"), _txt("name"), _txt("brand"),
                              key(raw_product, "product_category", "cate_id"),
                              F.col("sale_factor").cast("double").alias("sale_factor"),
                              key(raw_product, "dealer", "dealer_id"), F.col("delivery_method").cast("int").alias("delivery_method"))


def scan_categories(raw_cat: DataFrame) -> DataFrame:
    return raw_cat.select(key(raw_cat, "id", "cate_id"), _txt("code"), _txt("name"), _txt("tree_path"))


def scan_dealers(raw_dealer: DataFrame) -> DataFrame:
    return raw_dealer.select(key(raw_dealer, "id", "dealer_id"), _txt("sn"), _txt("name", "supplier"))


def scan_contract_products(raw_cp: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    cp = raw_cp.filter(F.col("is_marketable") == 1).select(key(raw_cp, "area", "area_id"), key(raw_cp, "product", "product_id"))
    return keep_matching(cp, areas, "area_id") if areas is not None else cp
