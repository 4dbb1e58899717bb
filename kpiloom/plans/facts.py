"""Logical model and cleaned facts.

``KeyedFrames`` wires raw tables + parameters into the logical frames the
reports share, with ids in their native type; ``Model`` shows the same frames
with text ids, cast in the last select. Every attribute is a lazy DataFrame;
the only work done while plans are built is the one-time write of the small
dimension snapshots (``prepare`` does it ahead); facts run when a report is
written or collected.
"""

from __future__ import annotations

import threading
import uuid
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.functions.keys import key_values, keys_like, text_ids
from kpiloom.functions.semantics import (
    bucket, if_else, in_set, not_in_set, ship_status_simple,
    strict_sum,
)
from kpiloom.operators.aggregates import first_by
from kpiloom.operators.relational import (
    Accounts, drop_suffix_users, in_window, keep_matching, left_join_renamed, lookup, mark,
)
from kpiloom.operators.reduction import keep_possible
from kpiloom.params import (
    CHANNEL_SELF_OPERATED, LOG_TYPE_COMPLETED, LOG_TYPE_SHIPPED, SHIPPING_AWAITING, SHIPPING_NOT_SHIPPED,
    PAID_STATUSES, SOLD_STATUSES, ReportParams,
)
from kpiloom.plans.dims import area_dim, category_tree, channel_map
from kpiloom.sources import ingest


#: Order of arrival: the day, then the id as a number ("9" before "10").
ARRIVAL = ("create_date", "try_cast(id as decimal(38, 0))", "id")


def run_snapshot_base(spark, *run_key) -> str:
    """Snapshot folder of one run under the session's checkpoint directory,
    keyed by the application and ``run_key`` (e.g. source path, report date)."""
    import hashlib

    from kpiloom.session import app_id, ensure_checkpoint_dir

    key = "|".join([app_id(spark), *map(str, run_key)])
    return f"{ensure_checkpoint_dir(spark)}/dims/{hashlib.sha1(key.encode()).hexdigest()[:20]}"


class KeyedFrames:
    """Logical frames of one report run, ids in their native type.

    ``snapshot`` (True, a folder, or False): derived dimensions (area hierarchy, category tree, channel
    map) are written once per run as Parquet under the session's
    ``spark.checkpoint.dir`` and read back. Their plans are joins, whose
    size the optimizer estimates as the product of the inputs (terabytes for
    a few thousand rows), which would make every fact -> dimension join a
    shuffle of the fact table. Read back from files they carry their real
    size, so Spark broadcasts them when they are under
    ``spark.sql.autoBroadcastJoinThreshold`` and falls back to a sort-merge
    join when they are not. It also cuts their lineage: a lost executor
    re-reads the snapshot instead of recomputing it.
    """

    def __init__(self, raw, p: ReportParams, use_account_table: bool = True,
                 snapshot: bool | str = True):
        self.raw = raw
        self.p = p
        # accounts: the lookup frame (anti-join) and the literal list (pushed filter)
        frame = raw.test_accounts if use_account_table else None
        self.accounts = Accounts(frame, list(p.test_accounts))
        self._snapshot_base = snapshot
        self._written: dict[str, DataFrame] = {}     # dimensions of this run, read back
        self._lock = threading.RLock()    # a dimension may be built from others

    def _snapshot(self, name: str, build) -> DataFrame:
        """``build()`` once per run, written and read back (see class doc)."""
        base = self._snapshot_base
        if not base:
            return build()
        if base is True:
            from kpiloom.session import ensure_checkpoint_dir

            spark = self.raw.order.sparkSession
            base = self._snapshot_base = f"{ensure_checkpoint_dir(spark)}/dims/{uuid.uuid4().hex}"
        path = f"{base}/{name}"
        with self._lock:              # concurrent callers write a snapshot once
            if name not in self._written:
                df = build()
                df.write.mode("overwrite").parquet(path)
                self._written[name] = df.sparkSession.read.parquet(path)
            return self._written[name]

    def prepare(self) -> None:
        """Write the dimension snapshots now, so that building the reports' plans runs no job."""
        for name in ("area", "prod_cate", "channel", "sku") + (("area_campaign",) if self.p.campaign_start else ()):
            getattr(self, name)

    def store_items(self, n_buckets: int | None = None) -> None:
        """Store the item facts once, bucketed and sorted by order id, and read them from there.

        Joins with orders then move the orders only. ``n_buckets`` should give
        buckets of a few hundred MB; by default, and at least, the number of
        shuffle partitions, so that the orders are dealt to the buckets.
        """
        from kpiloom.session import ensure_checkpoint_dir

        spark = self.raw.order.sparkSession
        n = max(n_buckets or 0, int(spark.conf.get("spark.sql.shuffle.partitions")))
        name = f"kpiloom_items_{uuid.uuid4().hex}"
        (self.items_all.repartition(n, "order_id").write.format("parquet").bucketBy(n, "order_id").sortBy("order_id")
         .option("path", f"{ensure_checkpoint_dir(spark)}/tables/{name}").saveAsTable(name))
        for derived in ("items", "sales_detail", "sales_in_window", "items_month", "items_today"):
            self.__dict__.pop(derived, None)
        self.__dict__["items_all"] = spark.table(name)

    # ---- dimensions -------------------------------------------------------
    @cached_property
    def area(self) -> DataFrame:
        """Area dimension of the daily report (areas without district kept)."""
        return self._snapshot("area", lambda: area_dim(ingest.scan_area(self.raw.area), self.p,
                                                       keep_null_district=True))

    @cached_property
    def area_campaign(self) -> DataFrame:
        """Area dimension of the campaign report: its own geography, areas need a district."""
        return self._snapshot("area_campaign", lambda: area_dim(ingest.scan_area(self.raw.area),
                                                                self.p.for_campaign(), keep_null_district=False))

    @cached_property
    def products(self) -> DataFrame:
        return ingest.scan_products(self.raw.product)

    @cached_property
    def categories(self) -> DataFrame:
        return ingest.scan_categories(self.raw.product_category)

    @cached_property
    def prod_cate(self) -> DataFrame:
        return self._snapshot("prod_cate", lambda: category_tree(self.categories))

    @cached_property
    def dealers(self) -> DataFrame:
        return ingest.scan_dealers(self.raw.dealer)

    @cached_property
    def channel(self) -> DataFrame:
        return self._snapshot("channel", lambda: channel_map(self.products, self.dealers, self.p))

    @cached_property
    def sku(self) -> DataFrame:
        """Category, supplier and channel of each sn: one lookup for the items.

        Rows of one sn multiply as in a join with products and then channels,
        since every sn of the channel map is a product's.
        """
        def build():
            return (lookup(lookup(self.products.select("sn", "cate_id"), self.prod_cate, "cate_id"), self.channel, "sn")
                    .withColumn("supplier", F.coalesce("supplier", F.lit(CHANNEL_SELF_OPERATED)))
                    .withColumn("method", F.coalesce("method", F.lit(CHANNEL_SELF_OPERATED))))

        return self._snapshot("sku", build)

    @cached_property
    def campaign_products(self) -> DataFrame:
        """The campaign's list of sn in the type of the products' sn."""
        return keys_like(self.raw.campaign_products, "sn", self.products.schema["sn"].dataType)

    # ---- sources ----------------------------------------------------------
    @cached_property
    def orders(self) -> DataFrame:
        """orders_clean: full history (cohorts need it), test accounts and
        the excluded areas/users removed."""
        p = self.p
        o = ingest.scan_orders(self.raw.order, self.accounts)
        o = drop_suffix_users(o, "area_id", p.x_area_ids, "username", p.x_user_pattern)
        return o.filter(not_in_set("area_id", key_values(o, "area_id", p.dropped_area_ids)))

    def orders_of(self, items: DataFrame) -> DataFrame:
        """Cleaned orders that may be those of ``items``: the bit filter of their ids goes into the order scan."""
        return keep_possible(self.orders, "id", items, "order_id")

    @cached_property
    def items_all(self) -> DataFrame:
        """Non-gift items of the 30-day source range, before the check that
        their order survives the order cleaning."""
        p = self.p
        it = ingest.scan_order_items(self.raw.order_item, p.month_start, p.report_date)
        return it.filter(F.col("is_gift") == 0).drop("quantity", "sale_factor")

    @cached_property
    def items(self) -> DataFrame:
        """items_clean: non-gift items of the 30-day source range whose order
        survives the order cleaning; cases = quantity / sale_factor."""
        return keep_matching(self.items_all, self.orders_of(self.items_all), "order_id", "id")

    @cached_property
    def order_log_all(self) -> DataFrame:
        """Log rows of the 30-day source range, before the order check."""
        p = self.p
        return ingest.scan_order_log(self.raw.order_log, p.month_start, p.report_date)

    @cached_property
    def order_log(self) -> DataFrame:
        return keep_matching(self.order_log_all, self.orders, "order_id", "id")

    @cached_property
    def members(self) -> DataFrame:
        return ingest.scan_members(self.raw.member, self.accounts, self.area)

    @cached_property
    def app(self) -> DataFrame:
        return ingest.scan_app_log(self.raw.app_log, self.p)

    @cached_property
    def logins(self) -> DataFrame:
        p = self.p
        return ingest.scan_logins(self.raw.login, self.accounts, self.area, p.month_start, p.report_date)

    @cached_property
    def contract(self) -> DataFrame:
        return ingest.scan_contract_products(self.raw.contract_product)

    # ---- first events (Q6, Q7) ---------------------------------------------
    @cached_property
    def app_first(self) -> DataFrame:
        """First app login of each member over the whole log."""
        return self.app.groupBy("member_id").agg(F.min("login_date").alias("first_login_date"))

    def buyer_events(self, orders: DataFrame) -> DataFrame:
        """Orders of ``orders`` that count for the first purchase of a (city, buyer): confirmed or completed, in a city."""
        o = orders.filter(in_set("order_status", PAID_STATUSES)).select("id", "area_id", "username", "create_date", "paid_date")
        return lookup(o, self.area, "area_id").filter(F.col("city").isNotNull()).select("city", "username", "id", "create_date", "paid_date")

    @cached_property
    def buyer_first(self) -> DataFrame:
        """Paid date of the first order of each (city, buyer) over the whole history; it may be NULL."""
        return first_by(self.buyer_events(self.orders), ["city", "username"], "paid_date", order=ARRIVAL)

    # ---- 7-day windows (Q9) -----------------------------------------------
    def _drop_x_district(self, df: DataFrame) -> DataFrame:
        p = self.p
        if p.x_district is None:
            return df
        return df.filter(~((F.col("district") == F.lit(p.x_district)) & F.col("username").rlike(p.x_user_pattern)))

    @cached_property
    def orders_window(self) -> DataFrame:
        """order_extracted: statuses 1, 2, 4 of the 7-day window with area."""
        p = self.p
        o = in_window(self.orders, "create_date", p.week_start, p.report_date)
        o = o.filter(in_set("order_status", SOLD_STATUSES)).select(
            "id", "member_id", "create_date", "username", "area_id", "returns_date", "original_amount",
            "order_status")
        return self._drop_x_district(lookup(o, self.area, "area_id"))

    @cached_property
    def logins_window(self) -> DataFrame:
        """login_extracted: logins of the 7-day window with area."""
        p = self.p
        lg = in_window(self.logins, "login_date", p.week_start, p.report_date)
        lg = lg.select("member_id", "username", "area_id", "login_ip", "login_date")
        return self._drop_x_district(lookup(lg, self.area, "area_id"))

    @cached_property
    def order_days(self) -> DataFrame:
        """Orders of the 7-day window once per (city, district, buyer, day):
        rows n and amount (NULL if one of them is). All table2 order measures
        come from this frame, so the grouping sets expand it, not the orders."""
        return self.orders_window.groupBy("city", "district", "username", "create_date").agg(
            F.count(F.lit(1)).alias("n"), strict_sum("original_amount").alias("amount"))

    @cached_property
    def login_days(self) -> DataFrame:
        """Logins of the 7-day window once per (city, district, member, user, day), with rows n."""
        return self.logins_window.groupBy("city", "district", "member_id", "username", "login_date").agg(
            F.count(F.lit(1)).alias("n"))

    # ---- sales detail (Q16) ------------------------------------------------
    def _detail(self, items: DataFrame, how: str) -> DataFrame:
        """7-day rows of ``items`` with category, channel and the attributes of
        their order in ``orders_window`` (``how``: left or inner)."""
        p = self.p
        it = in_window(items, "create_date", p.week_start, p.report_date)
        it = it.filter(F.col("is_gift") != 1).select("order_id", "sn", "sale_quantity", "sub_total", "is_gift")
        # the orders first, where the items lie by order id; then one lookup by sn
        out = lookup(left_join_renamed(it, self.orders_window, "order_id", "id", how=how), self.sku, "sn") \
            .withColumn("supplier", F.coalesce("supplier", F.lit(CHANNEL_SELF_OPERATED))) \
            .withColumn("method", F.coalesce("method", F.lit(CHANNEL_SELF_OPERATED)))
        return out.select(
            "order_id", "sn", "sale_quantity", "sub_total", "is_gift", "cate_id", "cate1", "cate2", "cate3",
            "supplier", "method", "create_date", "username", "area_id", "original_amount", "order_status",
            "province", "city", "district")

    @cached_property
    def sales_detail(self) -> DataFrame:
        """7-day item detail with category, channel and order attributes.
        Items whose order is outside ``orders_window`` keep NULL order
        columns (left join)."""
        return self._detail(self.items, "left")

    @cached_property
    def sales_in_window(self) -> DataFrame:
        """The rows of ``sales_detail`` whose order is in ``orders_window``
        (the only rows the city x day reports keep). Because
        ``orders_window`` holds cleaned orders only, an inner join from the
        unchecked items gives exactly these rows without the semi-join of the
        items with the whole order history. A run that has stored the detail
        takes them from there (``materialize_facts``)."""
        return self._detail(self.items_all, "inner")

    # ---- logistics (Q21, Q22) ----------------------------------------------
    @cached_property
    def shipped(self) -> DataFrame:
        return self.order_log.filter(F.col("type") == LOG_TYPE_SHIPPED) \
            .select(F.col("create_date").alias("shipping_date"), "order_id")

    @cached_property
    def completed(self) -> DataFrame:
        return self.order_log.filter(F.col("type") == LOG_TYPE_COMPLETED) \
            .select(F.col("create_date").alias("complete_date"), "order_id")

    @cached_property
    def delivery_orders(self) -> DataFrame:
        """Shipped 7-day orders with delivery duration, bucket and final
        status. Several log rows per order multiply the order (kept)."""
        p = self.p
        o = self.orders.select("id", "create_date", "username", "order_status", "shipping_status", "area_id",
                               "delivery_method")
        o = in_window(o, "create_date", p.week_start, p.report_date).filter(
            in_set("order_status", PAID_STATUSES)
            & (F.col("shipping_status") != SHIPPING_NOT_SHIPPED) & (F.col("shipping_status") != SHIPPING_AWAITING))
        # the orders are cleaned orders, so joining the log before its own
        # check against the (whole-history) cleaned orders gives the same rows
        # and saves a semi-join with the order history
        log = self.order_log_all
        shipped = log.filter(F.col("type") == LOG_TYPE_SHIPPED) \
            .select(F.col("create_date").alias("shipping_date"), "order_id")
        completed = log.filter(F.col("type") == LOG_TYPE_COMPLETED) \
            .select(F.col("create_date").alias("complete_date"), "order_id")
        o = left_join_renamed(o, shipped, "id", "order_id")
        o = left_join_renamed(o, completed, "id", "order_id")
        ship, done = F.col("shipping_date"), F.col("complete_date")
        no_ship = ship.isNull() & done.isNotNull()
        duration = if_else(no_ship, F.datediff(done, F.col("create_date")), F.datediff(done, ship))
        labels = list(p.delivery_labels)
        effect = if_else(done.isNull() & ship.isNotNull(), F.lit(p.in_transit_label),
                         bucket("duration", p.delivery_thresholds, labels))
        o = (o.withColumn("duration", duration)
             .withColumn("delivery_effect", effect)
             .withColumn("ship_status_simple", ship_status_simple("shipping_status")))
        return lookup(o, self.area, "area_id")

    # ---- 30-day item detail (Q26) ------------------------------------------
    @cached_property
    def items_month(self) -> DataFrame:
        """top_ordered: 30-day items of confirmed/completed orders with
        product name, channel and city."""
        p = self.p
        # the status filter keeps only items of cleaned orders, so the items need no separate semi-join with the
        # order history; the orders get their city before they meet the items, which then move once, by sn
        it = in_window(self.items_all, "create_date", p.month_start, p.report_date).select(
            "create_date", "sn", F.col("sale_quantity").alias("quantity"), "sub_total", "order_id")
        o = self.orders_of(it).filter(in_set("order_status", PAID_STATUSES)).select("id", "username", "area_id")
        o = lookup(o, self.area.drop("province"), "area_id").drop("area_id")
        it = left_join_renamed(it, o, "order_id", "id", how="inner")
        it = lookup(lookup(it, self.products.select("sn", "name"), "sn"), self.channel.select("sn", "method"), "sn")
        it = it.withColumn("method", F.coalesce("method", F.lit(CHANNEL_SELF_OPERATED)))
        return it.select("create_date", "sn", "quantity", "sub_total", "order_id", "name", "username", "method",
                         "city", "district")

    @cached_property
    def items_today(self) -> DataFrame:
        return self.items_month.filter(F.col("create_date") == F.lit(self.p.report_date))

    # ---- campaign report (Q33) ---------------------------------------------
    @cached_property
    def campaign_orders(self) -> DataFrame:
        p = self.p
        o = ingest.scan_orders(self.raw.order, self.accounts, window=(p.campaign_start, p.campaign_end),
                               closed="both", with_sn=True)
        return keep_matching(o, self.area_campaign, "area_id")

    @cached_property
    def campaign_items(self) -> DataFrame:
        p = self.p
        it = ingest.scan_order_items(self.raw.order_item, p.campaign_start, p.campaign_end, closed="both",
                                     derive_cases=False)
        it = keep_matching(it, self.campaign_orders, "order_id", "id")
        return it.select("create_date", "order_id", "sn", "product_id", "sale_quantity", "is_gift", "sub_total")

    @cached_property
    def campaign_members(self) -> DataFrame:
        return ingest.scan_members(self.raw.member, self.accounts, self.area_campaign, require_login=True)

    @cached_property
    def campaign_sales(self) -> DataFrame:
        """Campaign sales detail: every non-gift item of the window with
        product, category, channel, campaign flag, order and customer."""
        o = self.campaign_orders.filter(in_set("order_status", SOLD_STATUSES)).select(
            "id", "order_sn", "member_id", "create_date", "username", "area_id", "original_amount", "order_status")
        o = lookup(o, self.area_campaign, "area_id")
        o = lookup(o, self.campaign_members.select("member_id", F.col("name").alias("name_y"), "shop_name", "address"), "member_id")
        it = self.campaign_items.filter(F.col("is_gift") != 1).select("order_id", "sn", "sale_quantity", "sub_total")
        it = left_join_renamed(it, o.drop("member_id", "area_id"), "order_id", "id")
        it = lookup(it, self.products.select("sn", "cate_id", F.col("name").alias("name_x")), "sn")
        it = lookup(lookup(it, self.prod_cate, "cate_id"), self.channel, "sn").drop("cate_id")
        it = (it.withColumn("supplier", F.coalesce("supplier", F.lit(CHANNEL_SELF_OPERATED)))
              .withColumn("method", F.coalesce("method", F.lit(CHANNEL_SELF_OPERATED))))
        return mark(it, self.campaign_products, "sn", "campaign_prod", members_on="sn")


class Model:
    """The frames of ``KeyedFrames`` (``keyed``) with text ids, by the same names."""

    def __init__(self, raw, p: ReportParams, use_account_table: bool = True,
                 snapshot: bool | str = True):
        self.keyed = KeyedFrames(raw, p, use_account_table, snapshot)
        self.raw, self.p, self.accounts = raw, p, self.keyed.accounts

    def __getattr__(self, name: str):
        if name == "keyed" or name.startswith("_"):
            raise AttributeError(name)
        value = getattr(self.keyed, name)
        return text_ids(value) if isinstance(value, DataFrame) else value
