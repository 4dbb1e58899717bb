"""Report compositions (tables 1-4, supplements, campaign report).

Each function takes a ``Model`` and returns a lazy DataFrame. Grids come
from the report parameters (bounded, broadcast); facts are filtered to the
grid's cities and window before they are aggregated, so only grid-sized
aggregates meet the grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.functions.keys import text_ids
from kpiloom.functions.semantics import in_set, money, n_distinct, ratio, strict_sum, zero_fill
from kpiloom.operators.aggregates import LEVEL_COL, cohort_counts, level_sets, repeat_rate, users_by_level
from kpiloom.operators.grid import DateRange, densify, param_grid, values_frame
from kpiloom.operators.relational import lookup, mark, null_safe_left_join
from kpiloom.operators.windows import peaks, top_n
from kpiloom.params import (
    ALL_CITIES_LABEL, CAMPAIGN_DETAIL_HEADERS, CAMPAIGN_SUMMARY_HEADERS, CHANNEL_COLUMNS,
    CHANNEL_SELF_DELIVERED, CHANNEL_SELF_OPERATED, CHANNEL_UNIFIED, CHANNELS, DELIVERY_METHOD_LABELS,
    PAID_STATUSES, SELL_THROUGH_HEADERS, SHIP_STATUS_LABELS, TOP_PRODUCTS_HEADERS, TOTAL_CITY_LABEL,
)
from kpiloom.plans.facts import ARRIVAL, Model  # noqa: F401 - ARRIVAL is used with these reports


def _spark(m: Model) -> SparkSession:
    return m.raw.order.sparkSession


def _grid_city_date(m: Model, date: str = "date") -> DataFrame:
    s = _spark(m)
    p = m.p
    return param_grid(s, **{"city": list(p.cities), date: DateRange(p.week_dates()[0], p.report_date)})


# ---------------------------------------------------------------------------
# table1: new logins and new buyers per city and day (Q6-Q8)
# ---------------------------------------------------------------------------
def new_login_cohort(m: Model) -> DataFrame:
    """First login per (city, member) from app logins and the recorded first
    login; members per (city, first day) inside the week window."""
    p = m.p
    app_first = lookup(m.keyed.app_first, m.keyed.members.select("member_id", "area_id"), "member_id")
    pc = m.keyed.members.select("member_id", "first_login_date", "area_id")
    both = lookup(app_first.unionByName(pc), m.keyed.area, "area_id").filter(F.col("city").isNotNull())
    out = cohort_counts(both, ["city"], "member_id", "first_login_date", out_date="date")
    return out.filter((F.col("date") > F.lit(p.week_start)) & (F.col("date") <= F.lit(p.report_date)))


def new_buyer_cohort(m: Model) -> DataFrame:
    """First paid date per (city, buyer) over the whole order history (status
    1, 2); buyers per (city, first paid day) inside the week window. The
    first row is the earliest by (day, numeric id); its paid date may be NULL,
    and such buyers are not counted."""
    p = m.p
    out = m.keyed.buyer_first.groupBy("city", F.col("paid_date").alias("date")).agg(F.count(F.lit(1)).alias("count"))
    return out.filter((F.col("date") > F.lit(p.week_start)) & (F.col("date") <= F.lit(p.report_date)))


def report_new_users(m: Model) -> DataFrame:
    """table1: city x day grid of new logins and buyers, an all-city row per
    day, per-city peak values and means."""
    grid = _grid_city_date(m)
    lg = new_login_cohort(m).withColumnRenamed("count", "cnt_login")
    od = new_buyer_cohort(m).withColumnRenamed("count", "cnt_order")
    city = densify(lg, grid, ["city", "date"])
    # od has one row per (city, date); reduced to grid cells it is grid-bounded
    city = city.join(F.broadcast(od.join(F.broadcast(grid), ["city", "date"], "left_semi")), ["city", "date"],
                     "left")
    city = zero_fill(city, ["cnt_login", "cnt_order"])
    total = (city.groupBy("date").agg(F.sum("cnt_login").alias("cnt_login"), F.sum("cnt_order").alias("cnt_order"))
             .withColumn("city", F.lit(ALL_CITIES_LABEL)))
    both = city.select("city", "date", "cnt_login", "cnt_order").unionByName(
        total.select("city", "date", "cnt_login", "cnt_order")).distinct()
    out = peaks(both, ["city"], ["cnt_login", "cnt_order"], suffixes={"cnt_login": "login", "cnt_order": "order"})
    return out.select("city", "date", "cnt_login", "cnt_order", "login_max", "login_min", "order_max", "order_min",
                      "login_avg", "order_avg")


# ---------------------------------------------------------------------------
# table2: visits and orders at total / city / district level (Q10-Q15)
# ---------------------------------------------------------------------------
LEVELS = ["city", "district"]


def rollup_visits(m: Model) -> DataFrame:
    """Report-day visits (rows) and unique visitors per level."""
    lg = m.keyed.login_days.filter(F.col("login_date") == F.lit(m.p.report_date))
    return level_sets(lg, LEVELS, [F.sum("n").alias("total_visitors"),
                                   n_distinct("member_id").alias("unique_visitors")],
                      empty={"total_visitors": 0, "unique_visitors": 0})


def rollup_orders(m: Model) -> DataFrame:
    """Report-day buyers, orders, amount and average ticket per level."""
    o = m.keyed.order_days.filter(F.col("create_date") == F.lit(m.p.report_date))
    out = level_sets(o, LEVELS, [n_distinct("username").alias("people_count"),
                                 F.sum("n").alias("total_quant"),
                                 money(strict_sum("amount"), m.p.money_scale).alias("total_amount")],
                     empty={"people_count": 0, "total_quant": 0, "total_amount": 0.0})
    return out.withColumn("daily_pct", ratio(F.col("total_amount"), F.col("total_quant")))


def rollup_weekly(m: Model) -> DataFrame:
    """7-day amount, average ticket and orders per day per level."""
    o = m.keyed.order_days
    out = level_sets(o, LEVELS, [money(strict_sum("amount"), m.p.money_scale).alias("wkly_total_amount"),
                                 F.sum("n").alias("__n")],
                     empty={"wkly_total_amount": 0.0, "__n": 0})
    return (out.withColumn("wkly_pct", ratio(F.col("wkly_total_amount"), F.col("__n")))
            .withColumn("wkly_avg_quant", F.col("__n") / F.lit(float(m.p.week_days))).drop("__n"))


def repeat_visit_rate(m: Model) -> DataFrame:
    return repeat_rate(m.keyed.login_days, LEVELS, "username", "login_date",
                       count_name="login_count", repeat_name="dup_login_count", rate_name="dup_login_rate")


def repeat_order_rate(m: Model) -> DataFrame:
    return repeat_rate(m.keyed.order_days, LEVELS, "username", "create_date",
                       count_name="order_count", repeat_name="dup_order_count", rate_name="dup_order_rate")


def _table2_measures(m: Model) -> DataFrame:
    """All measures of table2 per level, in one aggregate over rows that know their level.

    Distinct members, visitors and buyers come as one row per person and level
    (``users_by_level``); visits, orders and amounts are first summed per
    district, and only these sums are repeated for the levels above.
    """
    p, k = m.p, m.keyed
    today = F.lit(p.report_date)
    who = lambda kind, df, user, day: df.select(
        F.lit(kind).alias("kind"), F.col(user).cast("string").alias("who"), *LEVELS, F.col(day).alias("day"))
    # filters on the day would give each use of the facts a scan of its own; without them all share one shuffle
    people = who("member", k.login_days, "member_id", "login_date") \
        .unionByName(who("visitor", k.login_days, "username", "login_date")) \
        .unionByName(who("buyer", k.order_days, "username", "create_date"))
    people = users_by_level(people, LEVELS, ["kind", "who"], "day").select(
        LEVEL_COL, *LEVELS, "kind", (F.size("days") >= 2).alias("again"), F.array_contains("days", today).alias("today"))

    day = F.col("create_date") == today
    visits = k.login_days.select(*LEVELS, F.when(F.col("login_date") == today, F.col("n")).alias("visits"))
    orders = k.order_days.select(
        *LEVELS, F.when(day, F.col("n")).alias("day_n"), F.when(day, F.col("amount")).alias("day_amount"),
        F.when(day & F.col("amount").isNull(), 1).alias("day_unknown"), F.col("n").alias("week_n"),
        F.col("amount").alias("week_amount"), F.when(F.col("amount").isNull(), 1).alias("week_unknown"))
    names = ["visits", "day_n", "day_amount", "day_unknown", "week_n", "week_amount", "week_unknown"]
    sums = visits.unionByName(orders, allowMissingColumns=True).groupBy(*LEVELS).agg(*[F.sum(c).alias(c) for c in names])
    none = {c: F.lit(None).cast(sums.schema[c].dataType) for c in LEVELS}
    level = lambda n: F.struct(F.lit(n).alias(LEVEL_COL), *[(F.col(c) if i < n else none[c]).alias(c) for i, c in enumerate(LEVELS)])
    sums = sums.select(F.explode(F.array(*[level(n) for n in range(len(LEVELS) + 1)])).alias("at"), *names).select("at.*", *names)
    total = _spark(m).range(1).select(F.lit(0).alias(LEVEL_COL), *[none[c].alias(c) for c in LEVELS])   # there on empty input too

    of = lambda kind: F.col("kind") == kind
    known = lambda part: F.when(F.sum(f"{part}_unknown").isNull(), F.sum(f"{part}_amount"))
    out = people.unionByName(sums, allowMissingColumns=True).unionByName(total, allowMissingColumns=True) \
        .groupBy(LEVEL_COL, *LEVELS).agg(
            F.sum("visits").alias("total_visitors"), F.count_if(of("member") & F.col("today")).alias("unique_visitors"),
            F.count_if(of("buyer") & F.col("today")).alias("people_count"), F.coalesce(F.sum("day_n"), F.lit(0)).alias("total_quant"),
            money(known("day"), p.money_scale).alias("total_amount"),
            F.count_if(of("visitor")).alias("login_count"), F.count_if(of("visitor") & F.col("again")).alias("dup_login_count"),
            F.count_if(of("buyer")).alias("order_count"), F.count_if(of("buyer") & F.col("again")).alias("dup_order_count"),
            money(known("week"), p.money_scale).alias("week_amount"), F.coalesce(F.sum("week_n"), F.lit(0)).alias("week_n"))
    return (out.withColumn("dup_login_rate", ratio(F.col("dup_login_count"), F.col("login_count")))
            .withColumn("dup_order_rate", ratio(F.col("dup_order_count"), F.col("order_count")))
            .withColumn("daily_pct", ratio(F.col("total_amount"), F.col("total_quant")))
            .withColumn("wkly_pct", ratio(F.col("week_amount"), F.col("week_n")))
            .withColumn("wkly_avg_quant", F.col("week_n") / F.lit(float(p.week_days))))


TABLE2_COLUMNS = ["city", "district", "total_visitors", "unique_visitors", "people_count", "total_quant",
                  "total_amount", "conv_rate", "login_count", "dup_login_count", "dup_login_rate", "order_count",
                  "dup_order_count", "dup_order_rate", "daily_pct", "wkly_pct", "wkly_avg_quant"]


def report_visits_orders(m: Model, with_level: bool = False) -> DataFrame:
    """table2. Rows are driven by visits: a level without a visit on the
    report day has no row. The total row counts every order of the window,
    also those outside the report cities."""
    out = _table2_measures(m).filter((F.col(LEVEL_COL) == 0) | F.col("total_visitors").isNotNull())
    out = out.withColumn("district", F.when(F.col("city").isNull() & F.col("district").isNull(),
                                            F.lit(ALL_CITIES_LABEL))
                         .otherwise(F.coalesce("district", "city"))) \
             .withColumn("city", F.coalesce("city", F.lit(TOTAL_CITY_LABEL)))
    out = zero_fill(out, ["total_visitors", "unique_visitors", "people_count", "total_quant", "total_amount",
                          "login_count", "dup_login_count", "order_count", "dup_order_count", "daily_pct",
                          "wkly_pct", "wkly_avg_quant"])
    out = out.withColumn("conv_rate", ratio(F.col("people_count"), F.col("unique_visitors")))
    cols = ([LEVEL_COL] if with_level else []) + TABLE2_COLUMNS
    return out.select(*cols)


# ---------------------------------------------------------------------------
# table3: sales by channel and category on a city x day grid (Q17-Q20)
# ---------------------------------------------------------------------------
def _grid_sales(m: Model) -> DataFrame:
    return m.keyed.sales_in_window.filter(in_set("city", m.p.cities)).withColumnRenamed("create_date", "date")


def _strict_cell(cond, value: str, scale: int | None):
    """Strict sum of ``value`` over rows where ``cond`` holds: NULL when no
    row matches or a matching value is NULL (the cell a long->wide spread of
    per-key sums would produce)."""
    x = F.when(cond, F.col(value))
    return money(F.when(F.count_if(cond) == F.count(x), F.sum(x)), scale)


def _sales_cells(m: Model, channels: bool = True, self_cats: bool = True, platform_cats: bool = True) -> DataFrame:
    """One aggregate over the 7-day sales detail per (city, day) holding every
    wide cell of table3: amount per channel and per (self-operated /
    platform, level-1 category). Conditional aggregation replaces three
    long aggregates + pivots: one scan, one shuffle of partial aggregates."""
    scale = m.p.money_scale
    meth, cate = F.col("method"), F.col("cate1")
    cells = []
    if channels:
        cells += [_strict_cell(meth == v, "sub_total", scale).alias(CHANNEL_COLUMNS[v]) for v in CHANNELS]
    if self_cats:
        cells += [_strict_cell((meth == CHANNEL_SELF_OPERATED) & (cate == c), "sub_total", scale).alias(f"{st}_ss")
                  for c, st in m.p.category_columns.items()]
    if platform_cats:
        cells += [_strict_cell((meth != CHANNEL_SELF_OPERATED) & (cate == c), "sub_total", scale).alias(f"{st}_pf")
                  for c, st in m.p.category_columns.items()]
    agg = _grid_sales(m).groupBy("city", "date").agg(*cells)
    return densify(agg, _grid_city_date(m), ["city", "date"])


def channel_daily(m: Model) -> DataFrame:
    """Amount per city x day x channel, one column per channel (NULL where
    the channel sold nothing)."""
    return _sales_cells(m, True, False, False)


def category_daily_self(m: Model) -> DataFrame:
    """Self-operated amount per city x day x level-1 category, wide."""
    return _sales_cells(m, False, True, False)


def category_daily_platform(m: Model) -> DataFrame:
    """Platform (unified + self-delivered) amount per level-1 category, wide."""
    return _sales_cells(m, False, False, True)


def report_sales(m: Model) -> DataFrame:
    """table3: all-city rows first, then city rows; missing cells are 0 and
    total_amount is the sum of the three channels."""
    stems = list(m.p.category_columns.values())
    cat_cols = [f"{s}_ss" for s in stems] + [f"{s}_pf" for s in stems]
    ch_cols = ["unified_alloc", "self_alloc", "self_supp"]
    city = zero_fill(_sales_cells(m), ch_cols + cat_cols)
    city = city.withColumn("total_amount", money(F.col("unified_alloc") + F.col("self_alloc") + F.col("self_supp"),
                                                 m.p.money_scale))
    cols = ["city", "date", "total_amount"] + ch_cols + cat_cols
    total = (city.groupBy("date").agg(*[money(F.sum(c), m.p.money_scale).alias(c)
                                        for c in ch_cols + cat_cols + ["total_amount"]])
             .withColumn("city", F.lit(ALL_CITIES_LABEL)))
    return total.select(*cols).unionByName(city.select(*cols))


# ---------------------------------------------------------------------------
# table4: delivery time by final status and by channel (Q23-Q25)
# ---------------------------------------------------------------------------
def _effects(m: Model) -> list[str]:
    return list(m.p.delivery_labels) + [m.p.in_transit_label]


def _delivery_cells(m: Model, status: bool = True, channel: bool = True) -> DataFrame:
    """Orders per (city, delivery bucket): one count column per final status
    and, for normal orders, per delivery channel; zero where none. Orders
    without a bucket, status or channel fall outside every cell."""
    from kpiloom.functions.semantics import channel_of_delivery_method

    s = _spark(m)
    st = F.col("ship_status_simple")
    cells = []
    if status:
        cells += [F.count_if(st == v).alias(v) for v in SHIP_STATUS_LABELS]
    if channel:
        ch = channel_of_delivery_method("delivery_method")
        cells += [F.count_if((st == "normal") & (ch == v)).alias(v) for v in DELIVERY_METHOD_LABELS]
    agg = (m.keyed.delivery_orders.filter(in_set("city", m.p.cities))
           .groupBy("city", "delivery_effect").agg(*cells))
    grid = param_grid(s, city=list(m.p.cities), delivery_effect=_effects(m))
    cols = (list(SHIP_STATUS_LABELS) if status else []) + (list(DELIVERY_METHOD_LABELS) if channel else [])
    return zero_fill(densify(agg, grid, ["city", "delivery_effect"]), cols)


def delivery_by_status(m: Model) -> DataFrame:
    return _delivery_cells(m, True, False)


def delivery_by_channel(m: Model) -> DataFrame:
    return _delivery_cells(m, False, True)


def report_delivery(m: Model) -> DataFrame:
    """table4: all-city rows per bucket, then city rows."""
    cols = ["city", "delivery_effect", "normal", "refused", "returned", "self_alloc", "unified_alloc", "self_supp"]
    city = _delivery_cells(m).select(*cols)
    total = (city.groupBy("delivery_effect").agg(*[F.sum(c).alias(c) for c in cols[2:]])
             .withColumn("city", F.lit(ALL_CITIES_LABEL)))
    return total.select(*cols).unionByName(city)


# ---------------------------------------------------------------------------
# supplements (Q27-Q31)
# ---------------------------------------------------------------------------
def month_sold(m: Model) -> DataFrame:
    """30-day cases per city x product name."""
    return m.keyed.items_month.groupBy("city", "name").agg(
        money(strict_sum("quantity"), m.p.quantity_scale).alias("monthly_quantity"))


def top_products(m: Model, localized: bool = False) -> DataFrame:
    """Top products of the report day per city with their 30-day cases.
    Ties at the cut are broken by product name."""
    today = m.keyed.items_today.groupBy("city", "name").agg(
        money(strict_sum("quantity"), m.p.quantity_scale).alias("today_quantity"))
    top = top_n(today, ["city"], [F.col("today_quantity").desc_nulls_last(), F.col("name").asc_nulls_last()],
                m.p.top_n)
    out = null_safe_left_join(top, month_sold(m), ["city", "name"])
    out = out.select("city", "name", "today_quantity", "monthly_quantity")
    return out.toDF(*TOP_PRODUCTS_HEADERS) if localized else out


def _channel_distinct(m: Model, orders: bool = True, buyers: bool = True) -> DataFrame:
    """7-day distinct orders / buyers per city and channel, wide, 0 where
    none. One (city, channel) aggregate, then a per-city fold of its <= 3
    rows into columns."""
    from kpiloom.params import CHANNEL_COUNT_HEADERS as H

    sd = m.keyed.sales_in_window.filter(in_set("city", m.p.cities))
    aggs = ([n_distinct("order_id").alias("n_orders")] if orders else []) + \
        ([n_distinct("username").alias("n_buyers")] if buyers else [])
    long = sd.groupBy("city", "method").agg(*aggs)
    order = [CHANNEL_SELF_DELIVERED, CHANNEL_UNIFIED, CHANNEL_SELF_OPERATED]
    cells, names = [], []
    if orders:
        names += list(H[:3])
        cells += [F.max(F.when(F.col("method") == v, F.col("n_orders"))).alias(h) for v, h in zip(order, H[:3])]
    if buyers:
        names += list(H[3:])
        cells += [F.max(F.when(F.col("method") == v, F.col("n_buyers"))).alias(h) for v, h in zip(order, H[3:])]
    wide = long.groupBy("city").agg(*cells)
    out = densify(wide, values_frame(_spark(m), "city", m.p.cities), ["city"])
    return zero_fill(out, names).select("city", *names)


def channel_orders(m: Model) -> DataFrame:
    """7-day distinct orders per city and channel."""
    return _channel_distinct(m, True, False)


def channel_buyers(m: Model) -> DataFrame:
    """7-day distinct buyers per city and channel."""
    return _channel_distinct(m, False, True)


def channel_counts(m: Model) -> DataFrame:
    return _channel_distinct(m, True, True)


def sell_through(m: Model, localized: bool = False) -> DataFrame:
    """Listed SKUs per channel x city and the share sold on the report day.

    The sold flag is global per sn (sold anywhere today). Listed SKUs
    without a channel count as unified distribution here.
    """
    k = m.keyed
    listed = lookup(lookup(k.contract, k.products.select("product_id", "sn"), "product_id"), k.area, "area_id")
    listed = lookup(listed.select("city", "district", "sn"), k.channel.select("sn", "method"), "sn") \
        .withColumn("method", F.coalesce("method", F.lit(CHANNEL_UNIFIED)))
    listed = mark(listed, m.keyed.items_today, "sn", "sold")
    per_sn = listed.groupBy("city", "method", "sn").agg(F.max("sold").alias("sold"))
    out = (per_sn.groupBy("method", "city").agg(F.count(F.lit(1)).alias("marketable_sn_no"),
                                                 F.sum("sold").cast("bigint").alias("sold_sn_no"))
           .withColumn("sales_rate", ratio(F.col("sold_sn_no"), F.col("marketable_sn_no"))))
    return out.toDF(*SELL_THROUGH_HEADERS) if localized else out


def sold_sku_count(m: Model) -> DataFrame:
    """Distinct SKUs sold on the report day per city x channel."""
    return m.keyed.items_today.groupBy("city", "method").agg(n_distinct("sn").alias("count"))


# ---------------------------------------------------------------------------
# campaign report (Q33-Q35)
# ---------------------------------------------------------------------------
CAMPAIGN_DETAIL_COLUMNS = ["order_id", "order_sn", "sn", "sale_quantity", "sub_total", "name_x", "cate1", "cate2",
                           "cate3", "create_date", "username", "original_amount", "order_status", "province",
                           "city", "district", "name_y", "shop_name", "address"]


def campaign_detail(m: Model, localized: bool = False) -> DataFrame:
    """Items of campaign products with category, order and customer."""
    out = text_ids(m.keyed.campaign_sales.filter(F.col("campaign_prod") == 1).select(*CAMPAIGN_DETAIL_COLUMNS))
    return out.toDF(*CAMPAIGN_DETAIL_HEADERS) if localized else out


def campaign_summary(m: Model, localized: bool = False) -> DataFrame:
    """Orders containing campaign goods and the campaign goods amount."""
    out = m.keyed.campaign_sales.filter(F.col("campaign_prod") == 1).agg(
        n_distinct("order_id").alias("no_order_it"),
        money(strict_sum("sub_total"), m.p.money_scale).alias("subtotal_it"))
    return out.toDF(*CAMPAIGN_SUMMARY_HEADERS) if localized else out


def campaign_share(m: Model) -> DataFrame:
    """Campaign orders and amount as a share of all orders and amount."""
    cs = m.keyed.campaign_sales
    it = F.col("campaign_prod") == 1
    scale = m.p.money_scale
    out = cs.agg(
        (F.count_distinct(F.when(it, F.col("order_id")))
         + F.coalesce(F.max(F.when(it, F.col("order_id").isNull().cast("int"))), F.lit(0))).alias("no_order_it"),
        money(F.when(F.count_if(it) == F.count(F.when(it, F.col("sub_total"))),
                     F.coalesce(F.sum(F.when(it, F.col("sub_total"))), F.lit(0.0))), scale).alias("subtotal_it"),
        n_distinct("order_id").alias("no_order_tt"),
        money(strict_sum("sub_total"), scale).alias("subtotal_tt"))
    return (out.withColumn("order_frac", ratio(F.col("no_order_it"), F.col("no_order_tt")))
            .withColumn("subtotal_frac", ratio(F.col("subtotal_it"), F.col("subtotal_tt"))))
