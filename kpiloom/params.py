"""Report parameters.

Every operator takes its parameters explicitly; nothing is read from globals
or from ``current_date()`` so that a run is reproducible for any report day.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# Labels, code lists and column names whose exact text the
# reports must reproduce. Kept together, in natural order.
# ---------------------------------------------------------------------------
MUNICIPALITIES = ("北京市", "上海市", "天津市", "重庆市")
ALL_CITIES_LABEL = "各地汇总"          # all-city rows of table1/3/4, all-total district of table2
TOTAL_CITY_LABEL = "汇总"              # city label of the grand-total row of table2
CHANNEL_UNIFIED = "统配"
CHANNEL_SELF_DELIVERED = "自配"
CHANNEL_SELF_OPERATED = "自营"
CHANNELS = (CHANNEL_UNIFIED, CHANNEL_SELF_DELIVERED, CHANNEL_SELF_OPERATED)
CHANNEL_COLUMNS = {CHANNEL_UNIFIED: "unified_alloc", CHANNEL_SELF_DELIVERED: "self_alloc",
                   CHANNEL_SELF_OPERATED: "self_supp"}
DELIVERY_LABELS = ("1天", "2天", "3天", "3天以上")
IN_TRANSIT_LABEL = "在途"
DELIVERY_THRESHOLDS = (1, 2, 3)
SHIP_STATUS_LABELS = ("returned", "refused", "normal")
DELIVERY_METHOD_LABELS = ("unified_alloc", "self_alloc", "self_supp")
CATEGORY_COLUMNS = {
    "家庭清洁": "house_care", "进口商品": "imports", "酒水饮料": "drinks", "粮油副食": "grain_oil",
    "美容洗护": "hair_care", "日用百货": "general_merch", "乳品冲调": "dairy", "休闲零食": "snacks",
}
# order status 1 confirmed, 2 completed, 4 (counted with them in the sales windows)
PAID_STATUSES = (1, 2)
SOLD_STATUSES = (1, 2, 4)
LOG_TYPE_SHIPPED, LOG_TYPE_COMPLETED = 15, 18
SHIPPING_NOT_SHIPPED, SHIPPING_AWAITING = 0, 6
SHIPPING_RETURNED, SHIPPING_REFUSED = (4, 7), 8
EXCLUDED_DEALERS = ("2",)
DAILY_PROVINCES = ("浙江省", "江苏省")
DAILY_CITIES = ("苏州市", "杭州市", "南京市", "嘉兴市")
DAILY_EXCLUDED_DISTRICTS = ("木渎A", "海盐A", "海宁A")
CAMPAIGN_PROVINCES = ("江苏省",)
CAMPAIGN_CITIES = ("苏州市",)
CAMPAIGN_EXCLUDED_DISTRICTS = ("木渎A",)
X_AREA_IDS = ("970",)
DROPPED_AREA_IDS = ("3325", "3329", "3313")
X_DISTRICT = "海宁市"
NOT_AVAILABLE = "#N/A"                 # conversion rate of a level without visitors, in exports
APP_LOGIN_METHOD = "userLogin"
APP_SUCCESS_PREFIX = '{"code":1,'
TOP_PRODUCTS_HEADERS = ("市", "商品名称", "当日销售件数", "最近30日销售件数")
SELL_THROUGH_HEADERS = ("配送方式", "市", "上架商品数", "当日动销商品数", "当日动销率")
CHANNEL_COUNT_HEADERS = ("自配单数", "统配单数", "自营单数", "自配人数", "统配人数", "自营人数")
CAMPAIGN_SUMMARY_HEADERS = ("含意大利商品订单数", "订单中意大利商品总金额")
CAMPAIGN_DETAIL_HEADERS = (
    "数据库订单编号", "系统订单编号", "商品代码", "销售数量", "商品金额", "商品名称", "一级品类",
    "二级品类", "三级品类", "订单创建时间", "用户编码", "订单金额", "订单状态", "省", "市", "区",
    "客户姓名", "店铺名称", "地址",
)
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class ReportParams:
    """Parameters of one report run.

    ``report_date``/``week_start``/``month_start`` bound the half-open windows
    ``(week_start, report_date]`` and ``(month_start, report_date]``.
    """

    report_date: dt.date
    week_days: int = 7
    month_days: int = 30
    provinces: tuple = ()
    cities: tuple = ()
    excluded_districts: tuple = ()
    municipalities: tuple = MUNICIPALITIES
    test_accounts: tuple = ()
    # order cleaning (orders_clean): users of these areas whose name matches
    # ``x_user_pattern`` are dropped, and these areas are dropped altogether
    x_area_ids: tuple = ()
    dropped_area_ids: tuple = ()
    x_user_pattern: str = "X$"
    # 7-day windows drop users matching the pattern in this district
    x_district: str | None = None
    # channel map
    excluded_dealers: tuple = EXCLUDED_DEALERS
    # level-1 categories of table3, value -> output column stem
    category_columns: dict = field(default_factory=lambda: dict(CATEGORY_COLUMNS))
    # delivery buckets
    delivery_thresholds: tuple = DELIVERY_THRESHOLDS
    delivery_labels: tuple = DELIVERY_LABELS
    in_transit_label: str = IN_TRANSIT_LABEL
    # app log success filter
    app_login_method: str = APP_LOGIN_METHOD
    app_success_prefix: str = APP_SUCCESS_PREFIX
    # top-k report
    top_n: int = 20
    # monetary sums rounded to this many decimals before ratios (None = raw)
    money_scale: int | None = None
    # sums of cases (quantity / sale_factor) rounded to this many decimals
    quantity_scale: int | None = None
    # campaign report window (inclusive) -- see campaign_window()
    campaign_start: dt.date | None = None
    campaign_end: dt.date | None = None
    # geography of the campaign report (None: the daily lists)
    campaign_provinces: tuple | None = None
    campaign_cities: tuple | None = None
    campaign_excluded_districts: tuple | None = None

    @property
    def week_start(self) -> dt.date:
        return self.report_date - dt.timedelta(days=self.week_days)

    @property
    def month_start(self) -> dt.date:
        return self.report_date - dt.timedelta(days=self.month_days)

    def week_dates(self) -> list[dt.date]:
        return [self.week_start + dt.timedelta(days=i) for i in range(1, self.week_days + 1)]

    @classmethod
    def for_run(cls, today: dt.date, mode: str = "afternoon", **kw) -> "ReportParams":
        """Build parameters for a run on ``today``.

        ``mode='morning'``: report on yesterday, windows end yesterday.
        ``mode='afternoon'``: report on today (the setting that wins in the
        original script, which assigns both and keeps the second).
        """
        if mode == "morning":
            rd = today - dt.timedelta(days=1)
        elif mode == "afternoon":
            rd = today
        else:
            raise ValueError(f"unknown mode {mode!r}")
        return cls(report_date=rd, **kw)

    @classmethod
    def preset(cls, today: dt.date, mode: str = "afternoon", **kw) -> "ReportParams":
        """``for_run`` with the usual geography and cleaning rules switched on:
        the daily and campaign city lists, area 970 without users ending in
        ``X``, the three dropped areas and the district without such users.
        ``kw`` replaces any of them."""
        usual = {"provinces": DAILY_PROVINCES, "cities": DAILY_CITIES,
                 "excluded_districts": DAILY_EXCLUDED_DISTRICTS, "x_area_ids": X_AREA_IDS,
                 "dropped_area_ids": DROPPED_AREA_IDS, "x_district": X_DISTRICT,
                 "campaign_provinces": CAMPAIGN_PROVINCES, "campaign_cities": CAMPAIGN_CITIES,
                 "campaign_excluded_districts": CAMPAIGN_EXCLUDED_DISTRICTS}
        return cls.for_run(today, mode, **{**usual, **kw})

    def for_campaign(self) -> "ReportParams":
        """These parameters with the campaign's geography in place of the daily one."""
        own = {"provinces": self.campaign_provinces, "cities": self.campaign_cities,
               "excluded_districts": self.campaign_excluded_districts}
        return replace(self, **{k: v for k, v in own.items() if v is not None})

    def with_campaign_window(self, today: dt.date) -> "ReportParams":
        """Campaign window: yesterday, or Saturday+Sunday when run on a Monday."""
        start, end = campaign_window(today)
        return replace(self, campaign_start=start, campaign_end=end)


def campaign_window(today: dt.date) -> tuple[dt.date, dt.date]:
    end = today - dt.timedelta(days=1)
    start = today - dt.timedelta(days=2) if today.weekday() == 0 else end
    return start, end
