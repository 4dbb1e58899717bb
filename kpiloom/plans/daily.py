"""A daily run: every report of one report date, written as one bundle.

The reports share a few windowed fact tables (the 7-day sales detail, the
7-day order and login windows, the delivery orders, the 30-day item
detail). Each is computed once, written as Parquet under the session's
``spark.checkpoint.dir`` and read back before the reports run, so:

* the joins behind a shared fact run once, not once per report;
* the reports plan against files with real sizes (broadcast decisions are
  made on actual bytes, sort-merge join beyond the threshold);
* a lost executor re-reads the written table instead of replaying the
  whole lineage back to the sources.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.params import ALL_CITIES_LABEL, NOT_AVAILABLE, TOTAL_CITY_LABEL, ReportParams
from kpiloom.plans import reports as R
from kpiloom.plans.facts import Model, run_snapshot_base
from kpiloom.sources.bundles import Bundle

SHARED_FACTS = ("orders_window", "logins_window", "sales_detail", "delivery_orders", "items_month",
                "campaign_sales")


def materialize_facts(model: Model, names=SHARED_FACTS) -> Model:
    """Write the dimensions, the item facts (by order id) and the shared facts once; the model reads them back."""
    m = model.keyed
    base = m._snapshot_base if isinstance(m._snapshot_base, str) else \
        run_snapshot_base(m.raw.order.sparkSession, "facts", uuid.uuid4().hex)
    m.prepare()
    m.store_items()
    for name in names:
        if name == "campaign_sales" and m.p.campaign_start is None:
            continue
        df: DataFrame = getattr(m, name)
        path = f"{base}/facts/{name}"
        df.write.mode("overwrite").parquet(path)
        m.__dict__[name] = df.sparkSession.read.parquet(path)
        if name == "sales_detail":   # orders of the window always have a day, missing orders none
            m.__dict__["sales_in_window"] = m.sales_detail.filter(F.col("create_date").isNotNull())
    return model


def daily_reports(m: Model, localized: bool = False) -> dict[str, DataFrame]:
    """All reports of the run, by name (lazy frames)."""
    out = {
        "table1_new_users": R.report_new_users(m),
        "table2_visits_orders": R.report_visits_orders(m),
        "table3_sales": R.report_sales(m),
        "table4_delivery": R.report_delivery(m),
        "top_products": R.top_products(m, localized=localized),
        "channel_counts": R.channel_counts(m),
        "sell_through": R.sell_through(m, localized=localized),
        "sales_detail_7d": m.sales_detail,
    }
    if m.p.campaign_start is not None:
        out["campaign_detail"] = R.campaign_detail(m, localized=localized)
        out["campaign_summary"] = R.campaign_summary(m, localized=localized)
    return out


SMALL_REPORTS = ("table1_new_users", "table2_visits_orders", "table3_sales", "table4_delivery", "top_products",
                 "channel_counts", "sell_through", "campaign_summary")


def _totals_first(label: str):
    return F.when(F.col("city") == label, 0).otherwise(1)


#: Row order of the small reports in their files: all-city rows before the cities where the report stacks them so.
REPORT_ORDER = {
    "table1_new_users": ["city", "date"],
    "table2_visits_orders": [_totals_first, "city", "district"],
    "table3_sales": [_totals_first, "city", "date"],
    "table4_delivery": [_totals_first, "city", "delivery_effect"],
    "top_products": ["city", "today_quantity desc nulls last", "name nulls last"],
    "channel_counts": ["city"],
    "sell_through": ["method", "city"],
}


def report_order(name: str, df: DataFrame) -> list:
    """Sort expressions of report ``name``; localized reports are sorted by the same columns by position."""
    label = TOTAL_CITY_LABEL if name == "table2_visits_orders" else ALL_CITIES_LABEL
    plain = {"top_products": ("city", "name", "today_quantity", "monthly_quantity"),
             "sell_through": ("method", "city", "marketable_sn_no", "sold_sn_no", "sales_rate")}.get(name, df.columns)
    column = dict(zip(plain, df.columns))
    out = []
    for key in REPORT_ORDER.get(name, []):
        if callable(key):
            out.append(key(label))
            continue
        c, _, how = key.partition(" ")
        c = F.col(f"`{column[c]}`")
        out.append(c.desc_nulls_last() if how.startswith("desc") else c.asc_nulls_last())
    return out


def run_daily(raw, p: ReportParams, out_base: str, fmt: str = "parquet", localized: bool = False,
              materialize: bool = True, state=None) -> dict[str, str]:
    """Compute and write every report of ``p.report_date`` under
    ``out_base/<report>/report_date=<day>`` and commit them together; returns
    the written paths. A run that dies leaves nothing that ``read_bundle`` sees.

    ``state`` (``kpiloom.plans.state.FirstEvents``) replaces the scans of the
    whole order and login history behind table1 by the stored first events,
    which must have been advanced to the report date."""
    if not p.provinces or not p.cities:
        raise ValueError("set provinces and cities: without them every report is empty")
    if p.campaign_start is not None and not (p.for_campaign().provinces and p.for_campaign().cities):
        raise ValueError("set the campaign's provinces and cities: without them its reports are empty")
    m = Model(raw, p)
    if state is not None:
        state.use(m)
    if materialize:
        materialize_facts(m)
    bundle = Bundle(m.raw.order.sparkSession, out_base, fmt)
    paths = {}
    for name, df in daily_reports(m, localized).items():
        campaign = name.startswith("campaign_")   # stamped with the campaign's own last day
        paths[name] = bundle.stage(
            name, df, (p.campaign_end or p.report_date) if campaign else p.report_date, small=name in SMALL_REPORTS,
            order=() if campaign else report_order(name, df),
            null_text={"conv_rate": NOT_AVAILABLE} if name == "table2_visits_orders" else None)
    bundle.commit()
    return paths
