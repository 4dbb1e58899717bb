"""Report invariants on the driver's sf0.001 tables."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from helpers import SF_SMALL
from kpiloom.catalog.queries import kpi_model, sales_model
from kpiloom.params import ALL_CITIES_LABEL
from kpiloom.plans import reports as R


@pytest.fixture(scope="module")
def km(spark):
    return kpi_model(spark, SF_SMALL)


@pytest.fixture(scope="module")
def sm(spark):
    return sales_model(spark, SF_SMALL)


def test_table1_grid_and_totals(km):
    t = R.report_new_users(km).collect()
    p = km.p
    assert len(t) == (len(p.cities) + 1) * p.week_days
    by_date = defaultdict(lambda: [0, 0])
    allc = {}
    for r in t:
        if r.city == ALL_CITIES_LABEL:
            allc[r.date] = (r.cnt_login, r.cnt_order)
        else:
            by_date[r.date][0] += r.cnt_login
            by_date[r.date][1] += r.cnt_order
    assert {d: tuple(v) for d, v in by_date.items()} == allc


def test_table2_bounds(km):
    for r in R.report_visits_orders(km).collect():
        assert r.unique_visitors <= r.total_visitors
        assert r.dup_login_count <= r.login_count and r.dup_order_count <= r.order_count
        for rate in (r.dup_login_rate, r.dup_order_rate):
            assert rate is None or 0 <= rate <= 1


def test_table3_channels_sum_to_total(sm):
    t = R.report_sales(sm).collect()
    p = sm.p
    assert len(t) == (len(p.cities) + 1) * p.week_days
    for r in t:
        assert abs(r.total_amount - (r.unified_alloc + r.self_alloc + r.self_supp)) < 0.011
    for col in ("total_amount", "unified_alloc", "economy_ss"):
        allc = sum(getattr(r, col) for r in t if r.city == ALL_CITIES_LABEL)
        city = sum(getattr(r, col) for r in t if r.city != ALL_CITIES_LABEL)
        assert abs(allc - city) < 0.05


def test_table4_totals(sm):
    t = R.report_delivery(sm).collect()
    for eff in {r.delivery_effect for r in t}:
        rows = [r for r in t if r.delivery_effect == eff]
        tot = [r for r in rows if r.city == ALL_CITIES_LABEL][0]
        for c in ("normal", "refused", "returned", "self_alloc", "unified_alloc", "self_supp"):
            assert getattr(tot, c) == sum(getattr(r, c) for r in rows if r.city != ALL_CITIES_LABEL)
        for r in rows:
            assert r.self_alloc + r.unified_alloc + r.self_supp <= r.normal


def test_top_products_at_most_n_per_city(sm):
    t = R.top_products(sm).groupBy("city").count().collect()
    assert all(r["count"] <= sm.p.top_n for r in t)


def test_sell_through_rate_bounds(sm):
    for r in R.sell_through(sm).collect():
        assert 0 <= r.sold_sn_no <= r.marketable_sn_no
        assert 0 <= r.sales_rate <= 1


def test_independent_of_partitioning(spark, sm):
    from kpiloom.plans.facts import Model
    from kpiloom.sources.bindings import sales_params, test_raw_tables

    a = R.report_delivery(sm).collect()
    m2 = Model(test_raw_tables(spark, SF_SMALL, "orders"), sales_params(), snapshot=False)
    m2.raw.order = m2.raw.order.repartition(7)
    m2.raw.order_log = m2.raw.order_log.repartition(1)
    b = R.report_delivery(m2).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
