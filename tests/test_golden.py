"""Hand-computed golden results on the tiny raw fixture."""

from helpers import rows
from kpiloom.plans import reports as R
from kpiloom.plans.facts import Model
from rawfixture import PARAMS, raw_tables


def model(spark):
    return Model(raw_tables(spark), PARAMS)


def test_area_dim(spark):
    m = model(spark)
    got = rows(m.area, "area_id", "city", "district")
    # DX excluded; P1,C1 has no district (kept); municipality shifted; P2 dropped
    assert got == [("1", "C1", "D1"), ("2", "C1", "D2"), ("3", "C2", "D3"), ("5", "C1", None),
                   ("6", "北京市", "朝阳区"), ("970", "C2", "HN"), ("999", "C1", "D1")]
    assert rows(Model(raw_tables(spark), PARAMS).area_campaign, "area_id") == [
        ("1",), ("2",), ("3",), ("6",), ("970",), ("999",)]


def test_orders_clean(spark):
    m = model(spark)
    # test account (105), NULL username (106), area 970 user ending X (104), area 999 (108) dropped
    assert rows(m.orders, "id") == [("100",), ("101",), ("102",), ("103",), ("107",)]


def test_table2_golden(spark):
    m = model(spark)
    out = {(r.city, r.district): r for r in R.report_visits_orders(m).collect()}
    assert set(out) == {("汇总", "各地汇总"), ("C1", "C1"), ("C1", "D1"), ("C2", "C2"), ("C2", "D3"),
                        ("北京市", "北京市"), ("北京市", "朝阳区")}
    tot = out[("汇总", "各地汇总")]
    # report-day visits: u10 x2 (area 1), u12 (area 3), u14 (area 6)
    assert (tot.total_visitors, tot.unique_visitors) == (4, 3)
    # report-day orders, status 1/2/4 in window: 100 (u10), 102 (u12), 107 (u15, area outside cities)
    assert (tot.people_count, tot.total_quant, tot.total_amount) == (3, 3, 19.5)
    assert tot.conv_rate == 1.0
    assert tot.daily_pct == 6.5
    # week: 100, 101, 102, 107 -> 39.5 / 4
    assert tot.wkly_pct == 39.5 / 4 and abs(tot.wkly_avg_quant - 4 / 7) < 1e-12
    # repeat visits: u10 (3/8, 3/10), u14 (3/9, 3/10) repeat; u12 not
    assert (tot.login_count, tot.dup_login_count) == (3, 2)
    # repeat orders: u10 (3/9, 3/10) repeat; u12 and u15 not
    assert (tot.order_count, tot.dup_order_count) == (3, 1)
    c1 = out[("C1", "C1")]
    assert (c1.total_visitors, c1.unique_visitors, c1.people_count, c1.total_amount) == (2, 1, 1, 10.0)
    assert c1.wkly_pct == 15.0 and c1.dup_order_rate == 1.0
    d3 = out[("C2", "D3")]
    assert (d3.total_visitors, d3.people_count, d3.total_quant, d3.dup_login_count) == (1, 1, 1, 0)


def test_table1_golden(spark):
    m = model(spark)
    t1 = {(r.city, r.date.isoformat()): r for r in R.report_new_users(m).collect()}
    assert len(t1) == (3 + 1) * 7
    # member 10: first login 3/9 (recorded) vs app (none) -> C1 on 3/9
    assert t1[("C1", "2024-03-09")].cnt_login == 1
    # buyer u10 first paid 3/9 (order 101 created first); u12 has only status 4 and 3 orders,
    # which are not purchases for the new-buyer count
    assert t1[("C1", "2024-03-09")].cnt_order == 1
    assert t1[("C1", "2024-03-10")].cnt_order == 0
    assert t1[("C2", "2024-03-10")].cnt_order == 0
    allc = t1[("各地汇总", "2024-03-10")]
    assert allc.cnt_order == sum(t1[(c, "2024-03-10")].cnt_order for c in ("C1", "C2", "北京市"))
    # peaks: C1's cnt_order max is 1 (on 3/9), other days NULL
    assert t1[("C1", "2024-03-09")].order_max == 1 and t1[("C1", "2024-03-08")].order_max is None
    assert abs(t1[("C1", "2024-03-08")].order_avg - 1 / 7) < 1e-12


def test_t14_null_district_row_labelled_with_city(spark):
    from rawfixture import LOGIN, T

    # a report-day login from area 5 (P1,C1: no district)
    raw = raw_tables(spark, login=LOGIN + [(12, "u12", 5, "ip", T(2024, 3, 10, 20), None)])
    out = R.report_visits_orders(Model(raw, PARAMS), with_level=True)
    c1 = sorted((r.level, r.total_visitors) for r in out.collect() if (r.city, r.district) == ("C1", "C1"))
    # the city row (level 1) and the NULL-district row (level 2) carry the same labels
    assert c1 == [(1, 3), (2, 1)]


def test_t13_rows_driven_by_visits(spark):
    # C2/D3 has orders but, without its visit, no table2 row
    from rawfixture import LOGIN

    raw = raw_tables(spark, login=[r for r in LOGIN if r[2] != 3])
    out = R.report_visits_orders(Model(raw, PARAMS)).collect()
    assert not [r for r in out if r.city == "C2"]
    tot = [r for r in out if r.city == "汇总"][0]
    assert tot.total_quant == 3          # the total still counts every order of the report day


def test_campaign_golden_t16(spark):
    from rawfixture import T

    items = [  # create, order, sn, product, quantity, factor, sale_quantity, gift, sub_total
        (T(2024, 3, 10, 10), 100, 501, 501, 2.0, 1.0, 2.0, False, 10.0),
        (T(2024, 3, 10, 12), 103, 501, 501, 1.0, 1.0, 1.0, False, 7.0),    # cancelled order (T16)
        (T(2024, 3, 10, 10), 100, 502, 502, 1.0, 1.0, 1.0, False, 3.0),    # not a campaign product
        (T(2024, 3, 10, 10), 100, 501, 501, 1.0, 1.0, 1.0, True, 99.0),    # gift
        (T(2024, 3, 9, 10), 101, 501, 501, 1.0, 1.0, 1.0, None, 5.0),      # unknown gift flag
        (T(2024, 3, 10, 13), 107, 501, 501, 1.0, 1.0, 1.0, False, 4.0),    # order outside the areas
    ]
    product = [(501, 501, "pasta", "B", "L3", 1.0, 1, 0), (502, 502, "soap", "B", None, 1.0, 1, 2)]
    cats = [("L1", "11", "Food", ","), ("L2", "2222", "Pasta", ",L1,"), ("L3", "333333", "Spaghetti", ",L1,L2,")]
    raw = raw_tables(spark, order_item=items, product=product, product_category=cats,
                     dealer=[(1, "D1", "sup1")])
    raw.campaign_products = spark.createDataFrame([("501",)], "sn string")
    m = Model(raw, PARAMS)
    det = {(r.order_id, r.sn): r for r in R.campaign_detail(m).collect()}
    assert set(det) == {("100", "501"), ("103", "501")}
    assert (det[("100", "501")].cate1, det[("100", "501")].cate2, det[("100", "501")].cate3) == \
        ("Food", "Pasta", "Spaghetti")
    assert det[("100", "501")].name_y == "m10" and det[("100", "501")].district == "D1"
    assert det[("103", "501")].order_sn is None and det[("103", "501")].city is None
    s = R.campaign_summary(m).collect()[0]
    assert (s.no_order_it, s.subtotal_it) == (2, 17.0)
    share = R.campaign_share(m).collect()[0]
    assert (share.no_order_tt, share.subtotal_tt) == (2, 20.0)
    # a geography of its own: the daily lists stay as they are
    from dataclasses import replace

    own = Model(raw, replace(PARAMS, campaign_cities=("C2",), campaign_provinces=("P1",), campaign_excluded_districts=()))
    assert {(r.order_id, r.sn) for r in R.campaign_detail(own).collect()} == {("103", "501")}
    assert own.area.count() == m.area.count() and rows(own.area_campaign, "area_id") == [("3",), ("970",)]


def test_table4_golden_log_edge_cases(spark):
    from rawfixture import ORDER, T

    orders = ORDER + [  # shipped, no log rows at all: no duration, no bucket
        (109, "S109", T(2024, 3, 10, 9), T(2024, 3, 10, 9), None, 2, 10, "u10", 2, 1.0, None, None, 1, 1)]
    log = [
        (T(2024, 3, 8, 9), 15, 100), (T(2024, 3, 9, 9), 15, 100),   # two shipped rows for one order
        (T(2024, 3, 10, 9), 18, 100),
        (T(2024, 3, 10, 9), 18, 101),                               # no ship date: complete - create
        (T(2024, 3, 10, 9), 15, 107),                               # in transit, area outside the cities
    ]
    m = Model(raw_tables(spark, order=orders, order_log=log), PARAMS)
    d = {r.id: r for r in m.delivery_orders.collect() if r.id != "100"}
    assert (d["101"].duration, d["101"].delivery_effect, d["101"].ship_status_simple) == (1, "1天", "refused")
    assert (d["107"].delivery_effect, d["107"].city) == ("在途", None)
    assert d["109"].duration is None and d["109"].delivery_effect is None
    assert sorted(r.duration for r in m.delivery_orders.collect() if r.id == "100") == [1, 2]
    t4 = {(r.city, r.delivery_effect): r for r in R.report_delivery(m).collect()}
    assert len(t4) == (3 + 1) * 5
    one, two = t4[("C1", "1天")], t4[("C1", "2天")]
    assert (one.normal, one.refused, one.returned, one.unified_alloc, one.self_alloc) == (1, 1, 0, 1, 0)
    assert (two.normal, two.unified_alloc) == (1, 1)
    assert t4[("各地汇总", "1天")].refused == 1 and t4[("各地汇总", "在途")].normal == 0


def test_supplements_golden(spark):
    from rawfixture import T

    product = [  # id, sn, name, brand, category, factor, dealer, delivery_method
        (601, 601, "soap", "B", None, 1.0, 2, 1),   # self-delivered by dealer 2: excluded from the map
        (602, 602, "soap", "B", None, 1.0, 1, 0),   # same name, unified
        (603, 603, "rice", "B", None, 1.0, 3, 1),   # self-delivered
        (604, 604, "salt", "B", None, 1.0, 1, 2),   # self-operated
    ]
    dealer = [(1, "D1", "sup1"), (2, "D2", "sup2"), (3, "D3", "sup3")]
    items = [
        (T(2024, 3, 10, 10), 100, 601, 601, 2.0, 1.0, 0.0, False, 10.0),
        (T(2024, 3, 10, 10), 100, 602, 602, 3.0, 1.0, 0.0, False, 10.0),
        (T(2024, 3, 10, 10), 100, 603, 603, 4.0, 0.0, 0.0, False, 5.0),   # sale_factor 0: cases NULL
        (T(2024, 3, 9, 10), 101, 604, 604, 6.0, 2.0, 0.0, False, 8.0),
        (T(2024, 3, 10, 11), 102, 604, 604, 1.0, 1.0, 0.0, False, 1.0),   # status 4: not in the 30-day detail
        (T(2024, 3, 10, 13), 107, 602, 602, 1.0, 1.0, 0.0, False, 2.0),   # area outside the cities
    ]
    contract = [(1, 601, 1), (1, 603, 1), (1, 604, 1), (3, 602, 1), (3, 603, 0)]
    raw = raw_tables(spark, product=product, dealer=dealer, order_item=items, contract_product=contract)
    m = Model(raw, PARAMS)
    top = sorted(((r.city or ""), r.name, r.today_quantity, r.monthly_quantity) for r in R.top_products(m).collect())
    assert top == [("", "soap", 1.0, 1.0), ("C1", "rice", None, None), ("C1", "soap", 5.0, 5.0)]
    month = {(r.city, r.name): r.monthly_quantity for r in R.month_sold(m).collect()}
    assert month[("C1", "salt")] == 3.0 and month[("C1", "rice")] is None
    st = {(r.method, r.city): (r.marketable_sn_no, r.sold_sn_no, r.sales_rate) for r in R.sell_through(m).collect()}
    # sell-through defaults an unmapped sn to unified; the sold flag is global per sn
    assert st == {("统配", "C1"): (2, 1, 0.5), ("自配", "C1"): (1, 1, 1.0), ("统配", "C2"): (1, 1, 1.0)}
    sku = {(r.city, r.method): r["count"] for r in R.sold_sku_count(m).collect()}
    assert sku == {("C1", "自营"): 1, ("C1", "统配"): 1, ("C1", "自配"): 1, (None, "统配"): 1}
    cc = {r.city: tuple(r[1:]) for r in R.channel_counts(m).collect()}
    # orders: self-delivered, unified, self-operated; then buyers in the same order
    assert cc["C1"] == (1, 1, 2, 1, 1, 1) and cc["C2"] == (0, 0, 1, 0, 0, 1) and cc["北京市"] == (0,) * 6
