"""DuckDB SQL for every named query, written independently of the Spark plans.

The SQL re-states the test bindings and the report rules as CTEs over the
pre-registered test views (region nation customer supplier part orders
lineitem events). ``sql(name)`` returns ``WITH <needed ctes> <final>``.

Monetary sums are rounded to 2 decimals on both sides (float addition order
differs between engines); ratios are computed from the rounded sums.
"""

from __future__ import annotations

import datetime as dt
import re

from kpiloom.params import (
    ALL_CITIES_LABEL, CAMPAIGN_SUMMARY_HEADERS, CHANNEL_COUNT_HEADERS,
    CHANNEL_SELF_DELIVERED as SD, CHANNEL_SELF_OPERATED as SO, CHANNEL_UNIFIED as UN, SELL_THROUGH_HEADERS,
    TOP_PRODUCTS_HEADERS, TOTAL_CITY_LABEL,
)
from kpiloom.sources.bindings import early_params, kpi_params, sales_params

KP = kpi_params()
SP = sales_params()
EP = early_params()


def q(v) -> str:
    """SQL literal."""
    if v is None:
        return "NULL"
    if isinstance(v, dt.date):
        return f"DATE '{v.isoformat()}'"
    if isinstance(v, (int, float)):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def qlist(vals) -> str:
    return ", ".join(q(v) for v in vals)


def ts(d: dt.date, end: bool = False) -> str:
    return f"TIMESTAMP '{d.isoformat()} {'23:59:59' if end else '00:00:00'}'"


def in_set(col: str, vals) -> str:
    """Total membership (NULL -> FALSE)."""
    return f"coalesce({col} IN ({qlist(vals)}), FALSE)"


def nd(col: str) -> str:
    """Distinct count with NULL counted as a value."""
    return f"(count(DISTINCT {col}) + coalesce(max(CAST({col} IS NULL AS INTEGER)), 0))"


def ssum(col: str) -> str:
    """Sum that is NULL if any input is NULL, 0 on empty input."""
    return f"(CASE WHEN count(*) = count({col}) THEN coalesce(sum({col}), 0) END)"


def money(expr: str) -> str:
    return f"round({expr}, 2)"


# ---------------------------------------------------------------------------
# CTE library: name -> (sql, deps). ``{O}`` marks the order binding.
# ---------------------------------------------------------------------------
def _area_sql(p, keep_null_district: bool) -> str:
    muni = qlist(p.municipalities)
    extra = "" if keep_null_district else " AND district IS NOT NULL"
    return f"""
  SELECT area_id, province, city, district FROM (
    SELECT area_id, province,
      CASE WHEN length(c0) >= 2 THEN c0 END AS city,
      CASE WHEN length(d0) >= 2 THEN d0 END AS district
    FROM (
      SELECT area_id, p1 AS province,
        CASE WHEN coalesce(p1 IN ({muni}), FALSE) THEN p1 ELSE p2 END AS c0,
        CASE WHEN coalesce(p1 IN ({muni}), FALSE) THEN p2 ELSE p3 END AS d0
      FROM area_parts))
  WHERE {in_set('province', p.provinces)} AND {in_set('city', p.cities)}
    AND NOT {in_set('district', p.excluded_districts)}{extra}"""


def ctes(p, order_flavor: str) -> dict[str, tuple[str, tuple[str, ...]]]:
    ms, rd, ws = p.month_start, p.report_date, p.week_start
    accts = qlist(p.test_accounts)
    c: dict[str, tuple[str, tuple[str, ...]]] = {}
    # ---- raw bindings ----
    c["r_area"] = ("""
  SELECT CAST(cu.c_custkey AS BIGINT) AS id, cu.c_name AS name,
         r.r_name || ',' || n.n_name || ',' || cu.c_mktsegment AS name_path
  FROM customer cu JOIN nation n ON cu.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  UNION ALL
  SELECT CAST(-(n.n_nationkey + 1) AS BIGINT), n.n_name, r.r_name || ',' || n.n_name
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""", ())
    c["r_member"] = ("""
  SELECT c_custkey AS id, c_name AS name, c_name AS username, 'LIC' || CAST(c_custkey AS VARCHAR) AS licence_code,
         c_mktsegment AS shop_name, 'street ' || CAST(c_nationkey AS VARCHAR) AS address, c_custkey AS area,
         CASE WHEN c_custkey % 11 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(c_custkey % 37 AS INTEGER)) END
           AS first_login_date
  FROM customer""", ())
    c["r_login"] = ("""
  SELECT e.user_id AS member, cu.c_name AS username, e.user_id AS area,
         '10.0.0.' || CAST(e.event_id % 256 AS VARCHAR) AS login_ip, e.ts AS login_date
  FROM events e LEFT JOIN customer cu ON e.user_id = cu.c_custkey""", ())
    c["r_app"] = ("""
  SELECT ts AS create_date, user_id AS operator, event_type AS come_from, event_type AS method_name, props AS snap_shot
  FROM events""", ())
    if order_flavor == "events":
        c["r_order"] = ("""
  SELECT e.event_id AS id, 'E' || CAST(e.event_id AS VARCHAR) AS sn, e.ts AS create_date,
         CASE WHEN e.event_id % 7 <> 0 THEN e.ts END AS paid_date, CAST(NULL AS TIMESTAMP) AS returns_date,
         CAST(e.event_id % 4 + 1 AS INTEGER) AS order_status, e.user_id AS member, cu.c_name AS username,
         e.user_id AS area, e.value AS original_amount, CAST(NULL AS VARCHAR) AS payment_method,
         CAST(NULL AS VARCHAR) AS shipping_method, CAST(NULL AS INTEGER) AS shipping_status,
         CAST(e.event_id % 3 AS INTEGER) AS delivery_method
  FROM events e LEFT JOIN customer cu ON e.user_id = cu.c_custkey
  WHERE e.event_type = 'purchase'""", ())
    else:
        c["r_order"] = ("""
  SELECT o.o_orderkey AS id, 'SO' || CAST(o.o_orderkey AS VARCHAR) AS sn, o.o_orderdate AS create_date,
         o.o_orderdate AS paid_date, CAST(NULL AS TIMESTAMP) AS returns_date,
         CAST(CASE o.o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END AS INTEGER) AS order_status,
         o.o_custkey AS member, cu.c_name AS username, o.o_custkey AS area, o.o_totalprice AS original_amount,
         CAST(NULL AS VARCHAR) AS payment_method, CAST(NULL AS VARCHAR) AS shipping_method,
         CAST(CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 1 WHEN '2' THEN 4 WHEN '3' THEN 8
              WHEN '4' THEN 7 WHEN '5' THEN 0 END AS INTEGER) AS shipping_status,
         CAST(o.o_orderkey % 3 AS INTEGER) AS delivery_method
  FROM orders o LEFT JOIN customer cu ON o.o_custkey = cu.c_custkey""", ())
    c["r_item"] = ("""
  SELECT o.o_orderdate AS create_date, l.l_orderkey AS orders, l.l_partkey AS sn, l.l_partkey AS product,
         l.l_quantity AS quantity, CAST(l.l_linenumber AS DOUBLE) AS sale_factor, l.l_quantity AS sale_quantity,
         l.l_returnflag = 'R' AS is_gift, l.l_extendedprice AS sub_total
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""", ())
    c["r_log"] = ("""
  SELECT CASE WHEN type = 15 THEN first_ship ELSE last_ship END AS create_date, type, orders
  FROM (SELECT l_orderkey AS orders, CASE l_linestatus WHEN 'F' THEN 15 ELSE 18 END AS type,
               min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
        FROM lineitem WHERE l_linestatus IN ('F', 'O') GROUP BY 1, 2)""", ())
    c["r_product"] = ("""
  SELECT p_partkey AS id, p_partkey AS sn, p_name AS name, p_brand AS brand,
         p_type || '|' || p_brand || '|' || p_name AS product_category, CAST(p_size AS DOUBLE) AS sale_factor,
         p_partkey % 10 AS dealer, CAST(p_size % 3 AS INTEGER) AS delivery_method
  FROM part""", ())
    c["r_cat"] = ("""
  SELECT DISTINCT * FROM (
    SELECT p_type AS id, '11' AS code, p_type AS name, ',' AS tree_path FROM part
    UNION ALL SELECT p_type || '|' || p_brand, '2222', p_brand, ',' || p_type || ',' FROM part
    UNION ALL SELECT p_type || '|' || p_brand || '|' || p_name, '333333', p_name,
                     ',' || p_type || ',' || p_type || '|' || p_brand || ',' FROM part)""", ())
    c["r_dealer"] = ("SELECT s_suppkey AS id, 'D' || CAST(s_suppkey AS VARCHAR) AS sn, s_name AS name FROM supplier",
                     ())
    c["r_contract"] = ("""
  SELECT DISTINCT CAST(-(s.s_nationkey + 1) AS BIGINT) AS area, l.l_partkey AS product,
         CASE WHEN l.l_linestatus = 'O' THEN 1 ELSE 0 END AS is_marketable
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey""", ())
    c["r_campaign"] = (f"SELECT CAST(p_partkey AS VARCHAR) AS sn FROM part WHERE p_brand = 'Brand#1'", ())
    # ---- logical ----
    c["area_parts"] = ("""
  SELECT CAST(id AS VARCHAR) AS area_id,
         coalesce(string_split(name_path, ',')[1], '') AS p1,
         coalesce(string_split(name_path, ',')[2], '') AS p2,
         coalesce(array_to_string(string_split(name_path, ',')[3:], ','), '') AS p3
  FROM r_area""", ("r_area",))
    c["area_k"] = (_area_sql(p, True), ("area_parts",))
    c["area_m"] = (_area_sql(p.for_campaign(), False), ("area_parts",))
    c["orders_scan"] = (f"""
  SELECT CAST(id AS VARCHAR) AS id, sn, create_date AS create_ts, CAST(create_date AS DATE) AS create_date,
         CAST(paid_date AS DATE) AS paid_date, CAST(returns_date AS DATE) AS returns_date, order_status,
         CAST(member AS VARCHAR) AS member_id, username, CAST(area AS VARCHAR) AS area_id, original_amount,
         payment_method, shipping_method, shipping_status, delivery_method
  FROM r_order WHERE username NOT IN ({accts})""", ("r_order",))
    c["orders_clean"] = (f"""
  SELECT * EXCLUDE (sn, create_ts) FROM orders_scan
  WHERE NOT (area_id IN ({qlist(p.x_area_ids)}) AND regexp_matches(username, {q(p.x_user_pattern)}))
    AND NOT {in_set('area_id', p.dropped_area_ids)}""", ("orders_scan",))
    c["items_scan"] = (f"""
  SELECT CAST(create_date AS DATE) AS create_date, CAST(orders AS VARCHAR) AS order_id, CAST(sn AS VARCHAR) AS sn,
         CAST(product AS VARCHAR) AS product_id, quantity, sale_factor,
         quantity / nullif(sale_factor, 0) AS sale_quantity,
         CASE WHEN is_gift THEN 1 WHEN NOT is_gift THEN 0 END AS is_gift, sub_total
  FROM r_item WHERE create_date > {ts(ms)} AND create_date <= {ts(rd, True)}""", ("r_item",))
    c["items_clean"] = ("""
  SELECT create_date, order_id, sn, product_id, sale_quantity, is_gift, sub_total FROM items_scan
  WHERE order_id IN (SELECT id FROM orders_clean) AND is_gift = 0""", ("items_scan", "orders_clean"))
    c["order_log"] = (f"""
  SELECT CAST(create_date AS DATE) AS create_date, type, CAST(orders AS VARCHAR) AS order_id FROM r_log
  WHERE create_date > {ts(ms)} AND create_date <= {ts(rd, True)}
    AND CAST(orders AS VARCHAR) IN (SELECT id FROM orders_clean)""", ("r_log", "orders_clean"))
    c["members_all"] = (f"""
  SELECT CAST(id AS VARCHAR) AS member_id, name, username, licence_code, shop_name, address,
         CAST(area AS VARCHAR) AS area_id, CAST(first_login_date AS DATE) AS first_login_date
  FROM r_member WHERE username NOT IN ({accts})""", ("r_member",))
    c["members"] = ("SELECT * FROM members_all WHERE area_id IN (SELECT area_id FROM area_k)",
                    ("members_all", "area_k"))
    pre = p.app_success_prefix
    c["app"] = (f"""
  SELECT CAST(create_date AS DATE) AS login_date, CAST(operator AS VARCHAR) AS member_id, come_from AS platform_type
  FROM r_app WHERE method_name = {q(p.app_login_method)} AND substr(snap_shot, 1, {len(pre)}) = {q(pre)}""",
                ("r_app",))
    c["logins"] = (f"""
  SELECT CAST(member AS VARCHAR) AS member_id, username, CAST(area AS VARCHAR) AS area_id, login_ip,
         CAST(login_date AS DATE) AS login_date, CAST(NULL AS DATE) AS first_login_date
  FROM r_login
  WHERE login_date > {ts(ms)} AND login_date <= {ts(rd, True)} AND username NOT IN ({accts})
    AND CAST(area AS VARCHAR) IN (SELECT area_id FROM area_k)""", ("r_login", "area_k"))
    c["products"] = ("""
  SELECT CAST(id AS VARCHAR) AS product_id, CAST(sn AS VARCHAR) AS sn, name, brand, product_category AS cate_id,
         sale_factor, CAST(dealer AS VARCHAR) AS dealer_id, delivery_method FROM r_product""", ("r_product",))
    c["cats"] = ("SELECT id AS cate_id, code, name, tree_path FROM r_cat", ("r_cat",))
    c["prod_cate"] = ("""
  SELECT cate_id, c1 AS cate1, CASE WHEN c1 <> c2 THEN c2 END AS cate2, c3 AS cate3 FROM (
    SELECT cate_id, c1, c2, CASE WHEN c2 <> c3a THEN c3a END AS c3 FROM (
      SELECT cate_id, c1, c2, CASE WHEN c1 <> name THEN name END AS c3a FROM (
        SELECT x.cate_id, x.name, coalesce(a.name, x.name) AS c1, coalesce(b.name, x.name) AS c2
        FROM cats x
        LEFT JOIN (SELECT cate_id, name FROM cats WHERE length(code) = 2) a
          ON coalesce(string_split(x.tree_path, ',')[2], '') = a.cate_id
        LEFT JOIN (SELECT cate_id, name FROM cats WHERE length(code) = 4) b
          ON coalesce(array_to_string(string_split(x.tree_path, ',')[3:3], ','), '') = b.cate_id)))""",
                     ("cats",))
    c["dealers"] = ("SELECT CAST(id AS VARCHAR) AS dealer_id, sn, name AS supplier FROM r_dealer", ("r_dealer",))
    c["channel"] = (f"""
  SELECT pr.sn, d.supplier, {q(UN)} AS method FROM products pr LEFT JOIN dealers d ON pr.dealer_id = d.dealer_id
  WHERE pr.delivery_method = 0
  UNION ALL
  SELECT pr.sn, d.supplier, {q(SD)} AS method FROM products pr LEFT JOIN dealers d ON pr.dealer_id = d.dealer_id
  WHERE pr.delivery_method = 1 AND pr.dealer_id NOT IN ({qlist(p.excluded_dealers)})""",
                    ("products", "dealers"))
    c["contract"] = ("""
  SELECT CAST(area AS VARCHAR) AS area_id, CAST(product AS VARCHAR) AS product_id FROM r_contract
  WHERE is_marketable = 1""", ("r_contract",))
    xd = "" if p.x_district is None else \
        f" WHERE NOT (district = {q(p.x_district)} AND regexp_matches(username, {q(p.x_user_pattern)}))"
    c["orders_window"] = (f"""
  SELECT * FROM (
    SELECT o.id, o.member_id, o.create_date, o.username, o.area_id, o.returns_date, o.original_amount, o.order_status,
           a.province, a.city, a.district
    FROM orders_clean o LEFT JOIN area_k a ON o.area_id = a.area_id
    WHERE o.create_date > {q(ws)} AND o.create_date <= {q(rd)} AND o.order_status IN (1, 2, 4)){xd}""",
                          ("orders_clean", "area_k"))
    c["logins_window"] = (f"""
  SELECT * FROM (
    SELECT l.member_id, l.username, l.area_id, l.login_ip, l.login_date, a.province, a.city, a.district
    FROM logins l LEFT JOIN area_k a ON l.area_id = a.area_id
    WHERE l.login_date > {q(ws)} AND l.login_date <= {q(rd)}){xd}""", ("logins", "area_k"))
    c["sales_detail"] = (f"""
  SELECT i.order_id, i.sn, i.sale_quantity, i.sub_total, i.is_gift, pr.cate_id, pc.cate1, pc.cate2, pc.cate3,
         coalesce(ch.supplier, {q(SO)}) AS supplier, coalesce(ch.method, {q(SO)}) AS method,
         ow.create_date, ow.username, ow.area_id, ow.original_amount, ow.order_status, ow.province, ow.city,
         ow.district
  FROM items_clean i
  LEFT JOIN (SELECT sn, cate_id FROM products) pr ON i.sn = pr.sn
  LEFT JOIN prod_cate pc ON pr.cate_id = pc.cate_id
  LEFT JOIN channel ch ON i.sn = ch.sn
  LEFT JOIN orders_window ow ON i.order_id = ow.id
  WHERE i.create_date > {q(ws)} AND i.create_date <= {q(rd)} AND i.is_gift <> 1""",
                         ("items_clean", "products", "prod_cate", "channel", "orders_window"))
    th, lab = p.delivery_thresholds, p.delivery_labels
    c["delivery_orders"] = (f"""
  SELECT d.*, a.province, a.city, a.district FROM (
    SELECT x.*,
      CASE WHEN complete_date IS NULL AND shipping_date IS NOT NULL THEN {q(p.in_transit_label)}
           WHEN duration <= {th[0]} THEN {q(lab[0])} WHEN duration <= {th[1]} THEN {q(lab[1])}
           WHEN duration <= {th[2]} THEN {q(lab[2])} WHEN duration > {th[2]} THEN {q(lab[3])} END AS delivery_effect,
      CASE WHEN coalesce(shipping_status IN (4, 7), FALSE) THEN 'returned' WHEN shipping_status = 8 THEN 'refused'
           WHEN shipping_status <> 8 THEN 'normal' END AS ship_status_simple
    FROM (
      SELECT o.id, o.create_date, o.username, o.order_status, o.shipping_status, o.area_id, o.delivery_method,
             s.create_date AS shipping_date, c.create_date AS complete_date,
             CAST(CASE WHEN s.create_date IS NULL AND c.create_date IS NOT NULL
                  THEN datediff('day', o.create_date, c.create_date)
                  ELSE datediff('day', s.create_date, c.create_date) END AS INTEGER) AS duration
      FROM orders_clean o
      LEFT JOIN (SELECT order_id, create_date FROM order_log WHERE type = 15) s ON o.id = s.order_id
      LEFT JOIN (SELECT order_id, create_date FROM order_log WHERE type = 18) c ON o.id = c.order_id
      WHERE o.create_date > {q(ws)} AND o.create_date <= {q(rd)} AND o.order_status IN (1, 2)
        AND o.shipping_status <> 0 AND o.shipping_status <> 6) x) d
  LEFT JOIN area_k a ON d.area_id = a.area_id""", ("orders_clean", "order_log", "area_k"))
    c["items_month"] = (f"""
  SELECT i.create_date, i.sn, i.sale_quantity AS quantity, i.sub_total, i.order_id, pr.name, o.username,
         coalesce(ch.method, {q(SO)}) AS method, a.city, a.district
  FROM items_clean i
  LEFT JOIN (SELECT sn, name FROM products) pr ON i.sn = pr.sn
  LEFT JOIN orders_clean o ON i.order_id = o.id
  LEFT JOIN (SELECT sn, method FROM channel) ch ON i.sn = ch.sn
  LEFT JOIN area_k a ON o.area_id = a.area_id
  WHERE i.create_date > {q(ms)} AND i.create_date <= {q(rd)} AND o.order_status IN (1, 2)""",
                        ("items_clean", "products", "orders_clean", "channel", "area_k"))
    c["items_today"] = (f"SELECT * FROM items_month WHERE create_date = {q(rd)}", ("items_month",))
    c["month_sold"] = (f"SELECT city, name, round({ssum('quantity')}, 6) AS monthly_quantity FROM items_month GROUP BY 1, 2",
                       ("items_month",))
    # campaign report
    if p.campaign_start is not None:
        cs, ce = p.campaign_start, p.campaign_end
        c["camp_orders"] = (f"""
  SELECT id, sn AS order_sn, create_date, username, member_id, area_id, original_amount, order_status
  FROM orders_scan WHERE create_ts >= {ts(cs)} AND create_ts <= {ts(ce, True)}
    AND area_id IN (SELECT area_id FROM area_m)""", ("orders_scan", "area_m"))
        c["camp_items"] = (f"""
  SELECT CAST(create_date AS DATE) AS create_date, CAST(orders AS VARCHAR) AS order_id, CAST(sn AS VARCHAR) AS sn,
         sale_quantity, CASE WHEN is_gift THEN 1 WHEN NOT is_gift THEN 0 END AS is_gift, sub_total
  FROM r_item WHERE create_date >= {ts(cs)} AND create_date <= {ts(ce, True)}
    AND CAST(orders AS VARCHAR) IN (SELECT id FROM camp_orders)""", ("r_item", "camp_orders"))
        c["camp_members"] = ("""
  SELECT m.member_id, m.name, m.shop_name, m.address FROM members_all m
  JOIN r_member r ON m.member_id = CAST(r.id AS VARCHAR)
  WHERE r.first_login_date IS NOT NULL AND m.area_id IN (SELECT area_id FROM area_m)""",
                             ("members_all", "r_member", "area_m"))
        c["camp_sales"] = (f"""
  SELECT i.order_id, i.sn, i.sale_quantity, i.sub_total, pr.name AS name_x, pc.cate1, pc.cate2, pc.cate3,
         coalesce(ch.supplier, {q(SO)}) AS supplier, coalesce(ch.method, {q(SO)}) AS method,
         CASE WHEN i.sn IN (SELECT sn FROM r_campaign) THEN 1 ELSE 0 END AS campaign_prod,
         o.order_sn, o.create_date, o.username, o.original_amount, o.order_status, o.province, o.city, o.district,
         o.name_y, o.shop_name, o.address
  FROM camp_items i
  LEFT JOIN (SELECT sn, cate_id, name FROM products) pr ON i.sn = pr.sn
  LEFT JOIN prod_cate pc ON pr.cate_id = pc.cate_id
  LEFT JOIN channel ch ON i.sn = ch.sn
  LEFT JOIN (
    SELECT co.id, co.order_sn, co.create_date, co.username, co.original_amount, co.order_status,
           a.province, a.city, a.district, cm.name AS name_y, cm.shop_name, cm.address
    FROM camp_orders co LEFT JOIN area_m a ON co.area_id = a.area_id
    LEFT JOIN camp_members cm ON co.member_id = cm.member_id
    WHERE co.order_status IN (1, 2, 4)) o ON i.order_id = o.id
  WHERE i.is_gift <> 1""", ("camp_items", "products", "prod_cate", "channel", "r_campaign", "camp_orders",
                            "area_m", "camp_members"))
    return c


def _resolve(lib, names) -> list[str]:
    seen: list[str] = []

    def visit(n):
        if n in seen:
            return
        for d in lib[n][1]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def build(p, flavor: str, final: str) -> str:
    """Prefix ``final`` with the library CTEs it references (transitively).
    ``final`` may start with its own ``WITH``; its CTEs are appended."""
    lib = ctes(p, flavor)
    used = [n for n in lib if re.search(rf"\b{n}\b", final)]
    order = _resolve(lib, used)
    if not order:
        return final
    body = ",\n".join(f"{n} AS ({lib[n][0]}\n)" for n in order)
    f = final.lstrip()
    if f[:5].upper() == "WITH ":
        return f"WITH {body},\n{f[5:]}"
    return f"WITH {body}\n{final}"


def K(final: str) -> str:
    return build(KP, "events", final)


def E(final: str) -> str:
    return build(EP, "events", final)


def S(final: str) -> str:
    return build(SP, "orders", final)


# ---------------------------------------------------------------------------
# Final queries
# ---------------------------------------------------------------------------
def _grid_dates(p) -> str:
    return f"SELECT CAST(d AS DATE) AS date FROM range({q(p.week_start + dt.timedelta(days=1))}, " \
           f"{q(p.report_date + dt.timedelta(days=1))}, INTERVAL 1 DAY) t(d)"


def _values(name: str, vals) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join(f"({q(v)})" for v in vals) + f") v({name}))"


def _cities(p) -> str:
    return _values("city", p.cities)


def _dense_daily(p, facts: str, date_col: str, value: str, name: str) -> str:
    return f"""
SELECT g.city, g.date, coalesce(a.v, 0) AS {name}
FROM (SELECT c.city, d.date FROM {_cities(p)} c CROSS JOIN ({_grid_dates(p)}) d) g
LEFT JOIN (SELECT city, {date_col} AS date, {value} AS v FROM {facts}
           WHERE {in_set('city', p.cities)} GROUP BY 1, 2) a ON g.city = a.city AND g.date = a.date"""


def _levels(src: str, aggs: str) -> str:
    """Total (always one row), city and (city, district) levels."""
    return f"""
SELECT 0 AS level, CAST(NULL AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS district, {aggs} FROM {src}
UNION ALL SELECT 1 AS level, city, CAST(NULL AS VARCHAR) AS district, {aggs} FROM {src} GROUP BY city
UNION ALL SELECT 2 AS level, city, district, {aggs} FROM {src} GROUP BY city, district"""


def _repeat(src: str, day: str, cnt: str, rep: str, rate: str) -> str:
    body = f"count(*) AS {cnt}, count(*) FILTER (WHERE n_days >= 2) AS {rep}"
    return f"""
SELECT level, city, district, {cnt}, {rep}, {rep} / {cnt} AS {rate} FROM (
  SELECT 0 AS level, CAST(NULL AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS district, {body}
  FROM (SELECT username, count(DISTINCT {day}) AS n_days FROM {src} GROUP BY username) GROUP BY ALL
  UNION ALL
  SELECT 1, city, CAST(NULL AS VARCHAR), {body}
  FROM (SELECT city, username, count(DISTINCT {day}) AS n_days FROM {src} GROUP BY city, username) GROUP BY city
  UNION ALL
  SELECT 2, city, district, {body}
  FROM (SELECT city, district, username, count(DISTINCT {day}) AS n_days FROM {src}
        GROUP BY city, district, username) GROUP BY city, district)"""


def _visits(p) -> str:
    return _levels(f"(SELECT * FROM logins_window WHERE login_date = {q(p.report_date)})",
                   f"count(*) AS total_visitors, {nd('member_id')} AS unique_visitors")


def _orders_day(p) -> str:
    inner = _levels(f"(SELECT * FROM orders_window WHERE create_date = {q(p.report_date)})",
                    f"{nd('username')} AS people_count, count(*) AS total_quant, "
                    f"{money(ssum('original_amount'))} AS total_amount")
    return f"SELECT *, total_amount / total_quant AS daily_pct FROM ({inner})"


def _orders_week(p) -> str:
    inner = _levels("orders_window", f"{money(ssum('original_amount'))} AS wkly_total_amount, count(*) AS n")
    return f"""SELECT level, city, district, wkly_total_amount, wkly_total_amount / n AS wkly_pct,
       n / {float(p.week_days)} AS wkly_avg_quant FROM ({inner})"""


def _dup_visit() -> str:
    return _repeat("logins_window", "login_date", "login_count", "dup_login_count", "dup_login_rate")


def _dup_order() -> str:
    return _repeat("orders_window", "create_date", "order_count", "dup_order_count", "dup_order_rate")


def _table2(p) -> str:
    j = "v.level = {a}.level AND v.city IS NOT DISTINCT FROM {a}.city AND v.district IS NOT DISTINCT FROM {a}.district"
    return f"""
SELECT v.level,
  coalesce(v.city, {q(TOTAL_CITY_LABEL)}) AS city,
  CASE WHEN v.city IS NULL AND v.district IS NULL THEN {q(ALL_CITIES_LABEL)} ELSE coalesce(v.district, v.city) END
    AS district,
  coalesce(v.total_visitors, 0) AS total_visitors, coalesce(v.unique_visitors, 0) AS unique_visitors,
  coalesce(od.people_count, 0) AS people_count, coalesce(od.total_quant, 0) AS total_quant,
  coalesce(od.total_amount, 0) AS total_amount,
  coalesce(od.people_count, 0) / nullif(coalesce(v.unique_visitors, 0), 0) AS conv_rate,
  coalesce(dv.login_count, 0) AS login_count, coalesce(dv.dup_login_count, 0) AS dup_login_count,
  dv.dup_login_rate, coalesce(dor.order_count, 0) AS order_count, coalesce(dor.dup_order_count, 0) AS dup_order_count,
  dor.dup_order_rate, coalesce(od.daily_pct, 0) AS daily_pct, coalesce(ow.wkly_pct, 0) AS wkly_pct,
  coalesce(ow.wkly_avg_quant, 0) AS wkly_avg_quant
FROM ({_visits(p)}) v
LEFT JOIN ({_orders_day(p)}) od ON {j.format(a='od')}
LEFT JOIN ({_orders_week(p)}) ow ON {j.format(a='ow')}
LEFT JOIN ({_dup_visit()}) dv ON {j.format(a='dv')}
LEFT JOIN ({_dup_order()}) dor ON {j.format(a='dor')}"""


def _login_cohort(p) -> str:
    return f"""
SELECT city, first_login_date AS date, count(*) AS count FROM (
  SELECT a.city, u.member_id, min(u.first_login_date) AS first_login_date
  FROM (SELECT ap.member_id, ap.first_login_date, m.area_id
        FROM (SELECT member_id, min(login_date) AS first_login_date FROM app GROUP BY member_id) ap
        LEFT JOIN members m ON ap.member_id = m.member_id
        UNION ALL SELECT member_id, first_login_date, area_id FROM members) u
  LEFT JOIN area_k a ON u.area_id = a.area_id
  WHERE a.city IS NOT NULL GROUP BY a.city, u.member_id)
GROUP BY city, first_login_date
HAVING first_login_date > {q(p.week_start)} AND first_login_date <= {q(p.report_date)}"""


def _buyer_cohort(p) -> str:
    return f"""
SELECT city, first_paid AS date, count(*) AS count FROM (
  SELECT a.city, o.username, arg_min_null(o.paid_date, (o.create_date, CAST(o.id AS HUGEINT))) AS first_paid
  FROM orders_clean o LEFT JOIN area_k a ON o.area_id = a.area_id
  WHERE o.order_status IN (1, 2) AND a.city IS NOT NULL GROUP BY a.city, o.username)
GROUP BY city, first_paid
HAVING first_paid > {q(p.week_start)} AND first_paid <= {q(p.report_date)}"""


def _table1(p) -> str:
    return f"""
WITH t1_city AS (
  SELECT g.city, g.date, coalesce(l.count, 0) AS cnt_login, coalesce(b.count, 0) AS cnt_order
  FROM (SELECT c.city, d.date FROM {_cities(p)} c CROSS JOIN ({_grid_dates(p)}) d) g
  LEFT JOIN ({_login_cohort(p)}) l ON g.city = l.city AND g.date = l.date
  LEFT JOIN ({_buyer_cohort(p)}) b ON g.city = b.city AND g.date = b.date),
t1_all AS (
  SELECT city, date, cnt_login, cnt_order FROM t1_city
  UNION
  SELECT {q(ALL_CITIES_LABEL)}, date, sum(cnt_login), sum(cnt_order) FROM t1_city GROUP BY date)
SELECT city, date, CAST(cnt_login AS BIGINT) AS cnt_login, CAST(cnt_order AS BIGINT) AS cnt_order,
  CASE WHEN cnt_login = max(cnt_login) OVER w THEN CAST(cnt_login AS BIGINT) END AS login_max,
  CASE WHEN cnt_login = min(cnt_login) OVER w THEN CAST(cnt_login AS BIGINT) END AS login_min,
  CASE WHEN cnt_order = max(cnt_order) OVER w THEN CAST(cnt_order AS BIGINT) END AS order_max,
  CASE WHEN cnt_order = min(cnt_order) OVER w THEN CAST(cnt_order AS BIGINT) END AS order_min,
  avg(cnt_login) OVER w AS login_avg, avg(cnt_order) OVER w AS order_avg
FROM t1_all WINDOW w AS (PARTITION BY city)"""


def _wide(p, facts_filter: str, key: str, values: dict, value: str = "amount") -> str:
    """city x date grid with one column per value of ``key`` (NULL when no row)."""
    cols = ", ".join(f"max(CASE WHEN {key} = {q(v)} THEN {value} END) AS {name}" for v, name in values.items())
    return f"""
SELECT g.city, g.date, {', '.join('w.' + n for n in values.values())}
FROM (SELECT c.city, d.date FROM {_cities(p)} c CROSS JOIN ({_grid_dates(p)}) d) g
LEFT JOIN (
  SELECT city, date, {cols} FROM (
    SELECT city, create_date AS date, {key}, {money(ssum('sub_total'))} AS amount FROM sales_detail
    WHERE {in_set('city', p.cities)} {facts_filter} AND {key} IN ({qlist(values)}) GROUP BY 1, 2, 3)
  GROUP BY 1, 2) w ON g.city = w.city AND g.date = w.date"""


CHANNEL_NAMES = {UN: "unified_alloc", SD: "self_alloc", SO: "self_supp"}


def _channel_daily(p) -> str:
    return _wide(p, "", "method", CHANNEL_NAMES)


def _cat_daily(p, self_op: bool) -> str:
    suf = "ss" if self_op else "pf"
    flt = f"AND method = {q(SO)}" if self_op else f"AND method <> {q(SO)}"
    return _wide(p, flt, "cate1", {c: f"{s}_{suf}" for c, s in p.category_columns.items()})


def _table3(p) -> str:
    stems = list(p.category_columns.values())
    cat = [f"{s}_ss" for s in stems] + [f"{s}_pf" for s in stems]
    ch = ["unified_alloc", "self_alloc", "self_supp"]
    fill = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ch + cat)
    allc = ["total_amount"] + ch + cat
    sums = ", ".join(f"round(sum({c}), 2) AS {c}" for c in allc)
    return f"""
WITH t3_city AS (
  SELECT city, date, round(unified_alloc + self_alloc + self_supp, 2) AS total_amount, * EXCLUDE (city, date) FROM (
    SELECT cd.city, cd.date, {fill} FROM ({_channel_daily(p)}) cd
    JOIN ({_cat_daily(p, True)}) s ON cd.city = s.city AND cd.date = s.date
    JOIN ({_cat_daily(p, False)}) f ON cd.city = f.city AND cd.date = f.date))
SELECT {q(ALL_CITIES_LABEL)} AS city, date, {sums} FROM t3_city GROUP BY date
UNION ALL SELECT city, date, {', '.join(allc)} FROM t3_city"""


def _effects(p):
    return list(p.delivery_labels) + [p.in_transit_label]


def _delivery_wide(p, src: str, key: str, values) -> str:
    cols = ", ".join(f"CAST(count(*) FILTER (WHERE {key} = {q(v)}) AS BIGINT) AS {v}" for v in values)
    return f"""
SELECT g.city, g.delivery_effect, {', '.join(f'coalesce(w.{v}, 0) AS {v}' for v in values)}
FROM (SELECT c.city, e.delivery_effect FROM {_cities(p)} c CROSS JOIN {_values('delivery_effect', _effects(p))} e) g
LEFT JOIN (SELECT city, delivery_effect, {cols} FROM {src}
           WHERE {in_set('city', p.cities)} AND {key} IN ({qlist(values)})
           GROUP BY 1, 2) w ON g.city = w.city AND g.delivery_effect = w.delivery_effect"""


def _by_status(p) -> str:
    return _delivery_wide(p, "delivery_orders", "ship_status_simple", ["returned", "refused", "normal"])


def _by_channel(p) -> str:
    src = """(SELECT *, CASE WHEN delivery_method = 0 THEN 'unified_alloc' WHEN delivery_method = 1 THEN 'self_alloc'
                  WHEN delivery_method NOT IN (0, 1) THEN 'self_supp' END AS method
              FROM delivery_orders WHERE ship_status_simple = 'normal')"""
    return _delivery_wide(p, src, "method", ["unified_alloc", "self_alloc", "self_supp"])


def _table4(p) -> str:
    cols = ["normal", "refused", "returned", "self_alloc", "unified_alloc", "self_supp"]
    return f"""
WITH t4_city AS (
  SELECT s.city, s.delivery_effect, s.normal, s.refused, s.returned, c.self_alloc, c.unified_alloc, c.self_supp
  FROM ({_by_status(p)}) s LEFT JOIN ({_by_channel(p)}) c
    ON s.city = c.city AND s.delivery_effect = c.delivery_effect)
SELECT {q(ALL_CITIES_LABEL)} AS city, delivery_effect, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in cols)}
FROM t4_city GROUP BY delivery_effect
UNION ALL SELECT * FROM t4_city"""


def _top(p, localized: bool = False) -> str:
    h = TOP_PRODUCTS_HEADERS
    names = [f'"{x}"' for x in h] if localized else ["city", "name", "today_quantity", "monthly_quantity"]
    return f"""
SELECT r.city AS {names[0]}, r.name AS {names[1]}, r.today_quantity AS {names[2]},
       ms.monthly_quantity AS {names[3]}
FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY today_quantity DESC NULLS LAST, name ASC NULLS LAST) AS rn
      FROM (SELECT city, name, round({ssum('quantity')}, 6) AS today_quantity FROM items_today GROUP BY 1, 2)) r
LEFT JOIN month_sold ms ON r.city IS NOT DISTINCT FROM ms.city AND r.name IS NOT DISTINCT FROM ms.name
WHERE r.rn <= {p.top_n}"""


def _channel_distinct(p, col: str, heads) -> str:
    # heads: names for (self-delivered, unified, self-operated)
    vals = {SD: heads[0], UN: heads[1], SO: heads[2]}
    cols = ", ".join(f"max(CASE WHEN method = {q(v)} THEN n END) AS x{i}" for i, v in enumerate(vals))
    out = ", ".join(f'coalesce(w.x{i}, 0) AS "{h}"' for i, h in enumerate(vals.values()))
    return f"""
SELECT c.city, {out} FROM {_cities(p)} c
LEFT JOIN (SELECT city, {cols} FROM (
             SELECT city, method, {nd(col)} AS n FROM sales_detail WHERE {in_set('city', p.cities)} GROUP BY 1, 2)
           GROUP BY city) w ON c.city = w.city"""


def _sell_through(p, localized: bool = False) -> str:
    h = [f'"{x}"' for x in SELL_THROUGH_HEADERS] if localized else \
        ["method", "city", "marketable_sn_no", "sold_sn_no", "sales_rate"]
    return f"""
SELECT method AS {h[0]}, city AS {h[1]}, count(*) AS {h[2]}, CAST(sum(sold) AS BIGINT) AS {h[3]},
       sum(sold) / count(*) AS {h[4]}
FROM (SELECT a.city, coalesce(ch.method, {q(UN)}) AS method, pr.sn,
             max(CASE WHEN pr.sn IN (SELECT sn FROM items_today WHERE sn IS NOT NULL) THEN 1 ELSE 0 END) AS sold
      FROM contract cp LEFT JOIN (SELECT product_id, sn FROM products) pr ON cp.product_id = pr.product_id
      LEFT JOIN area_k a ON cp.area_id = a.area_id
      LEFT JOIN (SELECT sn, method FROM channel) ch ON pr.sn = ch.sn
      GROUP BY 1, 2, 3)
GROUP BY method, city"""


CAMP_COLS = ["order_id", "order_sn", "sn", "sale_quantity", "sub_total", "name_x", "cate1", "cate2", "cate3",
             "create_date", "username", "original_amount", "order_status", "province", "city", "district", "name_y",
             "shop_name", "address"]


def oracle_queries() -> dict[str, str]:
    kp, sp = KP, SP
    o: dict[str, str] = {}
    # sources
    o["scan_project"] = S("SELECT * FROM products")
    o["scan_full"] = S("SELECT CAST(id AS VARCHAR) AS id, name, name_path FROM r_area")
    o["lookup_exclusion"] = S("SELECT * FROM orders_clean")
    o["scan_range_open"] = S("SELECT * FROM items_scan")
    o["scan_range_closed"] = S(f"""
SELECT CAST(create_date AS DATE) AS create_date, CAST(orders AS VARCHAR) AS order_id, CAST(sn AS VARCHAR) AS sn,
       CAST(product AS VARCHAR) AS product_id, quantity, sale_factor, sale_quantity,
       CASE WHEN is_gift THEN 1 WHEN NOT is_gift THEN 0 END AS is_gift, sub_total
FROM r_item WHERE create_date >= {ts(sp.campaign_start)} AND create_date <= {ts(sp.campaign_end, True)}""")
    o["exclude_accounts"] = S("SELECT * FROM members_all")
    o["semi_area"] = S("SELECT * FROM members")
    o["semi_orders"] = S("SELECT * FROM items_clean")
    o["scan_equality"] = S("SELECT * FROM contract")
    o["json_prefix"] = K("SELECT * FROM app")
    o["cast_ids"] = S("SELECT * FROM dealers")
    o["flag_decode"] = S("SELECT CASE WHEN is_gift THEN 1 WHEN NOT is_gift THEN 0 END AS is_gift, count(*) AS n "
                         "FROM r_item GROUP BY 1")
    o["date_trunc_day"] = K("SELECT CAST(create_date AS DATE) AS day, count(*) AS n FROM r_app GROUP BY 1")
    o["cases_sold"] = S("SELECT order_id, sn, sale_quantity FROM items_clean")
    # projections
    o["drop_cols"] = S("SELECT * EXCLUDE (payment_method, shipping_method, returns_date) FROM orders_clean")
    o["rename_cols"] = S("SELECT create_date AS log_date, type AS log_type, order_id FROM order_log")
    o["localized_headers"] = S(_top(sp, localized=True))
    o["category_tree"] = S("SELECT * FROM prod_cate")
    o["channel_map"] = S("SELECT * FROM channel")
    o["join_suffix"] = S("""
SELECT p.sn AS sn_x, p.dealer_id, p.name, d.sn AS sn_y, d.supplier
FROM (SELECT sn, dealer_id, name FROM products WHERE delivery_method = 1) p LEFT JOIN dealers d
  ON p.dealer_id = d.dealer_id""")
    # filters
    o["filter_and"] = S("SELECT id, create_date, order_status, shipping_status FROM orders_clean "
                        "WHERE order_status = 1 AND shipping_status <> 0")
    o["window_filter"] = S(f"SELECT id, create_date, area_id FROM orders_clean "
                           f"WHERE create_date > {q(sp.week_start)} AND create_date <= {q(sp.report_date)}")
    o["member_in"] = S("SELECT id, order_status FROM orders_clean WHERE coalesce(order_status IN (1, 2, 4), FALSE)")
    muni = qlist(sp.municipalities)
    levels_sql = f"""
SELECT area_id, province, CASE WHEN length(c0) >= 2 THEN c0 END AS city,
       CASE WHEN length(d0) >= 2 THEN d0 END AS district
FROM (SELECT area_id, p1 AS province,
        CASE WHEN coalesce(p1 IN ({muni}), FALSE) THEN p1 ELSE p2 END AS c0,
        CASE WHEN coalesce(p1 IN ({muni}), FALSE) THEN p2 ELSE p3 END AS d0 FROM area_parts)"""
    o["member_not_in"] = S(f"SELECT * FROM ({levels_sql}) WHERE NOT {in_set('district', sp.excluded_districts)}")
    o["path_split"] = S(levels_sql)
    o["compound_not"] = S(f"""
SELECT id, username, area_id FROM orders_scan
WHERE NOT (area_id IN ({qlist(sp.x_area_ids)}) AND regexp_matches(username, {q(sp.x_user_pattern)}))""")
    o["null_filter"] = S("SELECT city, district FROM area_k WHERE district IS NOT NULL")
    o["tree_levels"] = S("SELECT cate_id, name, CASE WHEN length(code) = 2 THEN 1 ELSE 2 END AS tree_level "
                         "FROM cats WHERE length(code) IN (2, 4)")
    # joins
    o["left_join_dim"] = K("SELECT l.area_id, l.member_id, l.login_date, a.province, a.city, a.district "
                           "FROM logins l LEFT JOIN area_k a ON l.area_id = a.area_id")
    o["left_join_renamed"] = S("SELECT i.order_id, i.sn, i.sub_total, o.order_status, o.create_date "
                               "FROM items_clean i LEFT JOIN orders_clean o ON i.order_id = o.id")
    o["left_join_multi"] = S(f"""
SELECT s.city, s.delivery_effect, s.returned, s.refused, s.normal, c.unified_alloc, c.self_alloc, c.self_supp
FROM ({_by_status(sp)}) s LEFT JOIN ({_by_channel(sp)}) c ON s.city = c.city AND s.delivery_effect = c.delivery_effect""")
    o["densify_grid"] = S(f"""
SELECT g.city, g.date, g.method, coalesce(a.amount, 0.0) AS amount
FROM (SELECT c.city, d.date, m.method FROM {_cities(sp)} c CROSS JOIN ({_grid_dates(sp)}) d
      CROSS JOIN {_values('method', (UN, SD, SO))} m) g
LEFT JOIN (SELECT city, create_date AS date, method, {money(ssum('sub_total'))} AS amount FROM sales_detail
           WHERE {in_set('city', sp.cities)} GROUP BY 1, 2, 3) a
  ON g.city = a.city AND g.date = a.date AND g.method = a.method""")
    o["mark_join"] = S("SELECT sn, name, CASE WHEN sn IN (SELECT sn FROM r_campaign) THEN 1 ELSE 0 END AS campaign_prod "
                       "FROM products")
    o["fanout_join"] = S(f"""
SELECT o.id, l.create_date, l.type FROM orders_clean o LEFT JOIN order_log l ON o.id = l.order_id
WHERE o.create_date > {q(sp.week_start)} AND o.create_date <= {q(sp.report_date)} AND o.order_status IN (1, 2)""")
    o["null_safe_join"] = S(f"""
SELECT ms.city, ms.name, ms.monthly_quantity, t.today_quantity FROM month_sold ms
LEFT JOIN (SELECT city, name, round({ssum('quantity')}, 6) AS today_quantity FROM items_today GROUP BY 1, 2) t
  ON ms.city IS NOT DISTINCT FROM t.city AND ms.name IS NOT DISTINCT FROM t.name""")
    o["cross_grid"] = S(f"""
SELECT c.city, d.date, k.cate1 FROM {_cities(sp)} c CROSS JOIN ({_grid_dates(sp)}) d
CROSS JOIN (SELECT DISTINCT name AS cate1 FROM cats WHERE length(code) = 2) k""")
    o["totals_row"] = K(f"""
SELECT * FROM
  (SELECT count(*) AS total_visitors, {nd('member_id')} AS unique_visitors FROM logins_window
   WHERE login_date = {q(kp.report_date)})
  CROSS JOIN (SELECT {nd('username')} AS people_count, count(*) AS total_quant FROM orders_window
              WHERE create_date = {q(kp.report_date)})
  CROSS JOIN (SELECT {money(ssum('original_amount'))} AS wkly_total_amount FROM orders_window)""")
    # aggregates
    o["global_agg"] = S(f"SELECT count(*) AS n_items, {money(ssum('sub_total'))} AS amount, "
                        f"{nd('order_id')} AS n_orders FROM items_month")
    o["group_one"] = S(f"SELECT city, count(*) AS n_items, {money(ssum('sub_total'))} AS amount "
                       f"FROM items_month GROUP BY city")
    o["group_multi"] = S(f"SELECT city, method, count(*) AS n_items, {money(ssum('sub_total'))} AS amount "
                         f"FROM items_month GROUP BY city, method")
    o["strict_sum"] = K(f"""
SELECT username, {money(ssum('x'))} AS paid_amount
FROM (SELECT username, CASE WHEN paid_date IS NOT NULL THEN original_amount END AS x FROM orders_clean)
GROUP BY username""")
    o["distinct_count"] = K(f"SELECT a.city, {nd('o.paid_date')} AS paid_days FROM orders_clean o "
                            f"LEFT JOIN area_k a ON o.area_id = a.area_id GROUP BY a.city")
    for lvl, key in ((0, "repeat_rate_total"), (1, "repeat_rate_city"), (2, "repeat_rate_district")):
        o[key] = K(f"SELECT * FROM ({_dup_visit()}) WHERE level = {lvl}")
    o["repeat_visit_rate"] = K(_dup_visit())
    o["repeat_order_rate"] = K(_dup_order())
    o["first_per_key_min"] = K("SELECT member_id, min(login_date) AS first_login_date FROM app GROUP BY member_id")
    o["first_per_key_ordered"] = K("SELECT username, arg_min_null(paid_date, (create_date, CAST(id AS HUGEINT))) AS first_paid_date "
                                   "FROM orders_clean GROUP BY username")
    o["avg_ticket"] = S(f"""
SELECT city, amount, n_orders, amount / n_orders AS avg_ticket FROM (
  SELECT a.city, {money(ssum('o.original_amount'))} AS amount, count(*) AS n_orders
  FROM orders_clean o LEFT JOIN area_k a ON o.area_id = a.area_id
  WHERE o.create_date > {q(sp.month_start)} AND o.create_date <= {q(sp.report_date)} GROUP BY a.city)""")
    o["rollup_visits"] = K(_visits(kp))
    o["rollup_orders"] = K(_orders_day(kp))
    o["rollup_weekly"] = K(_orders_week(kp))
    o["total_row_append"] = S(f"""
WITH st AS ({_by_status(sp)})
SELECT city, delivery_effect, returned, refused, normal FROM st
UNION ALL SELECT {q(ALL_CITIES_LABEL)}, delivery_effect, CAST(sum(returned) AS BIGINT), CAST(sum(refused) AS BIGINT),
  CAST(sum(normal) AS BIGINT) FROM st GROUP BY delivery_effect""")
    o["distinct_rows"] = S("SELECT DISTINCT city, method FROM sales_detail")
    o["new_login_cohort"] = E(_login_cohort(EP))
    o["new_buyer_cohort"] = E(_buyer_cohort(EP))
    # windows, sorts, sets, reshape
    o["peak_flags"] = K(f"""
SELECT city, date, visits,
  CASE WHEN visits = max(visits) OVER w THEN visits END AS visits_max,
  CASE WHEN visits = min(visits) OVER w THEN visits END AS visits_min,
  avg(visits) OVER w AS visits_avg
FROM ({_dense_daily(kp, 'logins_window', 'login_date', 'count(*)', 'visits')}) WINDOW w AS (PARTITION BY city)""")
    o["partition_mean"] = K(f"""
SELECT city, date, orders, avg(orders) OVER (PARTITION BY city) AS orders_avg
FROM ({_dense_daily(kp, 'orders_window', 'create_date', 'count(*)', 'orders')})""")
    o["zero_fill"] = K(_dense_daily(kp, "orders_window", "create_date", "count(*)", "orders"))
    o["topk_per_group"] = S(_top(sp))
    o["sort_asc"] = S("SELECT * FROM month_sold ORDER BY city ASC NULLS LAST, name ASC NULLS LAST")
    o["sort_desc"] = S("SELECT order_id, sn, campaign_prod, sub_total FROM camp_sales ORDER BY campaign_prod DESC")
    first_logins = """
SELECT ap.member_id, ap.first_login_date, m.area_id
FROM (SELECT member_id, min(login_date) AS first_login_date FROM app GROUP BY member_id) ap
LEFT JOIN members m ON ap.member_id = m.member_id"""
    o["union_distinct"] = K(f"{first_logins}\nUNION\nSELECT member_id, first_login_date, area_id FROM members")
    o["union_all"] = K(f"{first_logins}\nUNION ALL\nSELECT member_id, first_login_date, area_id FROM members")
    o["pivot_fixed"] = S(f"""
SELECT city, round(sum(sub_total) FILTER (WHERE method = {q(UN)}), 2) AS unified_alloc,
  round(sum(sub_total) FILTER (WHERE method = {q(SD)}), 2) AS self_alloc,
  round(sum(sub_total) FILTER (WHERE method = {q(SO)}), 2) AS self_supp
FROM items_month GROUP BY city""")
    o["date_series"] = K("""
SELECT CAST(d.date AS DATE) AS date, coalesce(c.n, 0) AS n
FROM (SELECT unnest(generate_series(min(CAST(create_date AS DATE)), max(CAST(create_date AS DATE)), INTERVAL 1 DAY))
        AS date FROM r_app) d
LEFT JOIN (SELECT CAST(create_date AS DATE) AS date, count(*) AS n FROM r_app GROUP BY 1) c
  ON CAST(d.date AS DATE) = c.date""")
    # scalar functions
    o["if_else_null"] = K("SELECT id, CASE WHEN paid_date = create_date THEN 'same_day' "
                          "WHEN NOT (paid_date = create_date) THEN 'later' END AS paid_when FROM orders_clean")
    o["regex_suffix"] = K(f"SELECT member_id, username, regexp_matches(username, {q(kp.x_user_pattern)}) AS x_user "
                          f"FROM members")
    o["delivery_days"] = S("SELECT id, shipping_date, complete_date, duration FROM delivery_orders")
    o["delivery_buckets"] = S("SELECT id, duration, delivery_effect FROM delivery_orders")
    o["status_map"] = S("""
SELECT id,
  CASE WHEN coalesce(shipping_status IN (4, 7), FALSE) THEN 'returned' WHEN shipping_status = 8 THEN 'refused'
       WHEN shipping_status <> 8 THEN 'normal' END AS ship_status_simple,
  CASE WHEN delivery_method = 0 THEN 'unified_alloc' WHEN delivery_method = 1 THEN 'self_alloc'
       WHEN delivery_method NOT IN (0, 1) THEN 'self_supp' END AS method
FROM orders_clean""")
    o["conversion_rate"] = K(f"SELECT city, district, people_count, unique_visitors, conv_rate FROM ({_table2(kp)})")
    o["report_window"] = S(f"SELECT create_date, count(*) AS n_orders FROM orders_clean "
                           f"WHERE create_date > {q(sp.month_start)} AND create_date <= {q(sp.report_date)} GROUP BY 1")
    o["weekend_window"] = S("""
SELECT create_date AS run_date,
  CAST(CASE WHEN isodow(create_date) = 1 THEN create_date - 2 ELSE create_date - 1 END AS DATE) AS window_start,
  CAST(create_date - 1 AS DATE) AS window_end
FROM (SELECT DISTINCT create_date FROM orders_clean)""")
    o["sold_sku_count"] = S(f"SELECT city, method, {nd('sn')} AS count FROM items_today GROUP BY 1, 2")
    # dimensions, facts, reports
    o["area_dim"] = S("SELECT * FROM area_k")
    o["orders_clean"] = K("SELECT * FROM orders_clean")
    o["items_clean"] = S("SELECT * FROM items_clean")
    o["orders_window"] = K("SELECT * FROM orders_window")
    o["logins_window"] = K("SELECT * FROM logins_window")
    o["report_new_users"] = E(_table1(EP))
    o["report_visits_orders"] = K(_table2(kp))
    o["sales_detail"] = S("SELECT * FROM sales_detail")
    o["channel_daily"] = S(_channel_daily(sp))
    o["category_daily_self"] = S(_cat_daily(sp, True))
    o["category_daily_platform"] = S(_cat_daily(sp, False))
    o["report_sales"] = S(_table3(sp))
    o["log_events"] = S("""
SELECT create_date AS event_date, order_id, 'shipped' AS event FROM order_log WHERE type = 15
UNION ALL SELECT create_date, order_id, 'completed' FROM order_log WHERE type = 18""")
    o["delivery_orders"] = S("SELECT * FROM delivery_orders")
    o["delivery_by_status"] = S(_by_status(sp))
    o["delivery_by_channel"] = S(_by_channel(sp))
    o["report_delivery"] = S(_table4(sp))
    o["items_month"] = S("SELECT * FROM items_month")
    o["month_sold"] = S("SELECT * FROM month_sold")
    o["channel_orders"] = S(_channel_distinct(sp, "order_id", CHANNEL_COUNT_HEADERS[:3]))
    o["channel_buyers"] = S(_channel_distinct(sp, "username", CHANNEL_COUNT_HEADERS[3:]))
    co, cb = _channel_distinct(sp, "order_id", CHANNEL_COUNT_HEADERS[:3]), \
        _channel_distinct(sp, "username", CHANNEL_COUNT_HEADERS[3:])
    o["channel_counts"] = S(f"SELECT a.*, b.* EXCLUDE (city) FROM ({co}) a LEFT JOIN ({cb}) b ON a.city = b.city")
    o["sell_through"] = S(_sell_through(sp))
    o["campaign_detail"] = S(f"SELECT {', '.join(CAMP_COLS)} FROM camp_sales WHERE campaign_prod = 1")
    o["campaign_summary"] = S(f"SELECT {nd('order_id')} AS \"{CAMPAIGN_SUMMARY_HEADERS[0]}\", "
                              f"{money(ssum('sub_total'))} AS \"{CAMPAIGN_SUMMARY_HEADERS[1]}\" "
                              f"FROM camp_sales WHERE campaign_prod = 1")
    o["campaign_share"] = S(f"""
SELECT *, no_order_it / nullif(no_order_tt, 0) AS order_frac, subtotal_it / nullif(subtotal_tt, 0) AS subtotal_frac
FROM (SELECT
  (SELECT {nd('order_id')} FROM camp_sales WHERE campaign_prod = 1) AS no_order_it,
  (SELECT {money(ssum('sub_total'))} FROM camp_sales WHERE campaign_prod = 1) AS subtotal_it,
  (SELECT {nd('order_id')} FROM camp_sales) AS no_order_tt,
  (SELECT {money(ssum('sub_total'))} FROM camp_sales) AS subtotal_tt)""")
    # the sinks return what they wrote, read back
    o["sink_csv_report"] = o["report_delivery"]
    parts = {"top_products": _top(sp), "channel_counts": f"SELECT a.*, b.* EXCLUDE (city) FROM ({co}) a LEFT JOIN ({cb}) b ON a.city = b.city",
             "sell_through": _sell_through(sp)}
    o["sink_bundle"] = S(" UNION ALL BY NAME ".join(
        f"SELECT *, {q(name)} AS report, {q(sp.report_date)} AS report_date FROM ({sql})" for name, sql in parts.items()))
    return o
