"""Tiny hand-made raw source tables for golden tests."""

import datetime as dt

from kpiloom.params import ReportParams
from kpiloom.sources.raw import RAW_SCHEMAS, RawTables

T = dt.datetime
D = dt.date

PARAMS = ReportParams(
    report_date=D(2024, 3, 10), provinces=("P1", "北京市"), cities=("C1", "C2", "北京市"),
    excluded_districts=("DX",), test_accounts=("test1",), x_area_ids=("970",), dropped_area_ids=("999",),
    x_user_pattern="X$", x_district="HN", category_columns={"Food": "food", "Home": "home"},
    money_scale=2, quantity_scale=6, campaign_start=D(2024, 3, 9), campaign_end=D(2024, 3, 10),
)

AREA = [
    (1, "a1", "P1,C1,D1"), (2, "a2", "P1,C1,D2"), (3, "a3", "P1,C2,D3"), (4, "a4", "P1,C1,DX"),
    (5, "a5", "P1,C1"),            # no district
    (6, "a6", "北京市,朝阳区"),       # municipality: city <- province, district <- second piece
    (7, "a7", "P2,C9,D9"),         # other province
    (970, "hn", "P1,C2,HN"), (999, "drop", "P1,C1,D1"),
]

MEMBER = [
    (10, "m10", "u10", "L", "s10", "addr", 1, T(2024, 3, 9, 8), T(2024, 3, 9, 8)),
    (11, "m11", "u11X", "L", "s11", "addr", 970, None, None),
    (12, "m12", "u12", "L", "s12", "addr", 3, T(2024, 1, 1), T(2024, 1, 1)),
    (13, "m13", "test1", "L", "s13", "addr", 1, T(2024, 3, 10), T(2024, 3, 10)),
    (14, "m14", "u14", "L", "s14", "addr", 6, None, None),
]

LOGIN = [  # member, username, area, ip, login_date, first_login_date
    (10, "u10", 1, "ip", T(2024, 3, 10, 9), None),
    (10, "u10", 1, "ip", T(2024, 3, 10, 18), None),
    (10, "u10", 1, "ip", T(2024, 3, 8, 9), None),
    (12, "u12", 3, "ip", T(2024, 3, 10, 7), None),
    (11, "u11X", 970, "ip", T(2024, 3, 10, 7), None),   # HN user ending X: dropped from windows
    (13, "test1", 1, "ip", T(2024, 3, 10, 7), None),    # test account
    (14, "u14", 6, "ip", T(2024, 3, 9, 7), None),
    (14, "u14", 6, "ip", T(2024, 3, 10, 7), None),
    (10, "u10", 1, "ip", T(2024, 3, 3, 23), None),      # before the week window
]

ORDER = [  # id, sn, create, paid, returns, status, member, username, area, amount, pay, ship_m, ship_status, dm
    (100, "S100", T(2024, 3, 10, 10), T(2024, 3, 10, 10), None, 1, 10, "u10", 1, 10.0, None, None, 1, 0),
    (101, "S101", T(2024, 3, 9, 10), T(2024, 3, 9, 10), None, 2, 10, "u10", 1, 20.0, None, None, 8, 1),
    (102, "S102", T(2024, 3, 10, 11), T(2024, 3, 10, 11), None, 4, 12, "u12", 3, 5.5, None, None, 4, 2),
    (103, "S103", T(2024, 3, 10, 12), None, None, 3, 12, "u12", 3, 7.0, None, None, 1, 0),       # cancelled
    (104, "S104", T(2024, 3, 10, 12), T(2024, 3, 10, 12), None, 1, 11, "u11X", 970, 9.0, None, None, 1, 0),
    (105, "S105", T(2024, 3, 10, 12), T(2024, 3, 10, 12), None, 1, 13, "test1", 1, 9.0, None, None, 1, 0),
    (106, "S106", T(2024, 3, 10, 13), T(2024, 3, 10, 13), None, 1, 99, None, 1, 3.0, None, None, 1, 0),
    (107, "S107", T(2024, 3, 10, 13), T(2024, 3, 10, 13), None, 1, 15, "u15", 7, 4.0, None, None, 1, 0),
    (108, "S108", T(2024, 3, 10, 13), T(2024, 3, 10, 13), None, 1, 16, "u16", 999, 4.0, None, None, 1, 0),
]


def raw_tables(spark, **over):
    data = {"area": AREA, "member": MEMBER, "login": LOGIN, "order": ORDER}
    data.update(over)
    frames = {n: spark.createDataFrame(data.get(n, []), RAW_SCHEMAS[n]) for n in RAW_SCHEMAS}
    return RawTables(**frames, test_accounts=spark.createDataFrame([("test1",)], "account string"),
                     campaign_products=spark.createDataFrame([], "sn string"))
