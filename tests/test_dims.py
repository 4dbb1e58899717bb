"""Dimension operators."""

from helpers import rows
from kpiloom.params import CHANNEL_SELF_DELIVERED, CHANNEL_UNIFIED, ReportParams
from kpiloom.plans.dims import area_levels, category_tree, channel_map
import datetime as dt


def test_area_levels_municipality_and_short_pieces(spark):
    df = spark.createDataFrame([("1", "n", "北京市,朝阳区"), ("2", "n", "P,C"), ("3", "n", "P,C,D"),
                                ("4", "n", "P,X,Y")], "id string, name string, name_path string")
    out = area_levels(df, ("北京市",))
    assert rows(out, "area_id", "province", "city", "district") == [
        ("1", "北京市", "北京市", "朝阳区"), ("2", "P", None, None), ("3", "P", None, None), ("4", "P", None, None)]


def test_category_tree_sequence(spark):
    cat = spark.createDataFrame([
        ("1", "10", "Food", ","), ("2", "1001", "Snacks", ",1,"), ("3", "100101", "Chips", ",1,2,"),
        ("4", "100102", "Snacks", ",1,2,"),   # leaf named like its parent -> cate3 blanked
    ], "cate_id string, code string, name string, tree_path string")
    out = rows(category_tree(cat), "cate_id", "cate1", "cate2", "cate3")
    assert out == [("1", "Food", None, None), ("2", "Food", "Snacks", None), ("3", "Food", "Snacks", "Chips"),
                   ("4", "Food", "Snacks", None)]


def test_channel_map_excluded_dealer(spark):
    p = ReportParams(report_date=dt.date(2024, 1, 1))
    prod = spark.createDataFrame([("a", "1", 0), ("b", "2", 1), ("c", "3", 1), ("d", None, 1), ("e", "1", 2)],
                                 "sn string, dealer_id string, delivery_method int")
    dealer = spark.createDataFrame([("1", "D1", "s1"), ("3", "D3", "s3")], "dealer_id string, sn string, supplier string")
    out = rows(channel_map(prod, dealer, p), "sn", "supplier", "method")
    assert out == [("a", "s1", CHANNEL_UNIFIED), ("c", "s3", CHANNEL_SELF_DELIVERED)]
