"""Dimensions: area hierarchy, category tree, product channel map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.functions.keys import key_values
from kpiloom.functions.semantics import blank_to_null, if_else, in_set, not_in_set, path_part
from kpiloom.operators.relational import lookup
from kpiloom.params import CHANNEL_SELF_DELIVERED, CHANNEL_UNIFIED, ReportParams


def area_levels(area: DataFrame, municipalities: Sequence[str]) -> DataFrame:
    """Split ``name_path`` (province,city,district) into three columns.

    For the municipality provinces the path has no city level: district takes
    the city piece and city the province. Pieces shorter than two characters
    become NULL.
    """
    muni = in_set("province", municipalities)
    return (area
            .withColumn("province", path_part("name_path", ",", 3, 1))
            .withColumn("city", path_part("name_path", ",", 3, 2))
            .withColumn("district", path_part("name_path", ",", 3, 3))
            .withColumn("district", if_else(muni, F.col("city"), F.col("district")))
            .withColumn("city", if_else(muni, F.col("province"), F.col("city")))
            .withColumn("district", blank_to_null("district"))
            .withColumn("city", blank_to_null("city"))
            .select(F.col("id").alias("area_id"), "province", "city", "district"))


def area_dim(area: DataFrame, p: ReportParams, keep_null_district: bool = True) -> DataFrame:
    """Areas of the selected provinces and cities without excluded districts.

    ``keep_null_district=True`` keeps areas without a district (daily KPI
    report); ``False`` drops them (campaign report).
    """
    out = area_levels(area, p.municipalities).filter(
        in_set("province", p.provinces) & in_set("city", p.cities)
        & not_in_set("district", p.excluded_districts))
    if not keep_null_district:
        out = out.filter(F.col("district").isNotNull())
    return out


def city_districts(area_d: DataFrame, p: ReportParams) -> DataFrame:
    """Distinct (city, district) of the selected areas with a district."""
    return (area_d.filter(in_set("province", p.provinces) & in_set("city", p.cities)
                          & not_in_set("district", p.excluded_districts) & F.col("district").isNotNull())
            .select("city", "district"))


def category_tree(cat: DataFrame) -> DataFrame:
    """Category -> (cate1, cate2, cate3) names.

    Level 1 / level 2 rows are those with a 2- / 4-character code; a row's
    parents are the 2nd and 3rd pieces of ``tree_path`` (``,p1,p2,``).
    Missing levels are filled from the leaf name, then repeated names are
    blanked, in this order: cate3 if equal to cate1, cate3 if equal to cate2,
    cate2 if equal to cate1 (each step sees the previous one).
    """
    named = cat.filter(F.length("code").isin(2, 4)).select(
        F.col("cate_id").cast("string").alias("__id"), F.length("code").alias("__size"), F.col("name").alias("__name"))

    def parent(df: DataFrame, piece: int, code_length: int, name: str) -> DataFrame:
        level = named.filter(F.col("__size") == code_length).select("__id", F.col("__name").alias(name))
        return df.join(level, path_part("tree_path", ",", 4, piece) == F.col("__id"), "left").drop("__id")

    tree = parent(parent(cat, 2, 2, "top"), 3, 4, "middle")
    top, middle, leaf = F.coalesce("top", "name"), F.coalesce("middle", "name"), F.col("name")
    # a comparison with a NULL name is undecided and leaves the level NULL
    differs = lambda a, b: F.when(a != b, b)
    return tree.select("cate_id", top.alias("cate1"), differs(top, middle).alias("cate2"),
                       differs(middle, differs(top, leaf)).alias("cate3"))


def channel_map(product: DataFrame, dealer: DataFrame, p: ReportParams) -> DataFrame:
    """Product sn -> (supplier, method).

    delivery_method 0: unified distribution, supplier from the dealer.
    delivery_method 1: self-delivered, except the excluded dealers (a NULL
    dealer is dropped as well). Any other sn is absent here and is labelled
    self-operated by the reports.
    """
    method, dealer_id = F.col("delivery_method"), F.col("dealer_id")
    mapped = (method == 0) | ((method == 1) & dealer_id.isNotNull() & ~dealer_id.isin(key_values(product, "dealer_id", p.excluded_dealers)))
    return (lookup(product.filter(mapped), dealer.select("dealer_id", "supplier"), "dealer_id")
            .select("sn", "supplier",
                    F.when(method == 0, CHANNEL_UNIFIED).otherwise(CHANNEL_SELF_DELIVERED).alias("method")))
