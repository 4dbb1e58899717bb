"""Raw source tables and their readers.

A ``RawTables`` holds the operational tables as the database delivers them
(integral ids, BIT flags as booleans, datetimes). The ingest layer
(``kpiloom.sources.ingest``) turns them into the typed logical frames.

Production reads them over JDBC with partitioned reads; tests bind them to
the driver's Parquet tables (``kpiloom.sources.bindings``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
    TimestampNTZType,
)


def _schema(*cols) -> StructType:
    return StructType([StructField(n, t, True) for n, t in cols])


S, L, I, D, B, TS = StringType(), LongType(), IntegerType(), DoubleType(), BooleanType(), TimestampNTZType()

RAW_SCHEMAS = {
    "order": _schema(("id", L), ("sn", S), ("create_date", TS), ("paid_date", TS), ("returns_date", TS),
                     ("order_status", I), ("member", L), ("username", S), ("area", L),
                     ("original_amount", D), ("payment_method", S), ("shipping_method", S),
                     ("shipping_status", I), ("delivery_method", I)),
    "order_item": _schema(("create_date", TS), ("orders", L), ("sn", L), ("product", L), ("quantity", D),
                          ("sale_factor", D), ("sale_quantity", D), ("is_gift", B), ("sub_total", D)),
    "order_log": _schema(("create_date", TS), ("type", I), ("orders", L)),
    "area": _schema(("id", L), ("name", S), ("name_path", S)),
    "member": _schema(("id", L), ("name", S), ("username", S), ("licence_code", S), ("shop_name", S),
                      ("address", S), ("area", L), ("first_login_date", TS), ("login_date", TS)),
    "app_log": _schema(("create_date", TS), ("operator", L), ("come_from", S), ("method_name", S),
                       ("snap_shot", S)),
    "product": _schema(("id", L), ("sn", L), ("name", S), ("brand", S), ("product_category", S),
                       ("sale_factor", D), ("dealer", L), ("delivery_method", I)),
    "product_category": _schema(("id", S), ("code", S), ("name", S), ("tree_path", S)),
    "dealer": _schema(("id", L), ("sn", S), ("name", S)),
    "contract_product": _schema(("area", L), ("product", L), ("is_marketable", I)),
    "login": _schema(("member", L), ("username", S), ("area", L), ("login_ip", S), ("login_date", TS),
                     ("first_login_date", TS)),
}


@dataclass
class RawTables:
    order: DataFrame
    order_item: DataFrame
    order_log: DataFrame
    area: DataFrame
    member: DataFrame
    app_log: DataFrame
    product: DataFrame
    product_category: DataFrame
    dealer: DataFrame
    contract_product: DataFrame
    login: DataFrame
    test_accounts: DataFrame          # one column: account name
    campaign_products: DataFrame      # column ``sn`` (text)


class LazyRawTables:
    """``RawTables`` whose frames are built on first access.

    A report touches a few of the source tables; building the plans of the
    others (bindings with joins) would only cost driver time.
    """

    FIELDS = tuple(RAW_SCHEMAS) + ("test_accounts", "campaign_products")

    def __init__(self, builders: dict):
        self.__dict__["_builders"] = builders

    def __getattr__(self, name: str) -> DataFrame:
        b = self.__dict__["_builders"]
        if name not in b:
            raise AttributeError(name)
        df = b[name]()
        self.__dict__[name] = df
        return df


def read_jdbc_tables(spark: SparkSession, url: str, tables: dict[str, str], properties: dict,
                     partitioning: dict[str, dict] | None = None,
                     test_accounts_csv: str | None = None,
                     campaign_csv: str | None = None) -> RawTables:
    """Read the operational tables over JDBC.

    ``tables`` maps logical name -> database table; ``partitioning`` maps a
    logical name to ``column/lowerBound/upperBound/numPartitions`` so the big
    tables are read by many tasks in parallel (whole-table reads of the fact
    tables would otherwise be a single task). Credentials come from
    ``properties``; never hard-code them.
    """
    part = partitioning or {}

    def rd(name: str) -> DataFrame:
        opts = {"fetchsize": "10000"}       # rows per round trip (driver defaults are tiny)
        opts.update(properties)
        opts.update({k: str(v) for k, v in part.get(name, {}).items()})
        r = spark.read.format("jdbc").option("url", url).option("dbtable", tables[name])
        for k, v in opts.items():
            r = r.option(k, v)
        return r.load()

    return RawTables(
        **{n: rd(n) for n in RAW_SCHEMAS},
        test_accounts=read_lookup_csv(spark, test_accounts_csv, "account") if test_accounts_csv else
        spark.createDataFrame([], "account string"),
        campaign_products=read_lookup_csv(spark, campaign_csv, "sn", header=True) if campaign_csv else
        spark.createDataFrame([], "sn string"),
    )


def read_parquet_tables(spark: SparkSession, base: str, **lookups) -> RawTables:
    """Raw tables stored as ``{base}/{name}.parquet`` with ``RAW_SCHEMAS``."""
    frames = {n: spark.read.schema(s).parquet(f"{base}/{n}.parquet") for n, s in RAW_SCHEMAS.items()}
    return RawTables(**frames, **lookups)


def read_lookup_csv(spark: SparkSession, path: str, name: str, header: bool = True,
                    column: str | None = None) -> DataFrame:
    """One-column lookup list from CSV: the first (or the named) column as text."""
    df = spark.read.option("header", header).option("inferSchema", False).csv(path)
    c = column or df.columns[0]
    return df.select(df[c].cast("string").alias(name))
