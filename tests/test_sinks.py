"""Sink round trips (Z1-Z3)."""

import datetime as dt

import pytest
from helpers import rows
from kpiloom.session import ensure_checkpoint_dir
from kpiloom.sources.sinks import csv_report, read_bundle, stamp, write_bundle


def test_csv_report_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), (None, None)], "city string, v double")
    path = str(tmp_path / "t")
    csv_report(df, path)
    back = spark.read.option("header", True).option("nullValue", "NA").schema("city string, v double").csv(path)
    assert rows(back) == rows(df)
    text = "".join(open(p).read() for p in (tmp_path / "t").glob("part-*"))
    assert "NA" in text and text.startswith("city,v")


def test_bundle_partitioned_by_report_date(spark, tmp_path):
    base = str(tmp_path / "b")
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    df = spark.createDataFrame([("a", 1)], "city string, n int")
    write_bundle({"t1": df}, base, d1, small=("t1",))
    write_bundle({"t1": df.selectExpr("city", "n + 1 as n")}, base, d2)
    back = read_bundle(spark, base, "t1")
    assert rows(back, "city", "n") == [("a", 1), ("a", 2)]
    assert back.filter(f"report_date = '{d2}'").count() == 1
    assert stamp("report_", d1, ".xlsx") == "report_2024-01-01.xlsx"


def test_checkpoint_dir_is_read_from_session(spark):
    path = ensure_checkpoint_dir(spark)
    assert path and spark.sparkContext.getCheckpointDir()


def test_run_daily_bundle(spark, tmp_path):
    from kpiloom.plans.daily import run_daily
    from kpiloom.sources.sinks import read_bundle
    from rawfixture import PARAMS, raw_tables

    paths = run_daily(raw_tables(spark), PARAMS, str(tmp_path / "out"))
    assert "table2_visits_orders" in paths and "campaign_summary" in paths
    t2 = read_bundle(spark, str(tmp_path / "out"), "table2_visits_orders")
    assert t2.filter("city = '汇总'").collect()[0]["total_visitors"] == 4


def test_lookup_csv_and_run_modes(spark, tmp_path):
    import datetime as dt

    from kpiloom.params import ReportParams, campaign_window
    from kpiloom.sources.raw import read_lookup_csv

    p = tmp_path / "acc.csv"
    p.write_text("account,other\nt1,x\n007,y\n")
    df = read_lookup_csv(spark, str(p), "account")
    assert sorted(r.account for r in df.collect()) == ["007", "t1"]
    today = dt.date(2024, 1, 29)  # a Monday
    assert ReportParams.for_run(today, "afternoon").report_date == today
    m = ReportParams.for_run(today, "morning")
    assert (m.report_date, m.week_start, m.month_start) == (dt.date(2024, 1, 28), dt.date(2024, 1, 21),
                                                            dt.date(2023, 12, 29))
    assert campaign_window(today) == (dt.date(2024, 1, 27), dt.date(2024, 1, 28))
    assert campaign_window(dt.date(2024, 1, 30)) == (dt.date(2024, 1, 29), dt.date(2024, 1, 29))


def test_scale_conf_sizes_partitions():
    from kpiloom.session import scale_conf

    c = scale_conf(1 << 40)     # 1 TiB largest shuffle at 256 MiB per partition
    assert c["spark.sql.shuffle.partitions"] == "4096"
    assert scale_conf(10)["spark.sql.shuffle.partitions"] == "1"
    assert scale_conf(1 << 50)["spark.sql.shuffle.partitions"] == str(1 << 22)   # no cap


def test_a_cluster_needs_a_shared_checkpoint_dir():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_run_daily_excludes_the_account_frame(spark, tmp_path):
    from dataclasses import replace

    from kpiloom.plans.facts import Model
    from rawfixture import PARAMS, raw_tables

    m = Model(raw_tables(spark), replace(PARAMS, test_accounts=()), snapshot=False)
    assert "105" not in {r.id for r in m.orders.collect()}
    assert "test1" not in {r.username for r in m.logins.collect()}
    more = Model(raw_tables(spark), replace(PARAMS, test_accounts=("u10",)), snapshot=False)   # literals are added
    assert not {"100", "101", "105"} & {r.id for r in more.orders.collect()}


def test_csv_bundle_read_back_keeps_nulls_and_types(spark, tmp_path):
    import datetime as dt

    from kpiloom.sources.sinks import read_bundle, write_bundle

    df = spark.createDataFrame([("a", 1.5), (None, None), ("", 2.0)], "name string, v double")
    write_bundle({"r": df}, str(tmp_path / "b"), dt.date(2024, 1, 1), fmt="csv", small=("r",))
    back = read_bundle(spark, str(tmp_path / "b"), "r", fmt="csv", schema=df.schema)
    assert sorted(map(str, back.select("name", "v").collect())) == sorted(map(str, df.collect()))


def test_parquet_source_roundtrip(spark, tmp_path):
    from kpiloom.plans import reports as R
    from kpiloom.plans.facts import Model
    from kpiloom.sources.raw import RAW_SCHEMAS, read_parquet_tables
    from rawfixture import PARAMS, raw_tables

    raw = raw_tables(spark)
    for name in RAW_SCHEMAS:
        getattr(raw, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    back = read_parquet_tables(spark, str(tmp_path), test_accounts=raw.test_accounts,
                               campaign_products=raw.campaign_products)
    a = sorted(map(tuple, R.report_visits_orders(Model(raw, PARAMS, snapshot=False)).collect()))
    b = sorted(map(tuple, R.report_visits_orders(Model(back, PARAMS, snapshot=False)).collect()))
    assert a == b


def test_run_daily_needs_a_geography_and_the_preset_has_one(spark, tmp_path):
    from dataclasses import replace

    from kpiloom.params import ReportParams
    from kpiloom.plans.daily import run_daily
    from rawfixture import PARAMS, raw_tables

    for empty in ({"cities": ()}, {"provinces": ()}, {"campaign_cities": ()}):
        with pytest.raises(ValueError, match="provinces and cities"):
            run_daily(raw_tables(spark), replace(PARAMS, **empty), str(tmp_path))
    p = ReportParams.preset(dt.date(2024, 3, 10), dropped_area_ids=("1",))
    assert p.cities and p.provinces and p.x_area_ids == ("970",) and p.x_district and p.dropped_area_ids == ("1",)
    c = p.for_campaign()
    assert set(c.cities) < set(p.cities) and c.report_date == p.report_date


def test_run_daily_csv_files_are_sorted_and_name_missing_rates(spark, tmp_path):
    from kpiloom.plans.daily import run_daily
    from rawfixture import PARAMS, raw_tables

    paths = run_daily(raw_tables(spark), PARAMS, str(tmp_path / "out"), fmt="csv", localized=True)

    def lines(name):
        (part,) = (tmp_path / "out" / name / "report_date=2024-03-10").glob("part-*.csv")
        return [x.split(",") for x in part.read_text().splitlines()[1:]]

    t1, t3, t4 = (lines(n) for n in ("table1_new_users", "table3_sales", "table4_delivery"))
    assert [x[:2] for x in t1] == sorted(x[:2] for x in t1)
    assert [x[0] for x in t3[:7]] == ["各地汇总"] * 7 and [x[:2] for x in t3[7:]] == sorted(x[:2] for x in t3[7:])
    assert [x[0] for x in t4[:5]] == ["各地汇总"] * 5
    assert lines("table2_visits_orders")[0][0] == "汇总" and paths["campaign_summary"].endswith("2024-03-10")
    rate = spark.createDataFrame([("C1", None), ("C2", 0.5)], "city string, conv_rate double")
    csv_report(rate, str(tmp_path / "rate"), single_file=True, order=["city"], null_text={"conv_rate": "#N/A"})
    (part,) = (tmp_path / "rate").glob("part-*.csv")
    assert part.read_text().splitlines() == ["city,conv_rate", "C1,#N/A", "C2,0.5"]


def test_reports_of_a_run_read_the_stored_detail_only(spark):
    from kpiloom.plans import reports as R
    from kpiloom.plans.daily import materialize_facts
    from kpiloom.plans.facts import Model
    from rawfixture import ORDER, PARAMS, T, raw_tables

    item = [(T(2024, 3, 10, 10), 100, 501, 501, 2.0, 1.0, 2.0, False, 10.0),
            (T(2024, 3, 10, 12), 103, 501, 501, 1.0, 1.0, 1.0, False, 7.0)]    # cancelled order: not in the window
    lazy, stored = (Model(raw_tables(spark, order_item=item), PARAMS) for _ in range(2))
    materialize_facts(stored)
    for report in (R.report_sales, R.channel_counts):
        assert sorted(map(str, report(lazy).collect())) == sorted(map(str, report(stored).collect()))
        files = [f for f in report(stored).inputFiles()]
        assert files and all("/facts/sales_detail/" in f for f in files)
    # a later run over other rows sees them: nothing of the earlier run is kept
    other = Model(raw_tables(spark, area=[(1, "a1", "P1,C2,D9")], order=ORDER), PARAMS)
    assert [tuple(r)[1:] for r in other.area.collect()] == [("P1", "C2", "D9")]
