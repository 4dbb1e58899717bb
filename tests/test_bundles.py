"""Bundles count as a whole or not at all."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from helpers import rows
from kpiloom.sources import bundles
from kpiloom.sources.sinks import Bundle, clean_bundle, committed, read_bundle, write_bundle

D1, D2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)


def frames(spark, n):
    return {"a": spark.createDataFrame([("x", n), (None, n)], "city string, n int"), "b": spark.createDataFrame([(n,)], "v int")}


def test_a_run_that_dies_between_two_reports_is_not_seen(spark, tmp_path):
    base = str(tmp_path / "out")
    with pytest.raises(ValueError, match="no committed run"):
        read_bundle(spark, base, "a")
    bad = frames(spark, 1)
    bad["b"] = bad["b"].select(F.raise_error(F.lit("lost")).cast("int").alias("v"))
    with pytest.raises(Exception, match="lost"):
        write_bundle(bad, base, D1)
    with pytest.raises(ValueError, match="no committed run"):
        read_bundle(spark, base, "a")
    write_bundle(frames(spark, 1), base, D1)
    bad = frames(spark, 2)
    bad["b"] = bad["b"].select(F.raise_error(F.lit("lost")).cast("int").alias("v"))
    with pytest.raises(Exception, match="lost"):
        write_bundle(bad, base, D1)      # the same day again
    assert rows(read_bundle(spark, base, "a"), "city", "n") == [(None, 1), ("x", 1)]
    assert len(clean_bundle(spark, base)) == 2 and clean_bundle(spark, base) == []
    assert rows(read_bundle(spark, base, "a"), "n") == [(1,), (1,)]


def test_a_run_that_dies_while_its_folders_move_is_seen_whole(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "out")
    write_bundle(frames(spark, 1), base, D1)
    write_bundle(frames(spark, 5), base, D2)
    moves, move = [], bundles._Folder.move

    def dies(self, target):
        if moves:
            raise KeyboardInterrupt
        moves.append(target)
        move(self, target)

    monkeypatch.setattr(bundles._Folder, "move", dies)
    with pytest.raises(KeyboardInterrupt):
        write_bundle(frames(spark, 2), base, D1)
    monkeypatch.setattr(bundles._Folder, "move", move)
    both = {name: rows(read_bundle(spark, base, name)) for name in "ab"}
    assert both == {"a": [(None, 2, D1), (None, 5, D2), ("x", 2, D1), ("x", 5, D2)], "b": [(2, D1), (5, D2)]}
    assert clean_bundle(spark, base) == []
    assert {name: rows(read_bundle(spark, base, name)) for name in "ab"} == both
    assert not (tmp_path / "out/_staged").exists() or not list((tmp_path / "out/_staged").iterdir())
    assert list((tmp_path / "out/b/report_date=2024-01-01").glob("part-*.parquet"))


def test_the_commit_names_rows_and_day(spark, tmp_path):
    base = str(tmp_path / "out")
    b = Bundle(spark, base)
    with pytest.raises(ValueError):
        b.commit()
    empty = spark.createDataFrame([], "v int")
    b.stage("a", frames(spark, 1)["a"], D1, small=True, order=("n",))
    b.stage("none", empty, D2)
    name = b.commit("why")
    assert name == "000000000001_report_2024-01-02.json"
    told = json.loads((tmp_path / "out/_commits" / name).read_text())
    assert {n: r["rows"] for n, r in told["reports"].items()} == {"a": 2, "none": 0}
    assert committed(spark, base, "a")["2024-01-01"]["note"] == "why"
    assert read_bundle(spark, base, "none").count() == 0
    (tmp_path / "out/_commits/000000000002_report_2024-01-03.json").write_text('{"run": "cut of')
    assert len(bundles.commits(spark, base)) == 1
    write_bundle(frames(spark, 3), base, D1)
    assert rows(read_bundle(spark, base, "a"), "n") == [(3,), (3,)] and len(bundles.commits(spark, base)) == 2


def test_csv_bundles_read_back(spark, tmp_path):
    base = str(tmp_path / "out")
    df = spark.createDataFrame([("x", None), (None, 2)], "city string, n int")
    write_bundle({"a": df}, base, D1, fmt="csv", null_text={"a": {"n": "#N/A"}})
    assert rows(read_bundle(spark, base, "a", "csv", "city string, n string")) == [(None, "2", D1), ("x", "#N/A", D1)]
