"""Report bundles: staged writes, one commit, readers of committed days only.

Every report of a run goes to a staging folder of the run. When all of them
are written, read back and counted, one small file in ``{base}/_commits`` names
them with their rows: from then on they count, all together. Only then does
each folder move to its place, ``{base}/{name}/report_date=YYYY-MM-DD``. A run
that dies before its commit leaves folders that no reader looks at; one that
dies while its folders move is read from where they are, and ``clean_bundle``
moves the rest. Of several commits of one day the last counts, report by report.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stamp(prefix: str, day: dt.date, ext: str = "") -> str:
    """Date-stamped output name, e.g. ``report_2024-01-30.xlsx``."""
    return f"{prefix}{day.isoformat()}{ext}"


def _one_file(df: DataFrame, order=()) -> DataFrame:
    """The finished rows in one partition, sorted by ``order`` (the stages before stay parallel)."""
    out = df.repartition(1)
    return out.sortWithinPartitions(*order) if order else out


def _null_texts(df: DataFrame, texts: dict[str, str] | None) -> DataFrame:
    """Columns of ``texts`` as text, their NULLs as the given text (for CSV only)."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(t)) for c, t in (texts or {}).items()})


class _Folder:
    """The files of a folder in any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def texts(self) -> dict[str, str]:
        if not self.fs.exists(self.path):
            return {}
        return {s.getPath().getName(): self._read(s.getPath()) for s in self.fs.listStatus(self.path) if s.isFile()}

    def _read(self, path) -> str:
        stream = self.fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False if there is one of that name."""
        at = self.jvm.org.apache.hadoop.fs.Path(self.path, name)
        if self.fs.exists(at):
            return False
        stream = self.fs.create(at, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path)] if self.fs.exists(self.path) else []

    def delete(self) -> None:
        self.fs.delete(self.path, True)

    def exists(self) -> bool:
        return self.fs.exists(self.path)

    def move(self, target: str) -> None:
        """Take the place of ``target``."""
        to = self.jvm.org.apache.hadoop.fs.Path(target)
        self.fs.delete(to, True)
        self.fs.mkdirs(to.getParent())
        if not self.fs.rename(self.path, to):
            raise OSError(f"cannot move {self.path} to {target}")


class Bundle:
    """One run: ``stage`` each report, then ``commit`` them together."""

    def __init__(self, spark: SparkSession, base: str, fmt: str = "parquet"):
        self.spark, self.base, self.fmt, self.run = spark, base.rstrip("/"), fmt, uuid.uuid4().hex
        self.reports: dict[str, dict] = {}

    def stage(self, name: str, df: DataFrame, report_date: dt.date, small: bool = False, order=(),
              null_text: dict[str, str] | None = None) -> str:
        """Write a report of ``report_date`` and count it as written; readers do not see it yet."""
        day = f"report_date={report_date.isoformat()}"
        path = f"{self.base}/_staged/{self.run}/{name}/{day}"
        if self.fmt == "csv":
            df = _null_texts(df, null_text)
        out = _one_file(df, order) if small else df
        w = out.write.mode("overwrite")
        if self.fmt == "csv":
            w.option("header", True).option("nullValue", "NA").csv(path)   # empty text is quoted, so it reads back
            back = self.spark.read.schema(df.schema).option("header", True).option("nullValue", "NA").csv(path)
        else:
            w.parquet(path)
            back = self.spark.read.schema(df.schema).parquet(path)
        final = f"{self.base}/{name}/{day}"
        self.reports[name] = {"staged": path, "path": final, "report_date": report_date.isoformat(), "rows": back.count()}
        return final

    def commit(self, note: str | None = None) -> str:
        """Make all staged reports visible at once, then move them to their places; returns the name of the commit."""
        if not self.reports:
            raise ValueError("nothing is staged")
        folder = _Folder(self.spark, f"{self.base}/_commits")
        day = max(dt.date.fromisoformat(r["report_date"]) for r in self.reports.values())
        text = json.dumps({"run": self.run, "format": self.fmt, "note": note, "reports": self.reports})
        while True:   # commits are numbered; a number that another run has taken meanwhile is left to it
            number = max((int(n.split("_")[0]) for n in folder.texts() if n.split("_")[0].isdigit()), default=0) + 1
            name = stamp(f"{number:012d}_report_", day, ".json")
            if folder.create(name, text):
                break
        for r in self.reports.values():
            _Folder(self.spark, r["staged"]).move(r["path"])
        _Folder(self.spark, f"{self.base}/_staged/{self.run}").delete()
        return name


def commits(spark: SparkSession, base: str) -> list[dict]:
    """Whole commits of a bundle folder, oldest first; a file that was cut off while written is none."""
    found = _Folder(spark, f"{base.rstrip('/')}/_commits").texts()
    out = []
    for name in sorted(n for n in found if n.split("_")[0].isdigit()):
        try:
            out.append(json.loads(found[name]))
        except ValueError:
            continue
    return out


def committed(spark: SparkSession, base: str, name: str) -> dict[str, dict]:
    """By day, the report of the last commit that has it: path (where it lies now), rows and the commit's note."""
    out = {}
    for c in commits(spark, base):
        if name in c["reports"]:
            r = c["reports"][name]
            out[r["report_date"]] = {**r, "note": c["note"], "run": c["run"]}
    for r in out.values():
        if _Folder(spark, r["staged"]).exists():
            r["path"] = r["staged"]
    return out


def write_bundle(frames: dict[str, DataFrame], base: str, report_date: dt.date, fmt: str = "parquet",
                 small: tuple[str, ...] = (), order: dict | None = None,
                 null_text: dict[str, dict[str, str]] | None = None) -> dict[str, str]:
    """Write and commit the reports of one day as one bundle; returns their folders.

    Replaces the spreadsheet with several blocks: every block is a dataset
    readable by Spark or any Parquet/CSV tool. ``small`` names reports that
    are written as a single file (their finished rows are moved, the stages
    before stay parallel), sorted by their expressions in ``order``.
    ``null_text`` names, per report, the CSV text of NULL in a column.
    """
    if not frames:
        return {}
    b = Bundle(next(iter(frames.values())).sparkSession, base, fmt)
    paths = {name: b.stage(name, df, report_date, name in small, (order or {}).get(name, ()), (null_text or {}).get(name))
             for name, df in frames.items()}
    b.commit()
    return paths


def read_bundle(spark: SparkSession, base: str, name: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """One report of all committed days, with ``report_date`` as a partition column (a filter on it prunes folders).

    CSV needs the report's ``schema`` for its types; ``NA`` is read as NULL. A
    report without a commit is an error, not an empty table.
    """
    days = committed(spark, base, name)
    if not days:
        raise ValueError(f"{base}: no committed run has the report {name}")
    base = base.rstrip("/")
    by_root: dict[str, list] = {}
    for day in sorted(days):   # a run whose folders still move has a root of its own
        path = days[day]["path"]
        by_root.setdefault(path.rsplit("/", 1)[0], []).append(path)
    out = None
    for root, paths in by_root.items():
        reader = spark.read.option("basePath", root)
        if fmt == "csv":
            reader = reader.option("header", True).option("nullValue", "NA")
            one = (reader.schema(schema) if schema is not None else reader).csv(paths)
        else:
            one = reader.parquet(*paths)
        out = one if out is None else out.unionByName(one)
    return out


def clean_bundle(spark: SparkSession, base: str) -> list[str]:
    """Finish the moves of committed runs and delete what other runs have staged; returns those runs.

    Not while a run is writing.
    """
    base = base.rstrip("/")
    known = {c["run"]: c for c in commits(spark, base)}
    last = {(name, r["report_date"]): c["run"] for c in known.values() for name, r in c["reports"].items()}
    gone = []
    for run in _Folder(spark, f"{base}/_staged").names():
        for name, r in known.get(run, {"reports": {}})["reports"].items():
            staged = _Folder(spark, r["staged"])
            if staged.exists() and last[name, r["report_date"]] == run:
                staged.move(r["path"])
        if run not in known:
            gone.append(run)
        _Folder(spark, f"{base}/_staged/{run}").delete()
    return gone
