"""Helpers shared by the operators: tables, written intermediates, Arrow maps, word caches."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kpiloom.session import ensure_checkpoint_dir

#: Rows of one Arrow batch: with whole texts in a batch this bounds a worker's memory.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a session: they may start in another folder."""
    sc = spark.sparkContext
    if getattr(sc, "_kpiloom_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="kpiloom-")) / "kpiloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(target))
    sc._kpiloom_shipped = True


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in this session, since rows hold whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


class Scratch:
    """Written tables of one operator run, in a new folder below ``spark.checkpoint.dir``.

    ``put`` writes a frame as Parquet and reads it back, which cuts its lineage
    in a folder that all executors share; ``drop`` deletes tables that no later
    frame reads.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def map_rows(df: DataFrame, rows: Callable[[Iterator[dict]], Iterable[tuple]], schema: str,
             flush: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` over the rows of each partition in order.

    ``rows`` gets an iterator of one tuple per row (the frame's column order)
    and yields output tuples; at most ``flush`` of them are held at a time.
    """
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)
    out_schema = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out_schema)

    def run(batches):
        def source():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        held: list[tuple] = []
        for row in rows(source()):
            held.append(row)
            if len(held) >= flush:
                yield _batch(held, arrow)
                held = []
        if held:
            yield _batch(held, arrow)

    return df.mapInArrow(run, out_schema)


def map_groups(df: DataFrame, n_keys: int, group: Callable[[tuple, list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``group(key, rows)`` for each set of rows that agree in the first ``n_keys`` columns.

    For many groups of bounded size: rows are dealt by the key, sorted, and
    streamed, so that a task holds one group at a time.
    """
    keys = df.columns[:n_keys]

    def rows(source):
        at, held = None, []
        for row in source:
            key = row[:n_keys]
            if key != at:
                if held:
                    yield from group(at, held)
                at, held = key, []
            held.append(row[n_keys:])
        if held:
            yield from group(at, held)

    return map_rows(df.repartition(*keys).sortWithinPartitions(*keys), rows, schema)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)],
                                      schema=arrow)


class WordCache(dict):
    """Results by word, of bounded size: ``self[word]`` computes what is not held.

    Two generations of at most ``size`` words are kept; when the young one is
    full the old one goes, so frequent words stay.
    """

    def __init__(self, compute: Callable, size: int = 150_000, longest: int = 64):
        super().__init__()
        self.compute, self.size, self.longest, self.old = compute, size, longest, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.compute(word)
        if len(word) <= self.longest:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[word] = value
        return value
