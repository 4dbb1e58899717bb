"""Connected components of a link table, and link matrices inside one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship_package

#: Edges that a task joins at a time.
HELD_EDGES = 500_000


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b long): the smallest id reachable.

    Alternating large-star and small-star steps, each written to the shared
    folder, until nothing changes: a number of rounds that grows with the
    logarithm of the longest chain. Each task first joins what its own edges
    join, so that many edges of one group go on as one a node. A hub is
    pre-aggregated by partial sums and its join is a plain equi-join that Spark splits.
    """
    e = contract(edges.where("a <> b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.put(e, f"{name}0")
    seen, i = None, 0
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen, i = now, i + 1
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        pairs = large.join(least, F.col("u") == F.col("k"))
        small = pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("k", "m")).distinct()
        e = scratch.put(small, f"{name}{i}")
        scratch.drop(f"{name}{i - 1}")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")) \
        .union(e.select("v", "v").distinct())


def contract(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components: each task turns its own, so many at a time, into stars."""
    def stars(a: np.ndarray, b: np.ndarray):
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = lowest(len(ids), at[:len(a)], at[len(a):])
        own = np.flatnonzero(label != np.arange(len(ids)))
        return ids[own], ids[label[own]]

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in (0, 1)])
            size += batch.num_rows
            if size >= HELD_EDGES:
                held = [stars(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                size = len(held[0][0])
                if 2 * size > HELD_EDGES:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["a", "b"])
                    held, size = [], 0
        if size:
            a, b = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    ship_package(edges.sparkSession)
    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def lowest(n: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The least node (of 0 .. n - 1) that each node reaches by edges between ``rows`` and ``cols``."""
    label = np.arange(n)
    while len(rows):
        low = np.minimum(label[rows], label[cols])
        new = label.copy()
        for at in (rows, cols, label[rows], label[cols]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Star edges (node, root) of the components of a boolean link matrix (rows to columns).

    Nodes are rows 0.. and then columns; as many edges as linked nodes less components.
    """
    rows, cols = np.nonzero(linked)
    n = sum(linked.shape)
    label = lowest(n, rows, cols + linked.shape[0])
    own = np.flatnonzero(label != np.arange(n))
    return list(zip(own.tolist(), label[own].tolist(), strict=True))
