"""Embedding whitening from a polarisation covariance (operator 13).

Entries become integers. Of every dimension and of every sum of two dimensions
the tasks add up the squares of centred values, exactly; half the difference of
the variance of a sum and those of its two parts is their covariance. The
matrix of one row and column a dimension is taken apart by ``eigh`` on the
driver, and the rows are projected where they lie.

Values are centred before they are squared: on the whole part of the mean in
the tasks (so integers stay small), on the rest as a fraction afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship_package

#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Components that are returned at most.
COMPONENTS = 32
#: Bits of the parts in which sums travel, so that they stay exact whatever their size.
LIMB = 40
#: Least share of the largest eigenvalue that counts as variance.
FLAT = 1e-12


def integers(column: pa.Array, n_dims: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the places of a list column's usable vectors and their integer entries, a row each.

    Unusable are null vectors, those with null or non-finite entries or with
    entries whose integer no long holds, and (with ``n_dims``) those of another length.
    """
    sizes = np.diff(column.offsets.to_numpy())
    whole = np.array(column.is_valid())
    entries = column.flatten()  # without those of null vectors
    values = entries.to_numpy(zero_copy_only=False).astype(np.float64)
    values[np.array(entries.is_null())] = np.nan
    ends = np.cumsum(np.where(whole, sizes, 0))
    out = {}
    for size in np.unique(sizes[whole]).tolist():
        if n_dims not in (None, size) or not size:
            continue
        at = np.flatnonzero(whole & (sizes == size))
        x = np.floor(values[(ends[at] - size)[:, None] + np.arange(size)] * SCALE)
        good = (np.abs(x) < 2.0 ** 62).all(axis=1)  # false for NaN and infinity
        if good.any():
            out[size] = at[good], x[good].astype(np.int64) + OFFSET
    return out


def wide(x: np.ndarray, terms: int) -> np.ndarray:
    """``x`` as Python integers where ``terms`` squares of sums of two of its entries could pass 64 bits."""
    top = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    return x if 4 * top * top * max(terms, 1) < 2 ** 62 else x.astype(object)


def limbs(value: int):
    """(k, part) whose sum of part * 2**(LIMB * k) is ``value``."""
    k = 0
    while value not in (0, -1) or k == 0:
        if -(1 << LIMB) < value < 1 << LIMB:
            break
        yield k, value & (1 << LIMB) - 1
        value >>= LIMB
        k += 1
    if value:
        yield k, value


def _totals(rows: DataFrame, *keys: str) -> dict:
    """Exact sums by key, from rows (keys, limb, part)."""
    out: dict = {}
    for r in rows.groupBy(*keys, "limb").agg(F.sum("part").alias("part")).collect():
        at = tuple(r[k] for k in keys)
        out[at] = out.get(at, 0) + (r["part"] << LIMB * r["limb"])
    return out


def _matrices(batches, n_dims: int):
    """The usable integer vectors of each batch with their ids."""
    for batch in batches:
        for kept, x in integers(batch.column(1), n_dims).values():
            yield batch.column(0).take(pa.array(kept)), x


@dataclass
class Whitening:
    """Fit list size, sums and exact covariances, and the components by falling eigenvalue."""

    n: int
    sums: list[int]
    covariance: list[list[Fraction]]
    eigenvalues: np.ndarray
    vectors: np.ndarray
    identity_error: float = 0.0

    @property
    def explained(self) -> list[float]:
        trace = float(sum((self.covariance[i][i] for i in range(len(self.sums))), Fraction(0)))
        return [float(max(e, 0.0)) / trace if trace else 0.0 for e in self.eigenvalues]

    @property
    def flat(self) -> np.ndarray:
        """True for components without variance: they cannot be scaled to one."""
        top = self.eigenvalues[0] if len(self.eigenvalues) else 0.0
        return ~(self.eigenvalues > FLAT * max(top, 0.0))

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values of integer rows; NaN in flat components."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])
        scale = np.where(self.flat, np.nan, np.sqrt(np.maximum(self.eigenvalues, 0.0)))
        return ((x - whole).astype(np.float64) - rest) @ self.vectors / scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S)^2 for each row, exact."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], dtype=object)
        y = x - whole
        reach = max(abs(int(y.max())), abs(int(y.min()))) * self.n + self.n if y.size else 0
        if reach * reach * max(len(self.sums), 1) < 2 ** 62:
            d = y * self.n - rest.astype(np.int64)
        else:
            d = y.astype(object) * self.n - rest
        return (d * d).sum(axis=1).tolist()


def fit(embeddings: DataFrame, components: int = COMPONENTS, vec_col: str = "embedding") -> Whitening | None:
    """Fit on every usable vector of ``embeddings``; None if there is none.

    The table's dimension is the length that most usable vectors have (ties:
    the longer). To the driver go one sum a dimension and one sum of squares a
    pair of dimensions, whatever the number of rows.
    """
    spark = embeddings.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "whitening")
    vectors = embeddings.select(F.lit(0).alias("id"), F.col(vec_col).alias("v"))

    def add_up(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for size, (kept, x) in integers(batch.column(1)).items():
                at = found.setdefault(size, [0, [0] * size])
                at[0] += len(kept)
                at[1] = [a + b for a, b in zip(at[1], wide(x, len(x)).sum(axis=0).tolist(), strict=True)]
        rows = [(size, d, k, part) for size, (n, sums) in found.items() for d, value in enumerate([n, *sums]) for k, part in limbs(value)]
        yield _batch(rows, "size", "dim", "limb", "part")

    parts = scratch.put(vectors.mapInArrow(add_up, "size long, dim long, limb long, part long"), "sums")
    sizes = parts.where("dim = 0").groupBy("size").agg(F.sum(F.col("part") * F.pow(F.lit(2.0), F.col("limb") * LIMB)).alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    if most is None or not most["size"]:
        scratch.drop("sums")
        return None
    d = most["size"]
    totals = _totals(parts.where(F.col("size") == d), "dim")
    scratch.drop("sums")
    n, sums = totals[0,], [totals.get((i + 1,), 0) for i in range(d)]
    whole = np.array([s // n for s in sums], np.int64)

    def squares(batches):
        own, pairs = np.zeros(d, object), [np.zeros(d - i - 1, object) for i in range(d)]
        for _, x in _matrices(batches, d):
            y = wide(x - whole, len(x))
            own = own + (y * y).sum(axis=0)
            for i in range(d - 1):
                t = y[:, i:i + 1] + y[:, i + 1:]
                pairs[i] = pairs[i] + (t * t).sum(axis=0)
        rows = [(i, i, k, part) for i in range(d) for k, part in limbs(int(own[i]))]
        rows += [(i, i + 1 + j, k, part) for i in range(d) for j, value in enumerate(pairs[i]) for k, part in limbs(int(value))]
        yield _batch(rows, "i", "j", "limb", "part")

    q = _totals(vectors.mapInArrow(squares, "i long, j long, limb long, part long"), "i", "j")
    # the mean of y = x - whole is rest / n; the variance of a sum of dimensions is its mean square less its squared mean
    rest = [s % n for s in sums]

    def variance(i: int, j: int) -> Fraction:
        mean = Fraction(rest[i] if i == j else rest[i] + rest[j], n)
        return Fraction(q.get((i, j), 0), n) - mean * mean

    own = [variance(i, i) for i in range(d)]
    cov = [[Fraction(0)] * d for _ in range(d)]
    for i in range(d):
        cov[i][i] = own[i]
        for j in range(i + 1, d):
            cov[i][j] = cov[j][i] = (variance(i, j) - own[i] - own[j]) / 2
    values, axes = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    pick = np.argsort(-values, kind="stable")[:components]
    out = Whitening(n, sums, cov, values[pick], axes[:, pick])
    out.identity_error = _identity_error(vectors, out)
    return out


def _identity_error(vectors: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, over components with variance."""
    good = np.flatnonzero(~w.flat)
    held, d, m = vectors.sparkSession.sparkContext.broadcast(w), len(w.sums), len(good)
    if not m:
        return 0.0

    def moments(batches):
        first, second = np.zeros(m), np.zeros((m, m))
        for _, x in _matrices(batches, d):
            y = held.value.project(x)[:, good]
            first += y.sum(axis=0)
            second += y.T @ y
        rows = [(-1, j, float(first[j])) for j in range(m)]
        rows += [(i, j, float(second[i, j])) for i in range(m) for j in range(i, m)]
        yield _batch(rows, "i", "j", "part", kinds=(pa.int64(), pa.int64(), pa.float64()))

    # the projection has taken the exact mean off, so the products are those of centred values; what rounding left goes here
    rows = vectors.mapInArrow(moments, "i long, j long, part double").groupBy("i", "j").agg(F.sum("part").alias("part")).collect()
    mean, cov = np.zeros(m), np.zeros((m, m))
    for r in rows:
        if r["i"] < 0:
            mean[r["j"]] = r["part"] / w.n
        else:
            cov[r["i"], r["j"]] = r["part"] / w.n
    return float(np.abs(np.triu(cov - np.outer(mean, mean) - np.eye(m))).max())


def _batch(rows: list[tuple], *names: str, kinds=None) -> pa.RecordBatch:
    kinds = kinds or (pa.int64(),) * len(names)
    columns = zip(*rows, strict=True) if rows else ((),) * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def whiten(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row a usable vector and component: ``id_col``, component (from 1), n, deviation, whitened, explained, identity_error.

    Dropped are null vectors, vectors with null or non-finite entries, with
    entries beyond the longs (2**56 and more), and of another length than most
    have; empty vectors go too. ``deviation`` is a decimal of 38 digits, null beyond. Components
    without variance (fewer vectors than dimensions, constant entries, a
    single row) have a null ``whitened`` and stay out of ``identity_error``.
    Null or repeated ids and repeated rows give their rows each and all count
    in the fit; a table without a usable vector gives an empty result; other
    columns are ignored. Texts do not occur. The fit takes three scans and
    shuffles one row a pair of dimensions and task.
    """
    kind = embeddings.schema[id_col].dataType.simpleString()
    w = fit(embeddings, components, vec_col)
    numbers = "n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if w is None:
        return embeddings.sparkSession.createDataFrame([], f"`{id_col}` {kind}, component int, {numbers}")
    held, d, k = embeddings.sparkSession.sparkContext.broadcast(w), len(w.sums), len(w.eigenvalues)

    def run(batches):
        for ids, x in _matrices(batches, d):
            values = held.value.project(x)
            flat = pa.array(values.ravel(), pa.float64(), mask=np.isnan(values.ravel()))
            lists = pa.ListArray.from_arrays(np.arange(0, values.size + 1, k, dtype=np.int32), flat)
            told = pa.array([str(v) if v < 10 ** 38 else None for v in held.value.deviations(x)], pa.string())
            yield pa.RecordBatch.from_arrays([ids, told, lists], names=["id", "deviation", "values"])

    rows = embeddings.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")) \
        .mapInArrow(run, f"id {kind}, deviation string, values array<double>")
    explained = F.element_at(F.array(*map(F.lit, w.explained)), F.col("pos") + 1)
    return rows.select("id", "deviation", F.posexplode("values").alias("pos", "value")).select(
        F.col("id").alias(id_col), (F.col("pos") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"),
        F.col("deviation").cast("decimal(38,0)").alias("deviation"), F.col("value").alias("whitened"),
        explained.alias("explained"), F.lit(w.identity_error).alias("identity_error"))
