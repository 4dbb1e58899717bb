"""Operator 13 against exact fractions and plain numpy."""

import math
from fractions import Fraction

import numpy as np
import pytest

from kpiloom.llm import queries, whitening
from kpiloom.llm.whitening import fit, limbs, whiten

SCHEMA = "vec_id long, embedding array<double>, n string, component double"


def frame(spark, vectors, parts=3):
    rows = [(i, v, "x", 0.5) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def plain(vectors):
    """Integers, sums and covariance by fractions, and whitened values by eigh of that covariance."""
    x = [[math.floor(64 * c) + 1000000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    cov = [[sum(Fraction(n * r[i] - s[i], n) * Fraction(n * r[j] - s[j], n) for r in x) / n for j in range(d)] for i in range(d)]
    return x, s, cov


def normal(n=120, d=6, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) @ rng.normal(size=(d, d))).tolist()


def test_covariance_is_exact_and_rows_are_white(spark):
    vectors = normal()
    vectors += vectors[:5]  # repeated rows count
    x, s, cov = plain(vectors)
    df = frame(spark, vectors)
    w = fit(df)
    assert (w.n, w.sums, w.covariance) == (len(x), s, cov)
    got = {}
    for r in whiten(df).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    n, d = len(x), 6
    assert len(got) == n and all(sorted(g) == list(range(1, d + 1)) for g in got.values())
    white = np.array([[got[i][k].whitened for k in range(1, d + 1)] for i in range(n)])
    assert np.abs(white.T @ white / n - np.eye(d)).max() < 1e-9
    v = np.array([[float(c) for c in r] for r in cov])
    e = np.linalg.eigvalsh(v)[::-1]
    for i in range(n):
        assert int(got[i][1].deviation) == sum((n * a - b) ** 2 for a, b in zip(x[i], s))
        assert got[i][1].identity_error < 1e-9
    assert np.allclose([got[0][k].explained for k in range(1, d + 1)], e / e.sum(), rtol=1e-9)
    # whitened values are the centred integers on unit eigenvectors of V
    centred = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(r, s)] for r in x])
    for k in range(d):
        axis = np.linalg.lstsq(centred, white[:, k] * np.sqrt(e[k]), rcond=None)[0]
        assert abs(np.linalg.norm(axis) - 1) < 1e-9 and np.allclose(v @ axis, e[k] * axis, atol=1e-6 * e[0])


def test_unusable_vectors_go(spark):
    good = normal(40, 3)
    bad = [None, [1.0, None, 2.0], [1.0, math.nan, 2.0], [math.inf, 0.0, 0.0], [1.0], [], [1e30, 0.0, 0.0]]
    rows = [(None if i == 3 else i, v, None, None) for i, v in enumerate(good + bad)]
    out = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 40 * 3 and {r.n for r in out} == {40}
    assert sum(r.vec_id is None for r in out) == 3


@pytest.mark.parametrize("vectors", [[], [None], [[]], [[math.nan, 1.0]]])
def test_no_usable_vector(spark, vectors):
    out = whiten(frame(spark, vectors, 1))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_flat_components_have_no_value(spark):
    one = whiten(frame(spark, [[0.5, 0.25]])).collect()
    assert [(r.component, r.whitened, r.explained, r.identity_error) for r in sorted(one, key=lambda r: r.component)] == \
        [(1, None, 0.0, 0.0), (2, None, 0.0, 0.0)]
    line = whiten(frame(spark, [[i / 2, float(i), 7.0] for i in range(20)])).collect()
    assert {r.component for r in line if r.whitened is None} == {2, 3} and max(r.identity_error for r in line) < 1e-9
    assert abs(next(r.explained for r in line if r.component == 1) - 1) < 1e-12


def test_at_most_the_asked_components(spark):
    vectors = normal(100, 40, 3)
    assert {r.component for r in whiten(frame(spark, vectors)).select("component").distinct().collect()} == set(range(1, 33))


def test_large_entries_stay_exact(spark):
    vectors = [[1e12 + i * 3.0, -2e12 * i, 0.5] for i in range(15)]
    x, s, cov = plain(vectors)
    w = fit(frame(spark, vectors))
    assert (w.sums, w.covariance) == (s, cov)
    assert w.deviations(np.array(x)) == [sum((15 * a - b) ** 2 for a, b in zip(r, s)) for r in x]


def test_limbs():
    for v in (0, 1, -1, 5, -5, 2 ** 40, -2 ** 40, 2 ** 200 + 17, -2 ** 200 - 17):
        assert sum(p << whitening.LIMB * k for k, p in limbs(v)) == v
        assert all(abs(p) <= 2 ** whitening.LIMB for _, p in limbs(v))


def test_query(spark):
    out = queries.op13_whitening(spark, "/root/testdata/sf0.001")
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert dict(out.dtypes)["deviation"] == "bigint" and out.count() == 32 * table.count()
    x, s, cov = plain([r.embedding for r in table.collect()])
    trace = float(sum(cov[i][i] for i in range(len(s))))
    e = np.sort(np.linalg.eigvalsh(np.array([[float(c) for c in r] for r in cov])))[::-1]
    assert np.allclose([r.explained for r in out.select("component", "explained").distinct().orderBy("component").collect()], e[:32] / trace)
