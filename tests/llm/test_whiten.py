"""Whitening against numpy's eigenvectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tutorlake.llm import whiten

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, n int, component int, at int, v double"


@pytest.fixture
def vectors(spark):
    """Make an embeddings table, with columns of clashing names, from (vec_id, vector) rows."""
    return lambda rows, schema=SCHEMA: spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 0.5) for r in rows], schema).repartition(3)


def check(df, rows):
    """All columns against plain numpy over the usable rows."""
    good = [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(np.float32(c)) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in good], object)
    n, sums = len(good), x.sum(0)
    y = (n * x - sums).astype(float) / n
    cov = y.T @ y / n
    values, comps = np.linalg.eigh(cov)
    rank = int((values > values.max() * 1e-11).sum())
    k = min(8, rank)
    got = df.collect()
    assert len(got) == n * k
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(r)
    dev = sorted(((n * x - sums) ** 2).sum(1).tolist())
    for c in range(1, k + 1):
        e, u = values[-c], comps[:, -c]
        mine = by[c]
        assert sorted(r["deviation"] for r in mine) == dev and {r["n"] for r in mine} == {n}
        assert all(abs(r["explained"] - e / np.trace(cov)) <= 1e-9 * r["explained"] for r in mine)
        assert sorted((r["vec_id"] for r in mine), key=str) == sorted((q for q, _ in good), key=str)
        if (np.delete(np.abs(values - e), len(values) - c) > 1e-6 * e).all():  # told apart
            want = y @ u / np.sqrt(e)
            have = np.array([r["whitened"] for r in sorted(mine, key=lambda r: r["vec_id"])])
            want = want[np.argsort([q for q, _ in good], kind="stable")]
            assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-7
    assert all(r["identity_error"] < 1e-9 for r in got) and len({r["identity_error"] for r in got}) == 1


def test_whiten(vectors):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) * 0.2 + rng.normal(size=12)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    check(whiten.whiten(vectors(rows)), rows)


def test_odd_vectors(vectors):
    """Nulls, non-finite entries and empty vectors go; repeated keys and vectors stay."""
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 5)))]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, None), (103, [1.0, None, 0.0, 0.0, 0.0]), (104, [1.0, float("nan"), 0.0, 0.0, 0.0]), (105, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (106, []), (107, [1e4, -1e4, 0.0, 3.0, 0.0])]
    check(whiten.whiten(vectors(rows)), rows)


def test_rank_below_the_number_of_components(vectors):
    rng = np.random.default_rng(3)
    base = np.floor(rng.normal(size=(50, 3)) * 100)
    rows = [(i, [*v.tolist(), float(v.sum()), 7.0, float(v[0]), 0.0, 1.0, 2.0, -float(v[2])]) for i, v in enumerate(base / 1024)]
    check(whiten.whiten(vectors(rows)), rows)


def test_none_one_and_equal_vectors(vectors):
    assert whiten.whiten(vectors([])).count() == 0
    assert whiten.whiten(vectors([(1, None), (2, [])])).count() == 0
    assert whiten.whiten(vectors([(1, [0.1, 0.2])])).count() == 0
    assert whiten.whiten(vectors([(i, [0.1, 0.2]) for i in range(5)])).count() == 0
    with pytest.raises(ValueError, match="entries"):
        whiten.whiten(vectors([(1, [0.1, 0.2]), (2, [0.1])]))


def test_large_entries_are_exact(vectors):
    """Sums beyond 53 and 64 bits; a deviation beyond 64 bits is null."""
    rows = [(i, [float(i * 2**24), float(i % 3) * 2**30]) for i in range(20)]
    got = {r["vec_id"]: r for r in whiten.whiten(vectors(rows)).where("component = 1").collect()}
    x = np.array([[int(c) * 1024 + 100_000 for c in v] for _, v in rows], object)
    dev = ((20 * x - x.sum(0)) ** 2).sum(1)
    assert [got[i]["deviation"] for i in range(20)] == [d if d < 2**63 else None for d in dev] and got[0]["identity_error"] < 1e-9
    n, sums, cov = whiten.moments(vectors(rows).select(whiten.integers(F.col("embedding")).alias("x")))
    y = x - x.mean(0)
    assert n == 20 and sums == x.sum(0).tolist() and np.allclose(cov, (y.T @ y / 20).astype(float), rtol=1e-12)


def test_factors():
    """The triangular factor gives the matrix back; its turned columns are eigenvectors."""
    rng = np.random.default_rng(4)
    for d, r in ((1, 1), (2, 2), (7, 7), (9, 4), (40, 40)):
        m = rng.normal(size=(d, r)) * 10.0 ** rng.integers(-3, 3, size=r)
        a = m @ m.T
        factor = whiten.pivoted_cholesky(a)
        assert factor.shape[1] == r and np.allclose(factor @ factor.T, a, atol=1e-12 * np.trace(a))
        values, comps = whiten.one_sided_jacobi(factor)
        assert np.allclose(comps.T @ comps, np.eye(r), atol=1e-8)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:r], rtol=1e-10, atol=1e-13 * np.trace(a)) and (np.diff(values) <= 0).all()
    assert whiten.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)
