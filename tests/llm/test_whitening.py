"""Whitening against a covariance in exact fractions and numpy's own solver."""

from fractions import Fraction

import numpy as np
import pytest

from millrace.llm import whitening

EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def embeddings(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], EMBEDDINGS)


def exact(vectors):
    """(integers, sums, covariance) of float vectors, the covariance in fractions."""
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    mean = [Fraction(t, n) for t in s]
    cov = np.array([[float(sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / n) for j in range(d)] for i in range(d)])
    return np.array(x), s, cov


def test_whitening_equals_exact_covariance(spark, stored):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(150, 10)) * (1 + np.arange(10))
    rows = [(i, v) for i, v in enumerate(vectors)] + [(900, None), (901, [1] * 9 + [None]), (902, [float("nan")] + [0] * 9), (903, [float("inf")] + [0] * 9)]
    rows += [(7, vectors[7]), (None, vectors[8]), (904, [])]
    used = [v for i, v in rows if i is None or i < 900]
    x, s, cov = exact(used)
    n = len(used)
    values, q = np.linalg.eigh(cov)
    order = np.argsort(-values)[:8]
    got = whitening.op13_whitening(spark, stored(embeddings=embeddings(spark, rows))).toPandas()
    assert len(got) == n * 8 and set(got["n"]) == {n}
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-10
    want = (x - np.array([t / n for t in s])) @ q[:, order] / np.sqrt(values[order])
    deviation = [sum((n * int(c) - t) ** 2 for c, t in zip(r, s, strict=True)) for r in x]
    key = lambda v: sorted(v)
    assert key(got[got.component == 1]["deviation"]) == key(deviation)
    by = dict(zip(deviation, want, strict=True))
    signs = np.zeros(8)
    for r in got.itertuples():
        w = by[r.deviation][r.component - 1]
        if abs(w) > 1e-3 and not signs[r.component - 1]:
            signs[r.component - 1] = np.sign(w * r.whitened)
    for r in got.itertuples():
        assert abs(r.whitened - signs[r.component - 1] * by[r.deviation][r.component - 1]) < 1e-8
        assert abs(r.explained / (values[order][r.component - 1] / np.trace(cov)) - 1) < 1e-10


@pytest.mark.parametrize("rows, variances", [([(1, [1, 2])], 0), ([(1, [1, 2]), (2, [1, 2])], 0), ([(1, [1, 2]), (2, [3, 2]), (3, [4, 2])], 1)])
def test_components_without_variance_are_null(spark, stored, rows, variances):
    got = whitening.op13_whitening(spark, stored(embeddings=embeddings(spark, rows))).toPandas()
    assert len(got) == 2 * len(rows)
    assert got.groupby("vec_id")["whitened"].count().tolist() == [variances] * len(rows)
    assert (got["identity_error"].notna().all() and got["identity_error"].max() < 1e-12) if variances else got["identity_error"].isna().all()


def test_lengths_are_fits_of_their_own(spark, stored):
    rows = [(1, [1, 2, 3]), (2, [2, 2, 5]), (3, [0, 1]), (4, [4, 3]), (5, [1, 9])]
    got = whitening.op13_whitening(spark, stored(embeddings=embeddings(spark, rows))).toPandas()
    assert got.groupby("vec_id")["n"].first().to_dict() == {1: 2, 2: 2, 3: 3, 4: 3, 5: 3}


def test_a_large_offset_costs_no_digits(spark):
    """Two columns that differ by a few units above 2**50."""
    rng = np.random.default_rng(5)
    x = rng.integers(-9, 10, (200, 3)) + (1 << 50)
    df = spark.createDataFrame([(i, [int(c) for c in r]) for i, r in enumerate(x)], "vec_id long, v array<long>")
    known = whitening.sums(df)
    assert known[3] == (200, [int(c) for c in x.astype(object).sum(0)])
    cov = whitening.covariance(df, known)[3]
    assert np.abs(cov - np.cov((x - (1 << 50)).T, bias=True)).max() < 1e-12


def test_wide_spreads_and_sums_beyond_a_long(spark):
    df = spark.createDataFrame([(i, [(1 << 62) - 1, 0]) for i in range(8)], "vec_id long, v array<long>")
    assert whitening.sums(df)[2] == (8, [8 * ((1 << 62) - 1), 0])
    models = {2: whitening.Whitener(1 << 30, [0, 0], np.eye(2), np.eye(2), np.ones(2), np.ones(2))}
    far = spark.createDataFrame([(1, [1 << 30, 3])], "vec_id long, v array<long>")
    assert int(whitening.whitened(far, models).first()["deviation"]) == (1 << 60) * ((1 << 60) + 9)


@pytest.mark.parametrize("values", [10.0 ** -np.arange(20), np.ones(12), np.r_[np.ones(5), 1 + 1e-9 * np.arange(5), 1 + 1e-13 * np.arange(4), 2.0], np.r_[np.zeros(6), np.arange(1.0, 6)]])
def test_correction_reaches_double_precision(values):
    """Also where eigenvalues cluster closer than float32, or float64, can tell."""
    rng = np.random.default_rng(len(values))
    q = np.linalg.qr(rng.normal(size=(len(values),) * 2))[0].astype(np.longdouble)
    for _ in range(3):
        q = q + q @ (np.eye(len(q)) - q.T @ q) / 2
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    got, x = whitening.eigenvectors(a)
    assert np.abs(x.T @ x - np.eye(len(q))).max() < 1e-16
    assert np.abs(a @ x - x * got).max() < 1e-16 * values.max()
    assert np.abs(np.sort(values)[::-1] - got).max() < 1e-16 * values.max()


def test_float32_alone_is_not_enough():
    """The correction does the work: its start is a thousand times worse."""
    a = np.cov(np.random.default_rng(1).normal(size=(20, 500)))
    start = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    error = lambda x: np.abs(x.T @ a @ x - np.diag(np.diag(x.T @ a @ x))).max()
    assert error(whitening.corrected(a.astype(np.longdouble), start)[1]) < 1e-3 * error(start)


def test_too_many_entries_are_refused(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MAX_ENTRIES", 8)
    with pytest.raises(ValueError, match="entries"):
        whitening.fitted(spark.createDataFrame([(1, [1, 2, 3])], "vec_id long, v array<long>"))
