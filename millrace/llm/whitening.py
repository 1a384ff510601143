"""Whitening of embeddings by eigenvectors that are found in float32 and corrected in higher precision.

Tasks sum the vectors and then the products of their differences from the rounded means, both
in integers, so the covariance is exact up to its last rounding, whatever the vectors' offset.
Its eigenvectors come from float32 and are corrected by Ogita-Aishima iterations, which are
matrix products alone, in numpy's longest float.  Eigenvalues that lie too close for an
iteration are a cluster: the covariance, shifted by the cluster's mean and restricted to the span of its
vectors, is solved by itself, where the small gaps are large.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import materialize, scratch, table

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Entries of all covariance matrices together (one for each length of vectors) that the driver takes.
MAX_ENTRIES = 1 << 24
#: Iterations at most; each about squares the error.
STEPS = 12
Real = np.longdouble


def integers(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * c) + offset of vectors that are whole, finite and not empty.

    A component that no long can hold is an error.
    """
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    good = F.col(vec_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    long = lambda x: F.when(F.abs(x) < F.lit(2.0**62), F.floor(x)).otherwise(F.raise_error(F.lit("a component is beyond a long")).cast("long"))
    ints = F.transform(v, lambda x: long(x * F.lit(float(scale))).cast("long") + F.lit(offset))
    return df.where(good & (F.size(vec_col) > 0)).select(F.col(id_col).alias("vec_id"), ints.alias("v"))


def _by_length(batch: pa.RecordBatch, column: str):
    """(row numbers, matrix of int64) for each length of vectors in a batch."""
    v = batch.column(column)
    sizes = np.diff(v.offsets.to_numpy())
    flat = v.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[(ends[rows] - d)[:, None] + np.arange(d)].astype(np.int64, copy=False)


def _added(parts: DataFrame) -> list:
    """Rows (dim, i, total array): the sum of the arrays of each key (dim, i, s array<long>), in Python's integers.

    Every task sends an array for each key; a task that adds up streams those of its keys.
    """
    kind = pa.decimal128(38, 0)

    def add(batches):
        found: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for d, i, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = np.array(s, object)
                found[d, i] = found[d, i] + s if (d, i) in found else s
        if found:
            total = pa.array([[pa.scalar(int(x)).cast(kind) if abs(x) < 1 << 63 else pa.scalar(str(x)).cast(kind) for x in s] for s in found.values()], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int32()), pa.array([i for _, i in found], pa.int32()), total], ["dim", "i", "total"])

    return parts.repartition("dim", "i").mapInArrow(add, "dim int, i int, total array<decimal(38,0)>").collect()


def sums(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """{length: (rows, sum for each dimension)}, exact."""

    def task(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for _, m in _by_length(b, "v"):
                large = int(np.abs(m).max()) * len(m) >= 1 << 62
                s = np.append(m.astype(object).sum(0) if large else m.sum(0), len(m)).astype(object)
                total[m.shape[1]] = total.get(m.shape[1], 0) + s
        for d, s in total.items():
            # A sum of any size in two longs.
            low = [int(x) & (1 << 62) - 1 for x in s]
            for i, part in enumerate((low, [int(x) >> 62 for x in s])):
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([i], pa.int32()), pa.array([part], pa.list_(pa.int64()))], ["dim", "i", "s"])

    out: dict[int, list[int]] = {}
    for r in _added(vectors.select("v").mapInArrow(task, "dim int, i int, s array<long>")):
        t = [int(x) << 62 if r["i"] else int(x) for x in r["total"]]
        out[r["dim"]] = [a + b for a, b in zip(out[r["dim"]], t, strict=True)] if r["dim"] in out else t
    return {d: (s[-1], s[:-1]) for d, s in out.items()}


def covariance(vectors: DataFrame, known: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """{length: covariance, divisor n} of (v array<long>), whose ``sums`` are known.

    Products are of differences from the rounded means; what rounding left is taken off exactly.
    Differences of 2**30 or more are an error.
    """
    middle = {d: np.array([x // n for x in s], np.int64) for d, (n, s) in known.items()}

    def task(batches):
        found: dict[int, list] = {}

        def out(d):
            g, _ = found.pop(d)
            cols = [pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.FixedSizeListArray.from_arrays(g.ravel(), d).cast(pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, ["dim", "i", "s"])

        for b in batches:
            for _, m in _by_length(b, "v"):
                d = m.shape[1]
                m = m - middle[d]
                most = int(np.abs(m).max())
                if most >= 1 << 30:
                    raise OverflowError("components lie 2**30 or more from their mean")
                step = max(1, min(len(m), (1 << 53) // max(1, most * most)))
                for lo in range(0, len(m), step):
                    x = m[lo : lo + step]
                    bound = most * most * len(x)
                    # Products of floats are exact while no sum passes 2**53.
                    g = (x.T.astype(np.float64) @ x.astype(np.float64)).astype(np.int64) if bound <= 1 << 53 else x.T @ x
                    if d in found and found[d][1] + bound >= 1 << 62:
                        yield out(d)
                    had = found.get(d, (0, 0))
                    found[d] = (had[0] + g, had[1] + bound)
        for d in list(found):
            yield out(d)

    gram = {d: np.zeros((d, d), object) for d in known}
    for r in _added(vectors.select("v").mapInArrow(task, "dim int, i int, s array<long>")):
        gram[r["dim"]][r["i"]] = [int(x) for x in r["total"]]
    cov = {}
    for d, (n, s) in known.items():
        rest = np.array([x - n * int(c) for x, c in zip(s, middle[d], strict=True)], object)
        exact = n * gram[d] - np.multiply.outer(rest, rest)
        cov[d] = np.array([[Real(x) for x in row] for row in exact], Real) / Real(n) / Real(n)
    return cov


def corrected(a: np.ndarray, x: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of a symmetric matrix, by correcting approximate ones.

    A step has X'X, X'AX and one product with the correction.  Pairs whose eigenvalues lie within the
    step's own error are only made orthogonal; clusters of them are solved by themselves.
    """
    n, eye = len(a), np.eye(len(a), dtype=Real)
    norm = np.sqrt((a * a).sum())
    if not norm:
        return np.zeros(n, Real), eye
    before = np.inf
    for _ in range(steps):
        r, s = eye - x.T @ x, x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        near = 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum()))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > near
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        order = np.argsort(values)
        edges = np.flatnonzero(np.diff(values[order]) > near) + 1
        for cluster in np.split(order, edges):
            if len(cluster) > 1:
                # Within the cluster's span the shifted matrix is as small as the gaps: float64 tells them apart.
                own = x[:, cluster]
                shifted = own.T @ (a @ own - values[cluster].mean() * own)
                size = np.abs(shifted).max()
                if size > 0:
                    turn = np.linalg.eigh(((shifted + shifted.T) / (2 * size)).astype(np.float64))[1]
                    x[:, cluster] = own @ turn.astype(Real)
        moved = np.abs(e).max()
        if moved < np.finfo(Real).eps * n or moved >= before and moved < 1e-12:
            break
        before = moved
    for _ in range(2):  # turns within a narrow cluster leave their squares
        x = x + x @ (eye - x.T @ x) / 2
    r, s = eye - x.T @ x, x.T @ (a @ x)
    return np.diag(s) / (1 - np.diag(r)), x


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors in columns) by falling eigenvalue; the largest entry of a vector is positive."""
    size = np.abs(a).max() or Real(1)
    start = np.linalg.eigh((a / size).astype(np.float32))[1].astype(Real)
    values, x = corrected(a / size, start)
    order = np.argsort(-values, kind="stable")
    values, x = values[order] * size, x[:, order]
    x = x / np.sqrt((x * x).sum(0))
    return values, x * np.where(np.take_along_axis(x, np.abs(x).argmax(0)[None], 0) < 0, -1, 1)


@dataclass
class Whitener:
    """What turns vectors of one length into whitened components."""

    n: int
    sums: list[int]
    #: Components in columns; scaled has them divided by the root of their eigenvalue, NaN where that is 0.
    components: np.ndarray
    scaled: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def apply(self, m: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """(whitened, deviations) of rows of integers."""
        middle = np.array([x // self.n for x in self.sums], np.int64)
        rest = np.array([x - self.n * int(c) for x, c in zip(self.sums, middle, strict=True)], np.int64)
        d = m - middle
        w = (d - rest / self.n) @ self.scaled
        if (self.n * (int(np.abs(d).max()) + 1)) ** 2 * d.shape[1] < 1 << 62:
            return w, ((self.n * d - rest) ** 2).sum(1).tolist()
        return w, ((self.n * d.astype(object) - rest.astype(object)) ** 2).sum(1).tolist()


def fitted(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitener]:
    """{length: Whitener} of all rows of (v array<long>); a component whose eigenvalue is 0 up to rounding
    has no whitened values.  ValueError if the matrices have more than ``MAX_ENTRIES`` entries."""
    known = sums(vectors)
    if sum(d * d for d in known) > MAX_ENTRIES:
        raise ValueError(f"covariance matrices of more than {MAX_ENTRIES} entries: {len(known)} lengths up to {max(known)}")
    out = {}
    for d, cov in covariance(vectors, known).items():
        values, x = eigenvectors(cov)
        trace, k = np.trace(cov), min(components, d)
        values, x = np.maximum(values[:k], 0), x[:, :k]
        flat = values <= trace * d * Real(2) ** -50
        scaled = np.where(flat, np.nan, x / np.sqrt(np.where(flat, 1, values)))
        share = values / trace if trace > 0 else np.full(k, np.nan, Real)
        out[d] = Whitener(*known[d], *(y.astype(np.float64) for y in (x, scaled, values, share)))
    return out


def whitened(vectors: DataFrame, models: dict[int, Whitener]) -> DataFrame:
    """(vec_id, dim, deviation decimal, w array<double>) of rows (vec_id, v array<long>)."""
    shipped = vectors.sparkSession.sparkContext.broadcast(models)
    kind = pa.decimal128(38, 0)

    def run(batches):
        for b in batches:
            for rows, m in _by_length(b, "v"):
                w, deviation = shipped.value[m.shape[1]].apply(m)
                w = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel(), from_pandas=True), w.shape[1]).cast(pa.list_(pa.float64()))
                if max(deviation) >= 10**38:
                    raise OverflowError("a deviation has more than 38 digits")
                exact = pa.array(deviation, pa.int64()).cast(kind) if max(deviation) < 1 << 63 else pa.array([str(x) for x in deviation]).cast(kind)
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(rows)), pa.array(np.full(len(rows), m.shape[1], np.int32)), exact, w], ["vec_id", "dim", "deviation", "w"])

    schema = vectors.select("vec_id").schema.add("dim", "integer").add("deviation", "decimal(38,0)").add("w", ArrayType(DoubleType()))
    return vectors.select("vec_id", "v").mapInArrow(run, schema)


def identity_errors(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(dim, identity_error): the largest entry of |covariance - identity| of the whitened rows of each length."""
    at = lambda i: F.get("w", F.lit(i))
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    cov = [F.covar_pop(at(i), at(j)).alias(f"c{i}_{j}") for i, j in pairs]
    return rows.groupBy("dim").agg(*cov).select("dim", F.array_max(F.array(*[F.abs(F.col(f"c{i}_{j}") - float(i == j)) for i, j in pairs])).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight whitened components of every row of ``embeddings`` that has a whole, finite vector.

    Rows with a null vector, or null or non-finite components, and empty vectors give no rows.
    Vectors of each length are a fit list of their own.  Rows that repeat a vec_id, or lack one, count and
    come out each.  A component without variance has a null ``whitened``; a single vector, or equal ones, have
    only such, and no identity error.  A deviation beyond a long is an error.  An empty table
    gives no rows.  Extra columns are not read.
    """
    with scratch():
        vectors = materialize(integers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "whitening-vectors")
        models = fitted(vectors)
        rows = materialize(whitened(vectors, models), "whitened", keep=True)
    # One row for each length of vectors, of which MAX_ENTRIES leaves few.
    facts = spark.createDataFrame([(d, m.n, [None if x != x else float(x) for x in m.explained]) for d, m in models.items()], "dim int, n long, explained array<double>")
    out = rows.join(F.broadcast(facts), "dim").join(F.broadcast(materialize(identity_errors(rows), "identity")), "dim")
    each = F.posexplode("w").alias("at", "whitened")
    out = out.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "explained", "identity_error", each)
    return out.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error")
