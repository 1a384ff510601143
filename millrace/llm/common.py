"""Helpers that several corpus operators share: shared storage, text batches, word hashes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path, shared_dir  # noqa: F401

#: Words of the corpus contracts: runs without ASCII white space (Java and DuckDB regex syntax).
WORD = r"[^\x20\x09-\x0D]+"

#: Tables written in the scopes that are open now in this thread or task, innermost last.
_scopes: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("_scopes", default=())


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end what was materialized within, but for what was to be kept: for steps whose
    result is written by then."""
    own: list[DataFrame] = []
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(token)
        for df in own:
            discard(df)


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there and a lost
    executor costs only the tasks that it ran.  ``keep`` outlives the scope around it, and
    falls to the scope around that."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.millrace_path = path
    at, scopes = -2 if keep else -1, _scopes.get()
    if len(scopes) >= -at:
        scopes[at].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a ``materialize``d table that nothing will read again."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.millrace_path)
    path.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text) -> F.Column:
    """Array of words of a text column; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text) -> F.Column:
    """Number of words of a text column, without building them: ends of words are counted."""
    t = F.coalesce(text, F.lit(""))
    # Every run of word characters becomes one mark, then white space goes.
    marks = F.regexp_replace(F.regexp_replace(t, WORD, "x"), r"[\x20\x09-\x0D]+", "")
    return F.length(marks).cast("long")


#: Key lists up to so many rows are broadcast; longer ones are joined by shuffling.
BROADCAST_ROWS = 400_000


def checked(keys: DataFrame) -> DataFrame:
    """``keys``, to be broadcast if they were counted to be few."""
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(keys) if few else keys


def only(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is among ``keys``, which are broadcast if they are few."""
    return df.join(checked(keys), on, "left_semi")


def without(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is not among ``keys``."""
    return df.join(checked(keys), on, "left_anti")


def slices(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of rows of about ``max_bytes`` (one row at least).

    Yields (first row, end row, bytes, offsets of the rows in them); nulls are empty.
    The bytes stay a view of Arrow's buffer, so memory does not grow with the batch.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random numbers; a longer run starts with the shorter one."""
    step = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(step + np.uint64(seed * 0x632BE59BD9B4E019 % 2**64))


_POWERS = random64(4096, 11)


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of several texts at once, lower-cased (A-Z) if ``fold``.

    Returns (hashes, row of each word, start byte, end byte).  The hash is a
    multilinear sum of the word's bytes with fixed random multipliers, mixed.
    """
    global _POWERS
    none = np.zeros(0, np.int64)
    if not len(data):
        return none.astype(np.uint64), none, none, none
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = inside & (~before | edge[:-1])
    starts = np.flatnonzero(first)
    if not len(starts):
        return none.astype(np.uint64), none, none, none
    at = np.flatnonzero(inside)
    where = np.searchsorted(at, starts)
    lengths = np.diff(np.append(where, len(at)))
    longest = int(lengths.max())
    if longest > len(_POWERS):
        _POWERS = random64(longest * 2, 11)
    pos = np.arange(len(at)) - np.repeat(where, lengths)
    terms = ((_LOWER[data[at]] if fold else data[at].astype(np.uint64)) + np.uint64(1)) * _POWERS[pos]
    h = mix64(np.add.reduceat(terms, where) + lengths.astype(np.uint64))
    rows = np.searchsorted(offsets, starts, "right") - 1
    return h, rows, starts, starts + lengths


def per_batch(df: DataFrame, fn, schema) -> DataFrame:
    """mapInArrow with ``fn(batch) -> iterator of RecordBatch``."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from fn(b)

    return df.mapInArrow(run, schema)
