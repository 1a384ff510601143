"""Readers and writers of the pipeline's tables."""

from __future__ import annotations

import csv
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scoring import nested_summary, run_results
from ..operators.split import SPLITS
from ..spec import SPEC, PanelSpec, dimension, nan_to_null
from ..storage import stored


def read_sales_csv(spark: SparkSession, path: str, spec: PanelSpec = SPEC, extra: T.StructType | None = None) -> DataFrame:
    """Raw sales with a header: times and numbers are read leniently, bad ones become null.

    Columns come by their names in the header; those in neither the spec nor ``extra`` are text.
    """
    raw = spark.read.option("header", True).csv(path)
    return _typed(raw, _kinds(raw, spec, extra))


def _kinds(raw: DataFrame, spec: PanelSpec, extra: T.StructType | None) -> dict[str, T.DataType]:
    kinds = {spec.time_col: T.TimestampNTZType(), spec.target_col: T.DoubleType()} | {f.name: f.dataType for f in extra or []}
    return {c: k for c, k in kinds.items() if c in raw.columns}


def _typed(raw: DataFrame, kinds: dict[str, T.DataType]) -> DataFrame:
    return nan_to_null(raw.withColumns({c: F.col(c).try_cast(k) for c, k in kinds.items()}))


def read_checked_csv(spark: SparkSession, path: str, spec: PanelSpec = SPEC, extra: T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """``read_sales_csv`` and what it could not read: (rows, rejects).

    rejects has (column, raw, n): a text that is no value of its column's type, and its rows.  One pass reads
    the file and writes both, so neither reads it again.
    """
    raw = spark.read.option("header", True).csv(path)
    kinds = _kinds(raw, spec, extra)
    bad = [F.when(F.col(c).isNotNull() & F.col(c).try_cast(k).isNull(), F.struct(F.lit(c).alias("column"), F.col(c).alias("raw"))) for c, k in kinds.items()]
    both = _typed(raw.withColumn("__bad", F.filter(F.array(*bad), lambda x: x.isNotNull())), kinds)
    both = stored(both, "checked")
    rejects = both.where(F.size("__bad") > 0).select(F.explode("__bad").alias("b")).groupBy("b.column", "b.raw").agg(F.count(F.lit(1)).alias("n"))
    return both.drop("__bad"), rejects


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stage table by its suffix: .parquet, .pq or .csv in any case."""
    suffix = re.search(r"\.([A-Za-z]+)/?$", path)
    kind = suffix[1].lower() if suffix else ""
    if kind in ("parquet", "pq"):
        return spark.read.parquet(path)
    if kind == "csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    raise ValueError(f"unsupported suffix: {path}")


def _replaced(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Writes beside ``path``, and only then puts the new table in its place: what is at ``path`` can be read
    by the writing itself, and stays if that fails."""
    conf = spark.sparkContext._jsc.sc().hadoopConfiguration()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    beside = lambda kind: at.getParent().suffix(f"/_{at.getName()}.{kind}-{uuid.uuid4().hex}")
    new, old = beside("new"), beside("old")
    try:
        write(new.toString())
    except BaseException:
        fs.delete(new, True)
        raise
    had = fs.exists(at)
    if had and not fs.rename(at, old):
        raise OSError(f"cannot move {path}")
    if not fs.rename(new, at):
        if had:
            fs.rename(old, at)
        raise OSError(f"cannot put the new table at {path}")
    if had:
        fs.delete(old, True)


def write_table(df: DataFrame, path: str, sort_by: tuple[str, ...] = ()) -> None:
    """Writes a stage table in place of what is there, rows sorted within files if asked for.

    ``df`` may read the table that it replaces, which stays as it is if the writing fails.
    """
    d = df.sortWithinPartitions(*sort_by) if sort_by else df
    _replaced(df.sparkSession, path, d.write.parquet)


def write_splits(df: DataFrame, path: str, spec: PanelSpec = SPEC, split: str = "split") -> dict:
    """One folder for each part below ``path`` (split=train, ...), written in one pass.

    What the pass has seen comes back: {part: {"rows", "first", "last"}}, so counts, manifest and
    checks need no scan of their own.
    """
    seen, t = Observation(), F.col(spec.time_col)
    own = lambda s, x: F.when(F.col(split) == s, x)
    facts = [f(own(s, x)).alias(f"{s}_{n}") for s in SPLITS for n, f, x in (("rows", F.count, 1), ("first", F.min, t), ("last", F.max, t))]
    d = df.where(F.col(split).isin(*SPLITS)).observe(seen, *facts)
    _replaced(df.sparkSession, path, d.write.partitionBy(split).parquet)
    return {s: {n: seen.get[f"{s}_{n}"] for n in ("rows", "first", "last")} for s in SPLITS}


def write_json(df: DataFrame, path: str) -> None:
    """Manifests, epoch rows and run summaries as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_comparison(df: DataFrame, path: str) -> None:
    """A comparison of runs as CSV with a header; one row for each run, so one file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


_METRICS = "final_train_loss double, final_val_loss double, best_val_loss double, best_val_epoch int, initial_lr double, final_lr double"
_RESULTS = "results array<struct<epoch int, train_loss double, val_loss double, learning_rate double>>"
_SUMMARY = f"logs_dir string, n_epochs int, metrics struct<{_METRICS}>, meta map<string,string>"


def write_run_results(epochs: DataFrame, path: str, logs_dir: Column | None = None, meta: dict[str, str] | None = None, folders: bool = True) -> None:
    """Results and summary of every run of ``epochs`` (run_id, epoch, train_loss, val_loss, lr) as JSON.

    Below results/ and summary/ each run has a folder of its own (run=<id>) with one object; absent values are left out.
    A folder and two files for each run cost far more than its figures do: without ``folders`` the same objects are
    lines of as many files as there are tasks, for any number of runs.
    """
    epochs = stored(epochs, "epochs")
    for name, d in (("results", run_results(epochs)), ("summary", nested_summary(epochs, logs_dir, meta))):
        d = d.withColumn("run_id", F.col("run_id").cast("string"))
        w = d.withColumn("run", F.col("run_id")).write.partitionBy("run") if folders else d.write
        _replaced(epochs.sparkSession, f"{path}/{name}", w.json)


def read_run_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(run_id, results) and (run_id, logs_dir, n_epochs, metrics, meta) as ``write_run_results`` left them, in either layout."""
    read = lambda name, schema: spark.read.schema(f"run_id string, {schema}").option("recursiveFileLookup", True).json(f"{path}/{name}")
    return read("results", _RESULTS), read("summary", _SUMMARY)


def read_run_logs(spark: SparkSession, pattern: str) -> DataFrame:
    """Run logs, e.g. ".../run_*/metrics.csv", as one table of doubles with run_id and step.

    Headers may differ between files: columns are matched by name, missing ones are null.  run_id is the
    column of that name, so that a file can hold many runs, or else the folder of the file; step is the row's place in
    the file.  Files are read once, as lines; a line's
    place is its place in its split plus the lines of the splits before, so a file may be read by many
    tasks.  The driver gets each distinct header once, however many runs have it.
    """
    lines = spark.read.text(pattern).select(F.col("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    lines = stored(lines.withColumn("id", F.monotonically_increasing_id()).where("trim(value) <> ''"), "lines")
    heads = lines.where("block = 0").groupBy("path").agg(F.min("id").alias("id"), F.min_by("value", "id").alias("head"))
    heads = dimension(heads.select(F.col("path").alias("of"), F.col("id").alias("head_id"), "head"))
    # Rows are numbered by position among the lines of their split that are left.
    place = Window.partitionBy("path", "block").orderBy("id")
    rows = lines.withColumn("row", F.row_number().over(place))
    n = lines.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = n.select(F.col("path").alias("of_"), F.col("block").alias("block_"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rows = rows.join(dimension(offsets), (F.col("path") == F.col("of_")) & (F.col("block") == F.col("block_")))
    rows = rows.join(heads, F.col("path") == F.col("of")).where("id <> head_id")
    rows = rows.select("path", "head", (F.col("row") + F.col("offset") - 1).cast("int").alias("step"), "value")
    out = None
    for r in heads.select("head").distinct().orderBy("head").collect():
        names = [c or f"_c{i}" for i, c in enumerate(next(csv.reader([r["head"].strip("\r")])))]
        parsed = F.from_csv("value", ", ".join(f"`{c}` string" for c in names))
        d = rows.where(F.col("head") == r["head"]).withColumn("v", parsed)
        run = F.col("v.run_id") if "run_id" in names else F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
        d = d.select(run.alias("run_id"), "step", *[F.col(f"v.`{c}`").try_cast("double").alias(c) for c in names if c != "run_id"])
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no run logs: {pattern}")
    return out


def head(df: DataFrame, n: int, order: tuple[str, ...]) -> DataFrame:
    """The first ``n`` rows by ``order``, nulls first."""
    return df.orderBy(*order).limit(n)


def preview(df: DataFrame, n: int = 5, order: tuple[str, ...] = ()) -> tuple[int, list[str], DataFrame]:
    """Row count, column names and the first ``n`` rows by ``order`` (of all columns, if none is given)."""
    return df.count(), df.columns, head(df, n, order or tuple(df.columns))
