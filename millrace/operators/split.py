"""Splits by time, their checks, and scaling learnt from the training part alone."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import SPEC, PanelSpec, dimension, require

RATIOS = (0.8, 0.1, 0.1)
SPLITS = ("train", "val", "test")


def boundaries(df: DataFrame, spec: PanelSpec = SPEC, ratios: Sequence[float] | None = RATIOS, val_start=None, test_start=None) -> tuple:
    """(first time of val, first time of test).

    Two fixed times win over ratios.  Ratios are positions among all rows by time, nulls
    last; the time at a position opens its part, so equal times never part.
    """
    if val_start is not None and test_start is not None:
        if not val_start < test_start:
            raise ValueError("val_start must be before test_start")
        return val_start, test_start
    if ratios is None:
        raise ValueError("give ratios, or both val_start and test_start")
    if len(ratios) != 3 or abs(sum(ratios) - 1.0) > 1e-6:
        raise ValueError("three ratios with the sum 1 are needed")

    def positions(n: int) -> tuple[int, int]:
        if n < 10:
            raise ValueError("at least 10 rows are needed for a split by ratios")
        at_val = max(1, math.floor(n * float(ratios[0])))
        return at_val, min(n - 1, max(at_val + 1, math.floor(n * float(ratios[0] + ratios[1]))))

    v, t = times_at(df, spec.time_col, (float(ratios[0]), float(ratios[0] + ratios[1])), positions)
    if v is None or t is None or not v < t:
        raise ValueError("the parts' first times coincide; use other ratios or fixed times")
    return v, t


#: A sketch's ranks are off by a share of 1 / ACCURACY of all rows at most.  Brackets reach out to one of these shares.
ACCURACY = 50_000
REACH = (*(2 / ACCURACY * 10**k for k in range(5)), 1.0)


def times_at(df: DataFrame, t: str, shares: Sequence[float], positions: Callable[[int], Sequence[int]]) -> list:
    """Times at positions (from 0) of all rows by time, nulls last.

    ``positions`` gives them for the number of rows, close to ``shares`` of it.  Two scans: a mergeable quantile
    sketch brackets each position, then the rows outside the brackets, and those of each time inside, are counted.
    The times inside, a share of 4 / ACCURACY of all rows for each position, are ordered by one task; the driver
    gets one row.  Should the sketch have missed a position, wider brackets are counted.
    """
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    zoned = isinstance(df.schema[t].dataType, T.TimestampType)
    micros = F.unix_micros(t) if zoned else F.timestamp_diff("MICROSECOND", epoch, F.col(t).cast("timestamp_ntz"))
    at = df.select(F.col(t).alias("t"), F.coalesce(micros, F.lit((1 << 63) - 1)).alias("x"))
    probes = [min(1.0, max(0.0, f + sign * r)) for r in REACH for f in shares for sign in (-1, 1)]
    sketch = F.percentile_approx("x", F.array(*map(F.lit, probes)), ACCURACY)
    r = at.agg(F.count(F.lit(1)).alias("n"), sketch.alias("q")).first()
    wanted = positions(r["n"])
    for k, reach in enumerate(REACH):
        if reach * r["n"] < 4 and k + 1 < len(REACH):
            continue
        q = r["q"][2 * len(shares) * k : 2 * len(shares) * (k + 1)]
        # Regions by rising time: before the first bracket, inside it, after it, ...; brackets that meet are one.
        brackets: list[list] = []
        for lo, hi in sorted(zip(q[::2], q[1::2], strict=True)):
            # The sketch holds doubles, which round numbers beyond 2**53.
            lo, hi = lo - (abs(lo) >> 51), min(hi + (abs(hi) >> 51), (1 << 63) - 1)
            if brackets and lo <= brackets[-1][1]:
                brackets[-1][1] = max(hi, brackets[-1][1])
            else:
                brackets.append([lo, hi])
        region = F.lit(2 * len(brackets))
        for i, (lo, hi) in reversed(list(enumerate(brackets))):
            region = F.when(F.col("x") < lo, 2 * i).when(F.col("x") <= hi, 2 * i + 1).otherwise(region)
        c = at.withColumn("region", region)
        c = c.groupBy("region", F.when(F.col("region") % 2 == 1, F.col("x")).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t"))
        c = c.withColumn("upto", F.sum("n").over(Window.orderBy("region", "x").rowsBetween(Window.unboundedPreceding, 0)))
        found = c.agg(*[F.min(F.when(F.col("upto") > p, F.struct("region", "x", "t"))).alias(f"p{i}") for i, p in enumerate(wanted)]).first()
        if all(f is not None and f["region"] % 2 == 1 for f in found):
            return [f["t"] for f in found]
    raise IndexError("a position is beyond the rows")


def assign_split(df: DataFrame, val_start, test_start, spec: PanelSpec = SPEC, into: str = "split") -> DataFrame:
    """Adds the part of each row: before val_start, before test_start, from then on; rows
    without a time drop out."""
    t = F.col(spec.time_col)
    lit = lambda x: F.lit(x).cast("timestamp_ntz")
    part = F.when(t < lit(val_start), "train").when(t < lit(test_start), "val").when(t >= lit(test_start), "test")
    return df.withColumn(into, part).where(F.col(into).isNotNull())


def time_split(df: DataFrame, val_start, test_start, spec: PanelSpec = SPEC) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three parts as tables of their own."""
    d = assign_split(df, val_start, test_start, spec, "__split")
    return tuple(d.where(F.col("__split") == s).drop("__split") for s in SPLITS)


def split_counts(df: DataFrame, spec: PanelSpec = SPEC, split: str = "split") -> DataFrame:
    """Rows, first and last time of every part, in one pass."""
    t = spec.time_col
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"), F.min(t).alias("first_date"), F.max(t).alias("last_date"))


def leakage(df: DataFrame, spec: PanelSpec = SPEC, split: str = "split") -> DataFrame:
    """One row: n_train, n_val, n_test, and whether training ends before val and before test begin
    (null if a part is empty)."""
    t = F.col(spec.time_col)
    own = lambda s: F.when(F.col(split) == s, t)
    counts = [F.count(F.when(F.col(split) == s, 1)).alias(f"n_{s}") for s in SPLITS]
    return df.agg(*counts, *[(F.max(own("train")) < F.min(own(s))).alias(f"train_before_{s}") for s in SPLITS[1:]])


def check_split(df: DataFrame, spec: PanelSpec = SPEC, split: str = "split") -> None:
    """ValueError if a part is empty or training reaches into the others."""
    r = leakage(df, spec, split).first()
    missing = [s for s in SPLITS if not r[f"n_{s}"]]
    if missing:
        raise ValueError(f"empty parts: {missing}")
    for later in SPLITS[1:]:
        if not r[f"train_before_{later}"]:
            raise ValueError(f"train overlaps {later}")


def unseen_series(part: DataFrame, train: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """Series of ``part`` that training never saw."""
    ids = list(spec.id_cols)
    return part.select(*ids).distinct().exceptAll(train.select(*ids).distinct())


def series_stats(train: DataFrame, columns: Sequence[str], spec: PanelSpec = SPEC) -> DataFrame:
    """{c}__mean and {c}__std (of the sample) for each series."""
    aggs = [f(c).alias(f"{c}__{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return train.where(spec.has_key()).groupBy(*spec.id_cols).agg(*aggs)


def series_moments(df: DataFrame, columns: Sequence[str], spec: PanelSpec = SPEC) -> DataFrame:
    """{c}__n, {c}__mean and {c}__m2 (sum of squared differences from the mean) for each series: statistics that
    can be stored and grow with ``merge_moments``."""
    one = lambda c: [F.count(c).alias(f"{c}__n"), F.avg(c).alias(f"{c}__mean"), (F.var_pop(c) * F.count(c)).alias(f"{c}__m2")]
    return df.where(spec.has_key()).groupBy(*spec.id_cols).agg(*[a for c in columns for a in one(c)])


def merge_moments(old: DataFrame, new: DataFrame, columns: Sequence[str], spec: PanelSpec = SPEC) -> DataFrame:
    """Moments of the rows behind two tables of moments, without those rows: one row for each series of either."""

    def merged(a: Column, b: Column) -> Column:
        n, step = a["n"] + b["n"], b["mean"] - a["mean"]
        both = F.struct(n.alias("n"), (a["mean"] + step * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + step * step * a["n"] * b["n"] / n).alias("m2"))
        return F.when(a["n"] == 0, b).when(b["n"] == 0, a).otherwise(both)

    # Two rows of a series at most, as each table has one.
    lists = [F.collect_list(F.struct(F.col(f"{c}__n").alias("n"), F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__m2").alias("m2"))).alias(c) for c in columns]
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("m2"))
    d = old.unionByName(new).groupBy(*spec.id_cols).agg(*lists)
    d = d.withColumns({c: F.aggregate(c, none, merged) for c in columns})
    return d.select(*spec.id_cols, *[F.col(f"{c}.{k}").alias(f"{c}__{k}") for c in columns for k in ("n", "mean", "m2")])


def moment_stats(moments: DataFrame, columns: Sequence[str], spec: PanelSpec = SPEC) -> DataFrame:
    """{c}__mean and {c}__std of moments, as ``series_stats`` has them."""
    std = lambda c: F.when(F.col(f"{c}__n") > 1, F.sqrt(F.col(f"{c}__m2") / (F.col(f"{c}__n") - 1))).alias(f"{c}__std")
    return moments.select(*spec.id_cols, *[x for c in columns for x in (F.col(f"{c}__mean"), std(c))])


def scale_with(df: DataFrame, stats: DataFrame, columns: Sequence[str], spec: PanelSpec = SPEC) -> DataFrame:
    """(x - mean) / std of each row's own series in ``stats``; a std of 0 or unknown, and other series, give null."""
    require(df, (*spec.id_cols, *columns))
    d = df.join(dimension(stats), list(spec.id_cols), "left")
    z = {c: F.try_divide(F.col(c) - F.col(f"{c}__mean"), F.nullif(F.col(f"{c}__std"), F.lit(0.0))) for c in columns}
    return d.withColumns(z).select(*df.columns)


def scale_by_series(df: DataFrame, train: DataFrame, columns: Sequence[str], spec: PanelSpec = SPEC) -> DataFrame:
    """(x - mean) / std of each row's own series in ``train``.

    A std of 0 or unknown, and series that training never saw, give null.
    """
    return scale_with(df, series_stats(train, columns, spec), columns, spec)


def softplus_inverse(y: Column) -> Column:
    """ln(exp(y) - 1) for 0 < y <= 10 and y itself above, where both agree to 5e-5; null for y <= 0."""
    return F.when(y > 10, y.cast("double")).when(y > 0, F.log(F.expm1(y)))


def series_normalizer(train: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """Center and scale of each series' target under the inverse of softplus.

    scale is the sample's standard deviation, null where it is 0.
    """
    z = softplus_inverse(F.col(spec.target_col))
    stats = train.where(spec.has_key()).withColumn("__z", z).groupBy(*spec.id_cols)
    return stats.agg(F.avg("__z").alias("center"), F.nullif(F.stddev_samp("__z"), F.lit(0.0)).alias("scale"), F.count("__z").alias("n"))


def check_parts(parts: dict) -> None:
    """``check_split`` on what ``io.write_splits`` has seen: no scan."""
    missing = [s for s in SPLITS if not parts[s]["rows"]]
    if missing:
        raise ValueError(f"empty parts: {missing}")
    for later in SPLITS[1:]:
        if not parts["train"]["last"] < parts[later]["first"]:
            raise ValueError(f"train overlaps {later}")


def manifest_of(spark: SparkSession, parts: dict, val_start, test_start, spec: PanelSpec = SPEC, source: str = "", output_dir: str = "", scaled_cols: Sequence[str] = ()) -> DataFrame:
    """``split_manifest`` from what ``io.write_splits`` has seen: no scan."""
    numbers = F.struct(*[F.lit(parts[s]["rows"]).cast("long").alias(s) for s in SPLITS]).alias("rows")
    return _manifest(spark.range(1).select(numbers), val_start, test_start, spec, source, output_dir, scaled_cols)


def split_manifest(df: DataFrame, val_start, test_start, spec: PanelSpec = SPEC, split: str = "split", source: str = "", output_dir: str = "", scaled_cols: Sequence[str] = ()) -> DataFrame:
    """One row that describes a split."""
    count = lambda s: F.count(F.when(F.col(split) == s, 1)).alias(s)
    rows = df.agg(F.struct(*[count(s) for s in SPLITS]).alias("rows"))
    return _manifest(rows, val_start, test_start, spec, source, output_dir, scaled_cols)


def _manifest(rows: DataFrame, val_start, test_start, spec: PanelSpec, source: str, output_dir: str, scaled_cols: Sequence[str]) -> DataFrame:
    text = lambda x: F.date_format(F.lit(x).cast("timestamp_ntz"), "yyyy-MM-dd")
    names = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return rows.select(
        F.lit(spec.time_col).alias("time_col"), names(spec.id_cols).alias("id_cols"), F.lit(spec.target_col).alias("target_col"),
        text(val_start).alias("val_start"), text(test_start).alias("test_start"), "rows",
        F.lit(output_dir).alias("output_dir"), F.lit(source).alias("source"), names(scaled_cols).alias("scaled_cols"),
    )
