"""Lags and rolling statistics of the target within a series, by rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import SPEC, PanelSpec, require

STATS = {
    "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp,
    "median": lambda c: F.percentile(c, 0.5), "count": F.count,
}
LAGS = (1, 7, 14)
ROLLING = ((7, "mean"),)
#: Windows of more rows are put together from blocks, with the same work for each row whatever their width.
WIDE = 64
MERGED = ("mean", "sum", "min", "max", "std", "var", "count")


def lag_features(df: DataFrame, spec: PanelSpec = SPEC, lags: Sequence[int] = LAGS, rolling: Sequence[tuple[int, str]] = ROLLING) -> DataFrame:
    """Adds lag_{n} and, over the ``w`` rows before the current one, lag_{w}_{stat}.

    One earlier value is enough for a statistic; rows without a whole key get nulls.  Windows of more than
    ``WIDE`` rows go by blocks (``block_rolling``), but for the median.
    """
    require(df, (spec.time_col, *spec.id_cols, spec.target_col))
    unknown = [s for _, s in rolling if s not in STATS]
    if unknown:
        raise ValueError(f"unknown statistics {unknown}; known: {', '.join(STATS)}")
    w, ok = spec.window(), spec.has_key()
    new = {f"lag_{n}": F.when(ok, F.lag(spec.target_col, n).over(w)) for n in lags}
    wide = [(n, s) for n, s in rolling if n > WIDE and s in MERGED]
    new |= {f"lag_{n}_{s}": F.when(ok, STATS[s](spec.target_col).over(w.rowsBetween(-n, -1))) for n, s in rolling if (n, s) not in wide}
    d = df.withColumns(new)
    for n in dict.fromkeys(n for n, _ in wide):
        d = block_rolling(d, n, [s for m, s in wide if m == n], spec)
    return d.select(*df.columns, *[f"lag_{n}" for n in lags], *[f"lag_{n}_{s}" for n, s in rolling]) if wide else d


def _merged(a: Column, b: Column) -> Column:
    """Moments (n, mean, m2) and extremes of two sets of rows as those of both."""
    n, step = a["n"] + b["n"], b["mean"] - a["mean"]
    both = F.struct(
        n.alias("n"), (a["mean"] + step * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + step * step * a["n"] * b["n"] / n).alias("m2"),
        (a["total"] + b["total"]).alias("total"), F.least(a["low"], b["low"]).alias("low"), F.greatest(a["high"], b["high"]).alias("high"),
    )
    return F.when(F.coalesce(a["n"], F.lit(0)) == 0, b).when(F.coalesce(b["n"], F.lit(0)) == 0, a).otherwise(both)


def block_rolling(df: DataFrame, width: int, stats: Sequence[str], spec: PanelSpec = SPEC) -> DataFrame:
    """lag_{width}_{stat} over the ``width`` rows before the current one, in constant work for each row.

    A series is cut into blocks of ``width`` rows.  The rows before the current one are the end of one
    block and the start of the next: a running summary from each block's start and one from its end
    are merged.  Nothing is subtracted, so no digits are lost.
    """
    ids, y, ok = list(spec.id_cols), F.col(spec.target_col).cast("double"), spec.has_key()
    d = df.withColumn("__at", F.row_number().over(spec.window()) - 1).withColumn("__block", F.floor(F.col("__at") / width))
    summary = lambda w: F.struct(
        F.count(y).over(w).alias("n"), F.avg(y).over(w).alias("mean"), (F.var_pop(y).over(w) * F.count(y).over(w)).alias("m2"),
        F.sum(y).over(w).alias("total"), F.min(y).over(w).alias("low"), F.max(y).over(w).alias("high"),
    )
    block = Window.partitionBy(*ids, "__block")
    d = d.withColumn("__end", summary(block.orderBy(F.desc("__at")).rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("__start", summary(block.orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)))
    series = Window.partitionBy(*ids).orderBy("__at")
    d = d.withColumns({"__new": F.lag("__start", 1).over(series), "__old": F.lag("__end", width).over(series)})
    # At a block's first row the block before is whole: its running summary is all there is.
    old = F.when(F.col("__at") % width != 0, F.col("__old"))
    d = d.withColumn("__all", F.when(old.isNull(), F.col("__new")).otherwise(_merged(old, F.col("__new"))))
    n = F.coalesce("__all.n", F.lit(0))
    var = F.when(n > 1, F.col("__all.m2") / (n - 1))
    out = {"count": n, "mean": F.col("__all.mean"), "sum": F.col("__all.total"), "min": F.col("__all.low"), "max": F.col("__all.high"), "var": var, "std": F.sqrt(var)}
    kind = df.schema[spec.target_col].dataType
    as_before = {s: c.cast(kind) if s in ("min", "max") else c for s, c in out.items()}
    d = d.withColumns({f"lag_{width}_{s}": F.when(ok, as_before[s]) for s in stats})
    return d.drop("__at", "__block", "__start", "__end", "__new", "__old", "__all")


def fill_lag_gaps(df: DataFrame, columns: Sequence[str] | None = None, spec: PanelSpec = SPEC) -> DataFrame:
    """Null lags take the last value before them in their series, else the first one after."""
    columns = [c for c in df.columns if c.startswith("lag_")] if columns is None else list(columns)
    w = spec.window()
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    # Without a value up to here, the first one after is the first one of the whole series.
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(past), F.first(c, ignorenulls=True).over(whole))
    return df.withColumns({c: F.when(spec.has_key(), fill(c)).otherwise(F.col(c)) for c in columns})
