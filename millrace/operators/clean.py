"""Outliers and masked periods, imputed from the same series in earlier seasons."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import SPEC, PanelSpec, coerce_time, require

FLAG = "is_lockdown_period"


def default_flag(df: DataFrame, flag: str = FLAG) -> DataFrame:
    """Adds ``flag`` as 0 if the column is absent."""
    return df if flag in df.columns else df.withColumn(flag, F.lit(0))


def null_on_date(df: DataFrame, date: str | dt.datetime, spec: PanelSpec = SPEC) -> DataFrame:
    """The target becomes null at exactly one time, in all series."""
    hit = F.col(spec.time_col) == F.lit(str(date)).cast("timestamp_ntz")
    return df.withColumn(spec.target_col, F.when(F.coalesce(hit, F.lit(False)), None).otherwise(F.col(spec.target_col)))


def mask_period(df: DataFrame, year: int, months: Sequence[int], spec: PanelSpec = SPEC, flag: str = FLAG) -> DataFrame:
    """In some months of a year ``flag`` becomes 1 and the target null."""
    hit = (F.year(spec.time_col) == year) & F.month(spec.time_col).isin(*months)
    hit = F.coalesce(hit, F.lit(False))
    y = spec.target_col
    return df.withColumns({flag: F.when(hit, 1).otherwise(F.col(flag)).cast("int"), y: F.when(hit, None).otherwise(F.col(y))})


def fill_seasonal(df: DataFrame, spec: PanelSpec = SPEC, period: int = 365, repeats: int = 3) -> DataFrame:
    """Null targets become the mean of the series' values ``period`` rows, 2 ``period`` rows, ... earlier.

    ``repeats`` counts the row itself, which adds nothing.  Rows are counted, not days; values
    are read as they were before the filling; without any earlier value, or a key, null stays.
    """
    w, y = spec.window(), F.col(spec.target_col)
    lags = [F.when(spec.has_key(), F.lag(spec.target_col, period * k).over(w)) for k in range(1, repeats)]
    if not lags:
        return df
    names = [f"__lag_{k}" for k in range(len(lags))]
    d = df.withColumns(dict(zip(names, lags, strict=True)))
    total, n = F.lit(0.0), F.lit(0)
    for c in names:
        total, n = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0)), n + F.col(c).isNotNull().cast("int")
    return d.withColumn(spec.target_col, F.coalesce(y.cast("double"), F.try_divide(total, n))).drop(*names)


def clean(df: DataFrame, outlier_date: str, period_year: int, period_months: Sequence[int], spec: PanelSpec = SPEC, period: int = 365, repeats: int = 3, flag: str = FLAG) -> DataFrame:
    """Outlier out, filled; then the period masked and flagged, filled.

    The second filling sees what the first has filled; the flag stays.
    """
    require(df, (spec.time_col, *spec.id_cols, spec.target_col))
    d = default_flag(coerce_time(df, spec.time_col), flag)
    d = fill_seasonal(null_on_date(d, outlier_date, spec), spec, period, repeats)
    return fill_seasonal(mask_period(d, period_year, period_months, spec, flag), spec, period, repeats)
