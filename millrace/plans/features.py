"""Raw sales to a feature table, and on to splits and samples, as one plan each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import calendar_features, holiday_features, time_index
from ..functions.cyclical import cyclical_features
from ..operators.align import align, level_stats
from ..operators.clean import clean
from ..operators.lags import LAGS, ROLLING, lag_features
from ..operators.samples import training_samples
from ..operators.split import RATIOS, assign_split, boundaries
from ..spec import SPEC, PanelSpec, coerce_time
from ..storage import stored


def feature_table(raw: DataFrame, reference_year: int, outlier_date: str, period_year: int, period_months: Sequence[int], spec: PanelSpec = SPEC, zone: str | None = "Europe/Berlin", lags: Sequence[int] = LAGS, rolling: Sequence[tuple[int, str]] = ROLLING) -> DataFrame:
    """Align, clean, calendar, holidays, time index, cyclical encodings, lags.

    The facts are shuffled once, by series; factors and the first time are
    broadcast, and all windows share that shuffle's order.  ``raw`` is read twice (levels and first
    time, features): store it first if it is not a table.
    """
    raw = coerce_time(raw, spec.time_col)
    stats = stored(level_stats(raw, spec), "levels")
    d = align(raw, reference_year, spec, stats=stats)
    d = clean(d, outlier_date, period_year, period_months, spec)
    d = calendar_features(d, spec)
    d = time_index(d, spec, first=stats.select(F.col("first").alias(spec.time_col)))
    d = holiday_features(d, spec)
    d = cyclical_features(d, spec, zone=zone)
    return lag_features(d, spec, lags, rolling)


def sample_table(features: DataFrame, spec: PanelSpec = SPEC, ratios: Sequence[float] = RATIOS, **options) -> DataFrame:
    """Training samples of each part of a split by ratios."""
    val, test = boundaries(features, spec, ratios)
    return training_samples(assign_split(features, val, test, spec), spec, **options)
