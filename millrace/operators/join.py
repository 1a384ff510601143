"""Joins with checks: a dimension of the user's own, forecasts with what came."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import SPEC, PanelSpec, check_unique, dimension, require


def many_to_one(facts: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """All rows of ``facts`` with the columns of their one row in ``table``, null where there is none.

    ValueError if rows of ``table`` share a key.
    """
    require(facts, on)
    require(table, on)
    check_unique(table, on)
    return facts.join(dimension(table), list(on), "left")


def with_forecasts(actual: DataFrame, forecast: DataFrame, spec: PanelSpec = SPEC, yhat: str = "yhat", y: str = "y") -> DataFrame:
    """Rows of ``actual`` that have a forecast of their time and series, the target as ``y``.

    ValueError if forecasts share a time and series.
    """
    keys = [spec.time_col, *spec.id_cols]
    require(forecast, (*keys, yhat))
    check_unique(forecast, keys)
    return actual.withColumnRenamed(spec.target_col, y).join(forecast.select(*keys, F.col(yhat)), keys)
