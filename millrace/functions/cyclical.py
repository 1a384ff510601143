"""Sine and cosine encodings of calendar positions, in local time."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import SPEC, PanelSpec, coerce_time, require

# Positions in a cycle, from 0, and the cycles' lengths.
PERIODS = {"dow": 7, "month": 12, "doy": 366, "week": 53, "hour": 24}
NAMES = tuple(PERIODS)


def cycle_index(name: str, t: Column) -> Column:
    """Position of a time in the cycle ``name``; ValueError if there is no such cycle."""
    found = {"dow": lambda: F.weekday(t), "month": lambda: F.month(t) - 1, "doy": lambda: F.dayofyear(t) - 1, "week": lambda: F.weekofyear(t) - 1, "hour": lambda: F.hour(t)}
    if name not in found:
        raise ValueError(f"unknown cycle {name!r}; known: {', '.join(PERIODS)}")
    return found[name]()


def local_time(df: DataFrame, column: str, zone: str | None) -> Column:
    """Wall-clock time in ``zone``; times without zone are UTC, None leaves them as they are."""
    if zone is None:
        return F.col(column)
    if isinstance(df.schema[column].dataType, T.TimestampType):
        return F.convert_timezone(F.current_timezone(), F.lit(zone), F.col(column).cast("timestamp_ntz"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(column))


def cyclical_features(df: DataFrame, spec: PanelSpec = SPEC, names: Sequence[str] = NAMES, zone: str | None = "Europe/Berlin", strict: bool = False, drop_source_cols: bool = True) -> DataFrame:
    """Adds cyc_{name}_sin and cyc_{name}_cos (and cyc_{name}_idx if ``drop_source_cols`` is off).

    Midnight in UTC is 1 or 2 o'clock in Berlin, so daily data shows summer time in the hour.
    """
    require(df, (spec.time_col,))
    d = coerce_time(df, spec.time_col, strict)
    t = local_time(d, spec.time_col, zone)
    new = {}
    for name in names:
        idx = cycle_index(name, t)
        if not drop_source_cols:
            new[f"cyc_{name}_idx"] = idx
        angle = F.lit(2 * math.pi) * (idx / F.lit(float(PERIODS[name])))
        new |= {f"cyc_{name}_sin": F.sin(angle), f"cyc_{name}_cos": F.cos(angle)}
    return d.withColumns(new)
