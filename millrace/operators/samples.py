"""Feature roles and sliding training samples."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import SPEC, PanelSpec, dimension, require
from .ranges import OWN, RANGE, RANGE_ROWS, in_ranges
from .split import softplus_inverse

# Calendar columns that are known in advance, in a fixed order.
CALENDAR_COLS = ("year", "month", "day", "dayofweek", "weekofyear", "is_weekend")
ENCODER, DECODER = 28, 7


@dataclass
class FeatureRoles:
    """Column names by the role they play for a forecaster."""

    static_categoricals: list[str] = field(default_factory=list)
    known_reals: list[str] = field(default_factory=list)
    unknown_reals: list[str] = field(default_factory=list)

    def columns(self) -> list[str]:
        return list(dict.fromkeys([*self.static_categoricals, *self.known_reals, *self.unknown_reals]))


def feature_roles(df: DataFrame, spec: PanelSpec = SPEC, known_prefixes: Sequence[str] = ("cyc_",), lag_prefixes: Sequence[str] = ("lag_",), holiday_prefixes: Sequence[str] = ("is_holiday",), calendar_known: bool = True, flag_cols: Sequence[str] = ("is_lockdown_period",)) -> FeatureRoles:
    """Roles by name and type; runs no job.

    Known: cyclical columns, the calendar, holidays, flags of any type, then the time index.
    Unknown: the target, other numbers, then lags.  Numbers include booleans.
    """
    require(df, (spec.time_col, spec.target_col, *spec.id_cols))
    numeric = [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    starts = lambda prefixes: [c for c in numeric if c.startswith(tuple(prefixes))]
    known = starts(known_prefixes)
    if calendar_known:
        known += [c for c in CALENDAR_COLS if c in numeric] + starts(holiday_prefixes) + [c for c in flag_cols if c in df.columns]
    known = list(dict.fromkeys(known + ["time_idx"] * ("time_idx" in numeric)))
    lags = starts(lag_prefixes)
    taken = {spec.target_col, *known, *spec.id_cols, *lags}
    unknown = [spec.target_col] * (spec.target_col in numeric) + [c for c in numeric if c not in taken] + lags
    return FeatureRoles([c for c in spec.id_cols if c in df.columns], known, unknown)


def training_samples(df: DataFrame, spec: PanelSpec = SPEC, within: Sequence[str] = ("split",), encoder: int = ENCODER, decoder: int = DECODER, time_idx: str = "time_idx", stride: int = 1, roles: FeatureRoles | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Sliding samples of ``encoder`` past and ``decoder`` future targets for each series.

    One row for each sample: ``within`` and id columns, the time index of the first future
    step, encoder and decoder arrays.  With ``roles``, encoder_{c} of every known and unknown real and
    decoder_{c} of every known one stand beside them, missing values as null.  A sample's
    indexes are consecutive and lie in one part (``within``); a missing target leaves no sample.
    ``stride`` keeps every so many indexes; ``carry`` names columns of the last past step to be kept.
    """
    keys, y = [*within, *spec.id_cols], spec.target_col
    known = [c for c in (roles.known_reals if roles else []) if c != y]
    reals = known + [c for c in (roles.unknown_reals if roles else []) if c != y]
    require(df, (*keys, time_idx, y, *reals))
    # Names of their own: a role may be an id or the time index as well.
    fields = {"target": y} | {c: c for c in dict.fromkeys(reals)}
    value = lambda c: F.col(fields[c]).try_cast("float").alias(c)
    rows = df.select(*keys, *carry, F.col(time_idx).alias("__at"), F.struct(value("target"), *[value(c) for c in dict.fromkeys(known)]).alias("__next"), F.struct(*[value(c) for c in fields]).alias("__row"))
    w = Window.partitionBy(*keys).orderBy(F.col("__at").asc_nulls_last())
    past, future, whole = w.rowsBetween(-(encoder - 1), 0), w.rowsBetween(1, decoder), w.rowsBetween(-(encoder - 1), decoder)
    d = rows.select(
        *keys, *carry, (F.col("__at") + 1).alias(time_idx),
        F.collect_list("__row").over(past).alias("__enc"), F.collect_list("__next").over(future).alias("__dec"),
        (F.max("__at").over(whole) - F.min("__at").over(whole)).alias("__span"),
        F.count("__at").over(whole).alias("__n"), F.count("__row.target").over(whole).alias("__set"),
    )
    n = encoder + decoder
    d = d.where((F.col("__n") == n) & (F.col("__set") == n) & (F.col("__span") == n - 1) & spec.has_key())
    if stride > 1:
        d = d.where(F.col(time_idx) % stride == 0)
    arrays = [F.col("__enc.target").alias("encoder"), F.col("__dec.target").alias("decoder")]
    arrays += [F.col("__enc")[c].alias(f"encoder_{c}") for c in dict.fromkeys(reals)] + [F.col("__dec")[c].alias(f"decoder_{c}") for c in dict.fromkeys(known)]
    return d.select(*keys, *carry, time_idx, *arrays)


def samples_by_ranges(df: DataFrame, spec: PanelSpec = SPEC, within: Sequence[str] = ("split",), encoder: int = ENCODER, decoder: int = DECODER, time_idx: str = "time_idx", rows: int = RANGE_ROWS, **options) -> DataFrame:
    """``training_samples``, with a series in more than one task: its ranges overlap by the length of a sample."""
    keys = [*within, *spec.id_cols]
    d = in_ranges(df, PanelSpec(time_idx, tuple(keys), spec.target_col, (spec.time_col,)), encoder - 1, decoder, rows)
    own = replace(spec, id_cols=(*spec.id_cols, RANGE))
    d = training_samples(d, own, within, encoder, decoder, time_idx, carry=(OWN,), **options)
    return d.where(OWN).drop(RANGE, OWN)


def normalize_samples(samples: DataFrame, normalizer: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """``samples`` with center and scale of their series (``split.series_normalizer``) and the targets
    under them: encoder and decoder become (z(y) - center) / scale, null where any of these is."""
    d = samples.join(dimension(normalizer.select(*spec.id_cols, "center", "scale")), list(spec.id_cols), "left")
    scaled = lambda c: F.transform(c, lambda y: F.try_divide(softplus_inverse(y.cast("double")) - F.col("center"), F.col("scale")))
    return d.withColumns({c: scaled(c) for c in ("encoder", "decoder")})
