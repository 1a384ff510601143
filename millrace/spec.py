"""What a panel is: one row for each (series, time), and how steps address it."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import stored


@dataclass(frozen=True)
class PanelSpec:
    """Column names of a panel.  ``tiebreak`` orders rows of one series and time, if there are any."""

    time_col: str = "date"
    id_cols: tuple[str, ...] = ("country", "store", "product")
    target_col: str = "num_sold"
    tiebreak: tuple[str, ...] = ()

    def window(self) -> WindowSpec:
        """Rows of one series in time order, nulls last: every step uses this one, so one
        shuffle serves all of them."""
        order = [F.col(self.time_col).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in self.tiebreak]]
        return Window.partitionBy(*self.id_cols).orderBy(*order)

    def has_key(self) -> Column:
        """Whether all id columns are set; rows with a null key belong to no series."""
        out = F.lit(True)
        for c in self.id_cols:
            out = out & F.col(c).isNotNull()
        return out


SPEC = PanelSpec()


def require(df: DataFrame, columns: Iterable[str]) -> None:
    """KeyError if columns are missing; runs no job."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every float column, so that one kind of missing value is left."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def coerce_time(df: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """Makes ``column`` a timestamp without zone; typed columns stay as they are.

    Unreadable text becomes null, or an error if ``strict``.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return df
    if isinstance(kind, T.DateType) or strict:
        return df.withColumn(column, F.col(column).cast("timestamp_ntz"))
    return df.withColumn(column, F.col(column).try_cast("timestamp_ntz"))


def to_float32(df: DataFrame, column: str) -> DataFrame:
    """``column`` as float for training; what is no number becomes null."""
    return df.withColumn(column, F.col(column).try_cast("float"))


#: Rows up to which a grouped result counts as a dimension.
DIMENSION_ROWS = 100_000


def dimension(df: DataFrame, most: int = DIMENSION_ROWS) -> DataFrame:
    """A grouped result, computed once and written; to be broadcast if its count is ``most`` rows
    or fewer, left to a shuffled join if it is larger."""
    kept = stored(df, "dimension")
    return F.broadcast(kept) if kept.count() <= most else kept


def check_unique(df: DataFrame, keys: Iterable[str]) -> None:
    """ValueError if rows share a key: a join on it would multiply rows.  Null keys match nothing."""
    keys = list(keys)
    set_ = df.dropna(subset=keys)
    if not set_.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").isEmpty():
        raise ValueError(f"rows share a key of {keys}")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """``df``, or a ValueError if it has no rows."""
    if df.isEmpty():
        raise ValueError(f"no rows: {what}")
    return df


def column_report(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(column, present, n_set) of required columns: whether each is there, and its values that are set."""
    columns = list(columns)
    one = lambda c: F.count(c) if c in df.columns else F.lit(0).cast("long")
    rows = df.agg(*[one(c).alias(f"__{i}") for i, c in enumerate(columns)])
    items = [F.struct(F.lit(c).alias("column"), F.lit(c in df.columns).alias("present"), F.col(f"__{i}").alias("n_set")) for i, c in enumerate(columns)]
    return rows.select(F.explode(F.array(*items)).alias("r")).select("r.*")
