"""Long series in ranges of rows, so that one series takes more than one task.

Rows are sorted by series and time across tasks and written once; the place of a row in its
series is its place in its task plus the rows of the series in the tasks before, so no task sees a
whole series.  A range has so many consecutive rows of a series, and copies of the rows before
and after it that a step looks back and ahead at; the copies are dropped after the step.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..spec import SPEC, PanelSpec, dimension, require
from ..storage import stored

#: Rows of a range.
RANGE_ROWS = 1_000_000
RANGE, OWN = "__range", "__own"


def positions(df: DataFrame, spec: PanelSpec = SPEC, into: str = "__at") -> DataFrame:
    """``df``, written, with the place of each row in its series from 0: by time, nulls last."""
    require(df, (spec.time_col, *spec.id_cols))
    ids = list(spec.id_cols)
    order = [*[F.col(c).asc_nulls_first() for c in ids], F.col(spec.time_col).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in spec.tiebreak]]
    d = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # Ids count the rows of a task, whose number stands above 33 bits.
    d = stored(d.withColumn("__id", F.monotonically_increasing_id()), "sorted")
    task = F.shiftright("__id", 33)
    parts = d.groupBy(*ids, task.alias("__task")).agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*ids).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(ids)], F.col("__task"), (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    on = task == F.col("__task")
    for i, c in enumerate(ids):
        on = on & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return d.join(dimension(parts), on).withColumn(into, F.col("__id") + F.col("__shift")).select(*df.columns, into)


def in_ranges(df: DataFrame, spec: PanelSpec = SPEC, before: int = 0, after: int = 0, rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``__range``, the number of a range of the series, and ``__own``: rows stand in their own range, and
    as copies in those that look back ``before`` rows or ahead ``after`` rows at them."""
    rows = max(rows, before, after, 1)
    d = positions(df, spec)
    n, at = F.floor(F.col("__at") / rows).cast("long"), F.col("__at") % rows
    copies = [F.struct(n.alias(RANGE), F.lit(True).alias(OWN))]
    if before:
        copies.append(F.when(at >= rows - before, F.struct((n + 1).alias(RANGE), F.lit(False).alias(OWN))))
    if after:
        copies.append(F.when((at < after) & (n > 0), F.struct((n - 1).alias(RANGE), F.lit(False).alias(OWN))))
    each = F.explode(F.filter(F.array(*copies), lambda x: x.isNotNull())).alias("__copy")
    return d.select(*df.columns, each).select(*df.columns, f"__copy.{RANGE}", f"__copy.{OWN}")


def by_ranges(df: DataFrame, step: Callable[[DataFrame, PanelSpec], DataFrame], spec: PanelSpec = SPEC, before: int = 0, after: int = 0, rows: int = RANGE_ROWS) -> DataFrame:
    """``step(df, spec)`` on ranges of the series instead of whole ones, with the same result.

    The step must keep its rows, with the columns that it does not know (``__own``), and look back
    ``before`` rows and ahead ``after`` rows at most, all its parts together: lags of 14 rows after two
    fills of 2 x 365 rows look back 1,474.
    """
    d = step(in_ranges(df, spec, before, after, rows), replace(spec, id_cols=(*spec.id_cols, RANGE)))
    return d.where(OWN).drop(RANGE, OWN)
