"""What a cleaning changed, and the totals that show it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import SPEC, PanelSpec, dimension, require_rows


def total(c: str) -> Column:
    """Sum with 0 for no value at all."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def in_year(df: DataFrame, year: int, spec: PanelSpec = SPEC) -> DataFrame:
    """Rows of one calendar year, as a range of times that reaches the scan."""
    t = F.col(spec.time_col)
    day = lambda y: F.lit(f"{y}-01-01").cast("timestamp_ntz")
    return df.where((t >= day(year)) & (t < day(year + 1)))


def daily_totals(df: DataFrame, spec: PanelSpec = SPEC, dims: Sequence[str] = ("product", "store", "country")) -> DataFrame:
    """Totals of each time by each of ``dims`` in one pass: columns time, dimension, member, total."""
    sets = [[F.col(spec.time_col), F.col(d)] for d in dims]
    known = df.where(" and ".join([f"{spec.time_col} is not null"]))
    g = known.groupingSets(sets, F.col(spec.time_col), *[F.col(d) for d in dims]).agg(total(spec.target_col).alias("total"), *[F.grouping(d).alias(f"__{d}") for d in dims])
    name, member = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dims:
        name, member = F.when(F.col(f"__{d}") == 0, d).otherwise(name), F.when(F.col(f"__{d}") == 0, F.col(d)).otherwise(member)
    return g.select(spec.time_col, name.alias("dimension"), member.alias("member"), "total").where("member is not null")


def daily_total_all(df: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """One series: the total of all series at each time."""
    return df.where(F.col(spec.time_col).isNotNull()).groupBy(spec.time_col).agg(total(spec.target_col).alias("total"))


def daily_before_after(before: DataFrame, after: DataFrame, year: int, spec: PanelSpec = SPEC, by: str = "country") -> DataFrame:
    """Daily totals by ``by`` in one year, of both tables, told apart by ``variant``."""

    def one(df: DataFrame, variant: str) -> DataFrame:
        d = in_year(df, year, spec).where(F.col(by).isNotNull()).groupBy(spec.time_col, by)
        return d.agg(total(spec.target_col).alias("total")).withColumn("variant", F.lit(variant))

    return one(before, "aligned").unionByName(one(after, "cleaned"))


def daily_totals_of(df: DataFrame, variants: dict[str, str], year: int, spec: PanelSpec = SPEC, by: str = "country") -> DataFrame:
    """``daily_before_after`` of columns of one table, {column: variant}: one pass and one shuffle."""
    d = in_year(df, year, spec).where(F.col(by).isNotNull()).groupBy(spec.time_col, by)
    d = d.agg(*[total(c).alias(v) for c, v in variants.items()])
    return d.unpivot([spec.time_col, by], list(variants.values()), "variant", "total").select(spec.time_col, by, "total", "variant")


def differences_within(df: DataFrame, before: str, spec: PanelSpec = SPEC, year: int | None = None) -> DataFrame:
    """``differences`` where the target before stands beside the one after, in the column ``before``: no join."""
    d = in_year(df, year, spec) if year is not None else df
    d = d.where(spec.has_key() & F.col(spec.time_col).isNotNull())
    after = F.col(spec.target_col)
    return d.select(spec.time_col, *spec.id_cols, F.col(before).alias("before"), after.alias("after"), (after - F.col(before)).alias("diff"))


def differences(before: DataFrame, after: DataFrame, spec: PanelSpec = SPEC, year: int | None = None, check: bool = False) -> DataFrame:
    """Rows of both tables by time and series: target before, after and diff (after - before).

    ``check`` makes tables without a common row a ValueError.
    """
    keys, y = [spec.time_col, *spec.id_cols], spec.target_col
    a, b = (in_year(d, year, spec) if year is not None else d for d in (before, after))
    a = a.select(*keys, F.col(y).alias("before"))
    b = b.select(*keys, F.col(y).alias("after"))
    both = a.join(b, keys).withColumn("diff", F.col("after") - F.col("before"))
    return require_rows(both, "the tables have no time and series in common") if check else both


def change_by_series(diff: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """Total absolute change of every series."""
    return diff.groupBy(*spec.id_cols).agg(F.coalesce(F.sum(F.abs("diff")), F.lit(0.0)).alias("abs_change"))


def most_changed(diff: DataFrame, k: int = 1, spec: PanelSpec = SPEC) -> DataFrame:
    """The ``k`` series with the largest change; ties by id."""
    return change_by_series(diff, spec).orderBy(F.desc("abs_change"), *spec.id_cols).limit(k)


def series_rows(df: DataFrame, keys: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """Rows of the series in ``keys``, in time order; keys are broadcast once counted to be few."""
    ids = list(spec.id_cols)
    return df.join(dimension(keys.select(*ids)), ids, "left_semi").orderBy(spec.time_col, *ids)


def one_series(df: DataFrame, ids: dict) -> DataFrame:
    """Rows whose id columns have the given values (null matches null)."""
    for c, v in ids.items():
        df = df.where(F.col(c).eqNullSafe(F.lit(v)))
    return df
