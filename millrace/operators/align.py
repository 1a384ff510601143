"""Levels of years brought to those of a reference year."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..spec import SPEC, PanelSpec, coerce_time, dimension, require


def year_means(df: DataFrame, spec: PanelSpec = SPEC, by: str = "country", into: str = "mean") -> DataFrame:
    """Mean target for each (``by``, year), nulls skipped; rows without either key drop out."""
    d = coerce_time(df, spec.time_col)
    d = d.select(by, F.year(spec.time_col).alias("year"), F.col(spec.target_col).alias("__y"))
    return d.where(F.col(by).isNotNull() & F.col("year").isNotNull()).groupBy(by, "year").agg(F.avg("__y").alias(into))


def level_stats(df: DataFrame, spec: PanelSpec = SPEC, by: str = "country") -> DataFrame:
    """(``by``, year, mean, first): mean target and first time of all rows, also of those without a key, in one pass."""
    d = coerce_time(df, spec.time_col)
    d = d.select(by, F.year(spec.time_col).alias("year"), F.col(spec.target_col).alias("__y"), F.col(spec.time_col).alias("__t"))
    return d.groupBy(by, "year").agg(F.avg("__y").alias("mean"), F.min("__t").alias("first"))


def level_factors(df: DataFrame | None, reference_year: int, spec: PanelSpec = SPEC, by: str = "country", stats: DataFrame | None = None) -> DataFrame:
    """factor = mean of the reference year / mean of the year; 1 for the reference year, and where
    either mean is missing or the year's mean is 0.

    One pass over the facts, none if their ``level_stats`` are given; the reference mean reaches the other years
    over the grouped rows.
    """
    means = year_means(df, spec, by) if stats is None else stats.where(F.col(by).isNotNull() & F.col("year").isNotNull())
    is_ref = F.col("year") == reference_year
    ref = F.max(F.when(is_ref, F.col("mean"))).over(Window.partitionBy(by))
    ratio = F.coalesce(F.try_divide(ref, "mean"), F.lit(1.0))
    return means.select(by, "year", F.when(is_ref, 1.0).otherwise(ratio).alias("factor"))


def align(df: DataFrame, reference_year: int, spec: PanelSpec = SPEC, by: str = "country", stats: DataFrame | None = None) -> DataFrame:
    """Adds ``year`` and multiplies the target by its factor; no factor leaves it as it is.

    The facts are not shuffled: the factors, one row for each (``by``, year), are broadcast
    once counted.  ``stats`` are the ``level_stats`` of ``df``, if they are known.
    """
    require(df, (by, spec.time_col, spec.target_col))
    d = coerce_time(df, spec.time_col)
    factors = dimension(level_factors(d, reference_year, spec, by, stats))
    d = d.withColumn("year", F.year(spec.time_col)).join(factors, [by, "year"], "left")
    scaled = F.col(spec.target_col).cast("double") * F.coalesce("factor", F.lit(1.0))
    rest = [c for c in df.columns if c != "year"]
    return d.withColumn(spec.target_col, scaled).select(*rest, "year")


def alignment_means(raw: DataFrame, aligned: DataFrame, spec: PanelSpec = SPEC, by: str = "country") -> DataFrame:
    """Mean target of each (``by``, year) before and after: columns aligned and raw."""
    both = year_means(aligned, spec, by).withColumn("variant", F.lit("aligned"))
    both = both.unionByName(year_means(raw, spec, by).withColumn("variant", F.lit("raw")))
    return both.groupBy(by, "year").pivot("variant", ["aligned", "raw"]).agg(F.avg("mean"))
