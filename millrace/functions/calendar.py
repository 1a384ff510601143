"""Calendar columns, the time index, and German public holidays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import SPEC, PanelSpec, coerce_time

# Nation-wide holidays with their first and last year (None: no bound): on (month, day), so many days
# from Easter Sunday, or the last weekday (Monday 0) before (month, day).
FIXED_HOLIDAYS = (
    ("Neujahr", 1, 1, None, None), ("Tag der Arbeit", 5, 1, None, None), ("Tag der deutschen Einheit", 6, 17, 1954, 1990), ("Tag der Deutschen Einheit", 10, 3, 1990, None),
    ("Reformationstag", 10, 31, 2017, 2017), ("1. Weihnachtstag", 12, 25, None, None), ("2. Weihnachtstag", 12, 26, None, None),
)
EASTER_HOLIDAYS = (("Karfreitag", -2, None, None), ("Ostermontag", 1, None, None), ("Christi Himmelfahrt", 39, None, None), ("Pfingstmontag", 50, None, None))
WEEKDAY_HOLIDAYS = (("Bu\u00df- und Bettag", 2, 11, 23, 1981, 1994),)


def calendar_features(df: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """year, month, day, dayofweek (Monday 0), weekofyear (ISO), is_weekend; null dates give nulls."""
    d = coerce_time(df, spec.time_col)
    t = F.col(spec.time_col)
    return d.withColumns({
        "year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "dayofweek": F.weekday(t),
        "weekofyear": F.weekofyear(t), "is_weekend": (F.weekday(t) >= 5).cast("byte"),
    })


def time_index(df: DataFrame, spec: PanelSpec = SPEC, first: DataFrame | None = None) -> DataFrame:
    """``time_idx``: whole days since the first time of ``first`` (or of ``df``), one broadcast row."""
    start = (first if first is not None else df).agg(F.min(spec.time_col).alias("__first"))
    days = F.timestamp_diff("DAY", F.col("__first"), F.col(spec.time_col))
    return df.crossJoin(F.broadcast(start)).withColumn("time_idx", days.cast("long")).drop("__first")


def easter(year: Column) -> Column:
    """Date of Easter Sunday in the Gregorian calendar.

    The age of the moon at the start of the year gives the full moon on or after 21 March;
    Easter is the Sunday after it.
    """
    idiv = lambda a, b: F.floor(a / b)
    golden = F.pmod(year, F.lit(19))
    century = idiv(year, F.lit(100))
    # Lunar and solar corrections of the calendar reform.
    epact = F.pmod(19 * golden + century - idiv(century, F.lit(4)) - idiv(8 * century + 13, F.lit(25)) + 15, F.lit(30))
    late = F.when((epact == 29) | ((epact == 28) & (golden > 10)), 1).otherwise(0)
    full_moon = F.date_add(F.make_date(year, F.lit(3), F.lit(21)), (epact - late).cast("int"))
    return F.next_day(full_moon, "Sun")


def _dates(year: Column) -> list[tuple[str, Column]]:
    """(name, its date in ``year``, null where the rule does not hold) of every rule."""
    sunday = easter(year)
    days = [(n, F.make_date(year, F.lit(m), F.lit(d)), lo, hi) for n, m, d, lo, hi in FIXED_HOLIDAYS]
    days += [(n, F.date_add(sunday, k), lo, hi) for n, k, lo, hi in EASTER_HOLIDAYS]
    for n, weekday, m, d, lo, hi in WEEKDAY_HOLIDAYS:
        day = F.make_date(year, F.lit(m), F.lit(d))
        days.append((n, F.date_sub(day, F.pmod(F.weekday(day) - weekday - 1, F.lit(7)) + 1), lo, hi))
    holds = lambda lo, hi: (F.lit(True) if lo is None else year >= lo) & (F.lit(True) if hi is None else year <= hi)
    return [(n, F.when(holds(lo, hi), day)) for n, day, lo, hi in days]


def holidays(years: DataFrame) -> DataFrame:
    """(date, holiday_name), one row for each holiday of the years in ``years`` (year int): a dimension to join."""
    days = F.array(*[F.struct(date.alias("date"), F.lit(n).alias("holiday_name")) for n, date in _dates(F.col("year"))])
    out = years.select("year").distinct().select(F.explode(days).alias("h")).select("h.*").where("date is not null")
    # Ascension can fall on 1 May: one row for a date.
    return out.groupBy("date").agg(F.min("holiday_name").alias("holiday_name"))


def holiday_name(day: Column) -> Column:
    """Name of the holiday on a date, null on other days: the first in order of those on one date."""
    return F.least(*[F.when(date == day, F.lit(n)) for n, date in _dates(F.year(day))])


def holiday_features(df: DataFrame, spec: PanelSpec = SPEC, include_name: bool = False) -> DataFrame:
    """``is_holiday_de`` (0 for null dates) and, if asked for, ``holiday_name``.

    Each row's own year gives its holidays, by rules with a first and a last year: no table of years, no scan for
    their range and no join.
    """
    d = coerce_time(df, spec.time_col).withColumn("__name", holiday_name(F.col(spec.time_col).cast("date")))
    d = d.withColumn("is_holiday_de", F.col("__name").isNotNull().cast("byte"))
    return (d.withColumn("holiday_name", F.col("__name")) if include_name else d).drop("__name")
