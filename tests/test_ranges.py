"""Long series in ranges, wide windows in blocks, and moments that merge."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import clean, lags, ranges, samples, split
from millrace.spec import PanelSpec

SPEC = PanelSpec("date", ("id",), "y")
SCHEMA = "date timestamp_ntz, id string, y double, other int"


def rows(n, id_="a", seed=1):
    rng = random.Random(seed)
    base = dt.datetime(2000, 1, 1)
    return [(base + dt.timedelta(days=i), id_, None if rng.random() < 0.1 else float(rng.randint(-50, 50)), i) for i in range(n)]


@pytest.fixture
def many_tasks(spark):
    """Small data would be put into one task."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v)


def same(a, b):
    order = ["id", "date", "other"]
    a, b = (d.toPandas().sort_values(order).reset_index(drop=True) for d in (a, b))
    pd.testing.assert_frame_equal(a[sorted(a.columns)], b[sorted(a.columns)], check_dtype=False)


def test_places_in_a_series_across_tasks(many_tasks):
    d = many_tasks.createDataFrame(rows(500) + rows(30, "b") + rows(5, None) + [(None, "a", 1.0, 500)], SCHEMA).repartition(4)
    got = ranges.positions(d, SPEC).collect()
    assert len(got) == 536 and all(r["__at"] == r["other"] for r in got)


@pytest.mark.parametrize("n_rows", [1, 50, 64, 10_000])
def test_one_series_in_ranges_equals_one_window(many_tasks, n_rows):
    """Fill, lags and rolling statistics of one long series, a short one, and rows without a key."""
    d = many_tasks.createDataFrame(rows(700) + rows(30, "b") + rows(5, None), SCHEMA).repartition(3)

    def step(d, spec):
        return lags.lag_features(clean.fill_seasonal(d, spec, period=20), spec, (1, 14), ((7, "mean"), (9, "max")))

    same(ranges.by_ranges(d, step, SPEC, before=40 + 14, rows=n_rows), step(d, SPEC))


def test_one_series_runs_in_many_tasks(many_tasks):
    d = many_tasks.createDataFrame(rows(2000), SCHEMA)
    per_task = lambda d: [r["n"] for r in d.groupBy(F.spark_partition_id()).agg(F.count("other").alias("n"), F.count("lag_1")).collect()]
    one = per_task(lags.lag_features(d, SPEC))
    many = ranges.by_ranges(d, lambda d, spec: lags.lag_features(d, spec), SPEC, before=14, rows=100)
    parts = per_task(many)
    assert one == [2000] and len(parts) > 3 and max(parts) < 1500 and sum(parts) == 2000


def test_samples_in_ranges(many_tasks):
    d = many_tasks.createDataFrame([("train" if i < 200 else "val", "a", i, float(i), dt.datetime(2000, 1, 1) + dt.timedelta(days=i)) for i in range(260) if i != 90], "split string, id string, time_idx long, y double, date timestamp_ntz")
    key = lambda d: sorted((r["split"], r["time_idx"], tuple(r["encoder"]), tuple(r["decoder"])) for r in d.collect())
    want = key(samples.training_samples(d, SPEC))
    assert len(want) > 100 and key(samples.samples_by_ranges(d, SPEC, rows=40)) == want


@pytest.mark.parametrize("width", [3, 65, 365, 3650])
def test_blocks_equal_frames(spark, width):
    """All statistics of windows put together from blocks, also wider than the series, against pandas."""
    data = rows(1500, "a", 2) + rows(70, "b", 3) + rows(1, "c") + [(dt.datetime(2000, 1, 1), None, 1.0, 0)]
    d = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = lags.block_rolling(d, width, lags.MERGED, SPEC).toPandas().sort_values(["id", "date"])
    for id_, g in got.groupby("id"):
        w = g["y"].shift(1).rolling(width, min_periods=1)
        want = {"mean": w.mean(), "sum": w.sum(), "min": w.min(), "max": w.max(), "std": w.std(), "var": w.var(), "count": w.count().fillna(0)}
        for s, x in want.items():
            pd.testing.assert_series_equal(g[f"lag_{width}_{s}"].astype(float), x.astype(float), check_names=False, rtol=1e-9, atol=1e-9)
    assert got[got["id"].isna()][f"lag_{width}_mean"].isna().all()


def test_wide_windows_have_no_wide_frames(spark):
    """No frame of the plan has a bound of so many rows: the work for a row does not grow with the width."""
    d = spark.createDataFrame(rows(10), SCHEMA)
    plan = lags.lag_features(d, SPEC, (), ((3650, "std"), (3650, "max")))._jdf.queryExecution().optimizedPlan().toString()
    frames = [x for x in plan.replace(" ", "").split("specifiedwindowframe(RowFrame,")[1:]]
    lag_frames = [x for x in frames if x.startswith("-3650,-3650")]
    assert frames and len([x for x in frames if x.startswith("-3650")]) == len(lag_frames)
    short = lags.lag_features(d, SPEC, (), ((7, "std"),))._jdf.queryExecution().optimizedPlan().toString()
    assert "RowFrame, -7, -1" in short


def test_no_digits_are_lost_far_from_zero(spark):
    """Values that differ by units at 1e9: subtracting prefix sums of squares would lose them."""
    data = [(d, i, None if y is None else y + 1e9, o) for d, i, y, o in rows(600)]
    got = lags.block_rolling(spark.createDataFrame(data, SCHEMA), 100, ["var"], SPEC).toPandas().sort_values("date")
    want = (got["y"] - 1e9).shift(1).rolling(100, min_periods=1).var()
    pd.testing.assert_series_equal(got["lag_100_var"], want, check_names=False, rtol=1e-6)


def test_moments_merge(spark):
    a = spark.createDataFrame(rows(100) + rows(1, "b") + rows(5, None), SCHEMA)
    b = spark.createDataFrame(rows(60, "a", 5) + rows(3, "c") + [(dt.datetime(2000, 1, 1), "d", None, 0)], SCHEMA)
    both = split.merge_moments(split.series_moments(a, ["y", "other"], SPEC), split.series_moments(b, ["y", "other"], SPEC), ["y", "other"], SPEC)
    got = split.moment_stats(both, ["y", "other"], SPEC).toPandas().set_index("id").sort_index()
    want = split.series_stats(a.unionByName(b), ["y", "other"], SPEC).toPandas().set_index("id").sort_index()
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)
    # Scaling with stored statistics is scaling by the rows behind them.
    scaled = split.scale_with(a, split.moment_stats(both, ["y"], SPEC), ["y"], SPEC).orderBy("id", "other").toPandas()
    again = split.scale_by_series(a, a.unionByName(b), ["y"], SPEC).orderBy("id", "other").toPandas()
    pd.testing.assert_frame_equal(scaled, again)
