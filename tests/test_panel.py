"""One small frame for each rule of the panel operators."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import calendar, cyclical
from millrace.operators import align, audit, clean, lags, samples, scoring, split
from millrace.spec import PanelSpec, coerce_time, nan_to_null, require, to_float32

D = dt.datetime
ONE = PanelSpec("date", ("id",), "y")


def frame(spark, rows, schema="date timestamp_ntz, country string, store string, product string, num_sold double"):
    return spark.createDataFrame(rows, schema)


def days(n, start=D(2019, 1, 1)):
    return [start + dt.timedelta(i) for i in range(n)]


def series(spark, values, start=D(2019, 1, 1), id_="a"):
    return spark.createDataFrame([(t, id_, v) for t, v in zip(days(len(values), start), values)], "date timestamp_ntz, id string, y double")


def test_alignment_edge_cases(spark):
    rows = [(D(y, 1, 1), c, "s", "p", float(v)) for c, y, v in [("A", 2019, 5), ("A", 2020, 10), ("B", 2019, 7), ("C", 2019, 0), ("C", 2020, 4), (None, 2019, 3)]]
    got = {(r["country"], r["year"]): r["num_sold"] for r in align.align(frame(spark, rows), 2020).collect()}
    assert got == {("A", 2019): 10.0, ("A", 2020): 10.0, ("B", 2019): 7.0, ("C", 2019): 0.0, ("C", 2020): 4.0, (None, 2019): 3.0}


def test_aligned_means_equal_the_reference(spark):
    rows = [(D(y, 1, d), "A", "s", "p", float(v)) for y in (2018, 2019, 2020) for d, v in ((1, y - 2010), (2, 3 * (y - 2015)))]
    a = align.align(frame(spark, rows), 2020)
    means = [r["aligned"] for r in align.alignment_means(frame(spark, rows), a).collect()]
    assert all(math.isclose(m, means[0]) for m in means)


def test_fill_counts_rows_and_reads_old_values(spark):
    v = [float(i) for i in range(800)]
    v[730] = v[365] = None  # 365 rows back of row 730 is null itself, filled from row 0 only in a second pass
    v[20] = None
    d = clean.fill_seasonal(series(spark, v), ONE)
    got = {r["date"]: r["y"] for r in d.collect()}
    at = days(800)
    assert got[at[365]] == 0.0 and got[at[730]] == 0.0 and got[at[20]] is None
    assert got[at[799]] == 799.0


def test_clean_keeps_flag_and_values(spark):
    v = [float(i % 11) for i in range(900)]
    d = series(spark, v, D(2018, 1, 1))
    c = clean.clean(d, "2020-01-01", 2020, (3, 4, 5), ONE)
    rows = {r["date"]: r for r in c.collect()}
    assert rows[D(2020, 3, 1)]["is_lockdown_period"] == 1 and rows[D(2020, 2, 29)]["is_lockdown_period"] == 0
    masked = [t for t in rows if t == D(2020, 1, 1) or t.year == 2020 and t.month in (3, 4, 5)]
    for t, old in zip(days(900, D(2018, 1, 1)), v):
        if t not in masked:
            assert rows[t]["y"] == old
    flagged = clean.default_flag(d.withColumn("is_lockdown_period", d["y"].cast("int")))
    assert flagged.columns.count("is_lockdown_period") == 1


def test_null_keys_get_no_lags(spark):
    d = spark.createDataFrame([(t, None, 1.0) for t in days(4)], "date timestamp_ntz, id string, y double")
    assert all(r["lag_1"] is None and r["lag_2_mean"] is None for r in lags.lag_features(d, ONE, (1,), ((2, "mean"),)).collect())


def test_rolling_skips_nulls_and_the_row_itself(spark):
    d = lags.lag_features(series(spark, [None, 1.0, 2.0, None, 4.0, 5.0]), ONE, (1,), ((3, "mean"), (3, "std"), (3, "median")))
    got = [(r["lag_1"], r["lag_3_mean"], r["lag_3_median"]) for r in d.orderBy("date").collect()]
    assert got == [(None, None, None), (None, None, None), (1.0, 1.0, 1.0), (2.0, 1.5, 1.5), (None, 1.5, 1.5), (4.0, 3.0, 3.0)]
    assert [r["lag_3_std"] for r in d.orderBy("date").collect()][2] is None
    with pytest.raises(ValueError):
        lags.lag_features(d, ONE, (), ((3, "mode"),))


def test_fill_lag_gaps_both_ways(spark):
    d = lags.fill_lag_gaps(lags.lag_features(series(spark, [1.0, 2.0, None, 4.0]), ONE, (1,), ()), spec=ONE)
    assert [r["lag_1"] for r in d.orderBy("date").collect()] == [1.0, 1.0, 2.0, 2.0]


def test_zone_shift_and_week_53(spark):
    d = spark.createDataFrame([(D(2020, 6, 30, 22, 30),), (D(2020, 12, 31, 23, 30),), (None,), (D(2021, 1, 3),)], "date timestamp_ntz")
    spec = PanelSpec("date", (), "y")
    rows = cyclical.cyclical_features(d, spec, drop_source_cols=False).collect()
    assert (rows[0]["cyc_month_idx"], rows[0]["cyc_hour_idx"]) == (6, 0)
    assert (rows[1]["cyc_month_idx"], rows[1]["cyc_doy_idx"]) == (0, 0)
    assert rows[2]["cyc_dow_sin"] is None and rows[3]["cyc_week_idx"] == 52
    assert all(abs(r["cyc_hour_sin"] ** 2 + r["cyc_hour_cos"] ** 2 - 1) < 1e-12 for r in rows if r["cyc_hour_sin"] is not None)
    with pytest.raises(ValueError):
        cyclical.cyclical_features(d, spec, names=("moon",))
    utc = cyclical.cyclical_features(d, spec, names=("hour",), zone=None, drop_source_cols=False).collect()
    assert utc[0]["cyc_hour_idx"] == 22


def test_day_of_week_golden_values(spark):
    d = spark.createDataFrame([(D(2024, 1, 1),), (D(2024, 1, 2),), (D(2024, 1, 7),)], "date timestamp_ntz")
    got = [(int(r["s"] * 1000) / 1000, int(r["c"] * 1000) / 1000) for r in cyclical.cyclical_features(d, PanelSpec("date", (), "y"), ("dow",)).selectExpr("cyc_dow_sin s", "cyc_dow_cos c").collect()]
    assert got == [(0.0, 1.0), (0.781, 0.623), (-0.781, 0.623)]


def test_holidays(spark):
    h = {str(r["date"]): r["holiday_name"] for r in calendar.holidays(spark.range(2008, 2020).selectExpr("cast(id as int) AS year")).collect()}
    assert h["2017-04-17"] == "Ostermontag" and "2017-10-31" in h and "2016-10-31" not in h and "2018-10-31" not in h
    assert h["2019-04-19"] == "Karfreitag" and h["2008-05-01"] in ("Tag der Arbeit", "Christi Himmelfahrt")
    # Easter Sundays at the edges of the calendar.
    sundays = {y: str(r[0]) for y in (1954, 1981, 2000, 2011, 2038, 2049, 2076) for r in spark.range(1).select(calendar.easter(calendar.F.lit(y))).collect()}
    assert sundays == {1954: "1954-04-18", 1981: "1981-04-19", 2000: "2000-04-23", 2011: "2011-04-24", 2038: "2038-04-25", 2049: "2049-04-18", 2076: "2076-04-19"}
    d = spark.createDataFrame([(D(2019, 12, 25, 8),), (None,), (D(2019, 12, 24),)], "date timestamp_ntz")
    assert [r["is_holiday_de"] for r in calendar.holiday_features(d, PanelSpec("date", (), "y")).collect()] == [1, 0, 0]


def test_calendar_nulls_and_time_index(spark):
    d = spark.createDataFrame([(D(2021, 1, 3, 12),), (D(2021, 1, 4, 6),), (None,)], "date timestamp_ntz")
    spec = PanelSpec("date", (), "y")
    rows = calendar.time_index(calendar.calendar_features(d, spec), spec).collect()
    assert [r["time_idx"] for r in rows] == [0, 0, None]
    assert [r["dayofweek"] for r in rows] == [6, 0, None] and [r["is_weekend"] for r in rows] == [1, 0, None]


def test_boundaries(spark):
    at = days(5)
    d = spark.createDataFrame([(t,) for t in [at[0]] * 7 + [at[1]] * 3 + [at[2], at[3], None]], "date timestamp_ntz")
    spec = PanelSpec("date", (), "y")
    assert split.boundaries(d, spec, (0.6, 0.25, 0.15)) == (at[1], at[3])
    with pytest.raises(ValueError):
        split.boundaries(d, spec, (0.5, 0.3, 0.1))
    with pytest.raises(ValueError):
        split.boundaries(d.limit(9), spec)
    with pytest.raises(ValueError):
        split.boundaries(d, spec, (0.1, 0.1, 0.8))
    with pytest.raises(ValueError):
        split.boundaries(d, spec, None)
    with pytest.raises(ValueError):
        split.boundaries(d, spec, None, at[2], at[2])
    assert split.boundaries(d, spec, None, at[1], at[3]) == (at[1], at[3])
    parts = split.assign_split(d, at[1], at[3], spec)
    assert {r["split"]: r["n_rows"] for r in split.split_counts(parts, spec).collect()} == {"train": 7, "val": 4, "test": 1}
    split.check_split(parts, spec)
    with pytest.raises(ValueError):
        split.check_split(parts.where("split <> 'val'"), spec)
    assert [x.count() for x in split.time_split(d, at[1], at[3], spec)] == [7, 4, 1]


def test_scaling_edge_cases(spark):
    rows = [("a", 1.0, "train"), ("a", 3.0, "train"), ("a", 5.0, "val"), ("c", 2.0, "train"), ("c", 2.0, "train"), ("n", 9.0, "val"), ("o", 4.0, "train")]
    d = spark.createDataFrame(rows, "id string, y double, split string")
    got = sorted((r["id"], r["y"]) for r in split.scale_by_series(d, d.where("split = 'train'"), ["y"], ONE).collect() if r["split"] == "val" or r["id"] != "a")
    assert got[0][1] == pytest.approx(3 / math.sqrt(2)) and all(v is None for _, v in got[1:])
    assert [r["id"] for r in split.unseen_series(d.where("split = 'val'"), d.where("split = 'train'"), ONE).collect()] == ["n"]


def test_samples_stay_in_a_part_and_need_no_gap(spark):
    rows = [("a", "train", i, float(i)) for i in range(6)] + [("a", "val", i, float(i)) for i in range(6, 9)] + [("b", "train", i, float(i)) for i in (0, 1, 3, 4, 5)]
    d = spark.createDataFrame(rows, "id string, split string, time_idx long, y double")
    got = samples.training_samples(d, ONE, encoder=2, decoder=1).collect()
    assert sorted((r["id"], r["split"], r["time_idx"]) for r in got) == [("a", "train", 2), ("a", "train", 3), ("a", "train", 4), ("a", "train", 5), ("a", "val", 8), ("b", "train", 5)]
    assert all(r["encoder"] == [r["time_idx"] - 2.0, r["time_idx"] - 1.0] and r["decoder"] == [float(r["time_idx"])] for r in got)
    assert samples.training_samples(d, ONE, encoder=2, decoder=1, stride=2).count() == 3


def test_feature_roles(spark):
    d = spark.createDataFrame([], "date timestamp_ntz, country string, store string, product string, num_sold double, cyc_dow_sin double, month int, is_holiday_de byte, is_lockdown_period boolean, time_idx long, price double, lag_7 double, note string")
    r = samples.feature_roles(d)
    assert r.known_reals == ["cyc_dow_sin", "month", "is_holiday_de", "is_lockdown_period", "time_idx"]
    assert r.unknown_reals == ["num_sold", "price", "lag_7"] and r.static_categoricals == ["country", "store", "product"]
    assert "month" in samples.feature_roles(d, calendar_known=False).unknown_reals


def test_audit(spark):
    keys = "date timestamp_ntz, id string, y double"
    a = spark.createDataFrame([(D(2020, 1, 1), "a", 1.0), (D(2020, 1, 2), "a", 2.0), (D(2020, 1, 1), "b", None), (D(2019, 1, 1), "a", 9.0)], keys)
    b = spark.createDataFrame([(D(2020, 1, 1), "a", 4.0), (D(2020, 1, 2), "a", 1.0), (D(2020, 1, 1), "b", 5.0), (D(2019, 1, 1), "a", 0.0)], keys)
    diff = audit.differences(a, b, ONE, 2020)
    assert {r["id"]: r["abs_change"] for r in audit.change_by_series(diff, ONE).collect()} == {"a": 4.0, "b": 0.0}
    top = audit.most_changed(diff, 1, ONE)
    assert [r["diff"] for r in audit.series_rows(diff, top, ONE).collect()] == [3.0, -1.0]
    assert audit.daily_total_all(a, ONE).where("date = timestamp_ntz'2020-01-01'").first()["total"] == 1.0
    assert audit.one_series(a, {"id": "b"}).count() == 1


def test_run_logs(spark):
    rows = [("r", 1, 0, None, 2.0, None), ("r", 2, 0, 1.0, None, None), ("r", 3, 1, 0.5, 2.0, 0.1), ("r", 4, 1, None, None, None), ("q", 1, 0, 3.0, None, 0.2)]
    log = spark.createDataFrame(rows, "run_id string, step int, epoch int, train_loss_step double, val_loss double, `lr-Adam` double")
    e = scoring.run_epochs(log)
    s = {r["run_id"]: r for r in scoring.run_summary(e).collect()}
    assert (s["r"]["n_epochs"], s["r"]["best_val_loss"], s["r"]["best_val_epoch"], s["r"]["final_train_loss"], s["r"]["initial_lr"], s["r"]["final_lr"]) == (2, 2.0, 0, 0.5, None, 0.1)
    assert s["q"]["best_val_loss"] is None and s["q"]["best_val_epoch"] is None
    assert [r["run_id"] for r in scoring.compare_runs(scoring.run_summary(e)).collect()] == ["r", "q"]
    assert scoring.run_epochs(log.drop("epoch", "val_loss")).where("run_id = 'r'").count() == 2
    assert scoring.lr_column(["epoch", "LR-Adam"]) == "LR-Adam" and scoring.lr_column(["loss"]) is None


def test_errors(spark):
    d = spark.createDataFrame([(0.0, 0.0), (2.0, 1.0), (-4.0, -2.0), (1.0, None)], "y double, yhat double")
    r = scoring.forecast_errors(d).first()
    assert (r["n"], r["mae"], r["mape"]) == (3, 1.0, 0.5) and r["rmse"] == pytest.approx(math.sqrt(5 / 3)) and r["smape"] == pytest.approx(2 / 3)
    p = scoring.pinball_loss(d.where("yhat is not null"), {0.9: "yhat"}).first()
    assert p["loss"] == pytest.approx((0 + 0.9 + 0.2) / 3)
    assert scoring.mse_loss(d).first()["mse"] == pytest.approx(5 / 3)


def test_reading_types(spark):
    d = spark.createDataFrame([("2020-01-05", "x"), ("never", "2.5")], "date string, y string")
    assert [r["date"] for r in coerce_time(d, "date").collect()] == [D(2020, 1, 5), None]
    with pytest.raises(Exception):
        coerce_time(d, "date", strict=True).collect()
    assert [r["y"] for r in to_float32(d, "y").collect()] == [None, 2.5]
    n = spark.createDataFrame([(float("nan"),), (1.0,)], "y double")
    assert [r["y"] for r in nan_to_null(n).collect()] == [None, 1.0]
    with pytest.raises(KeyError):
        require(d, ["date", "id"])


def test_empty_panel(spark):
    d = frame(spark, [])
    assert align.align(d, 2020).count() == 0
    assert lags.lag_features(clean.clean(d, "2020-01-01", 2020, (3,))).count() == 0
    assert audit.daily_totals(d).count() == 0


def test_time_at_any_position(spark):
    """Ties, nulls, and times that differ by days, seconds, milliseconds and microseconds."""
    base = dt.datetime(2020, 1, 1)
    steps = [0, 0, 1, 2, 999, 1000, 1001, 10**6, 10**6, 10**6 + 1, 61 * 10**6, 86_400 * 10**6, 86_400 * 10**6 + 5, 90_000 * 10**6]
    times = [base + dt.timedelta(microseconds=s) for s in steps]
    df = spark.createDataFrame([(t,) for t in times] + [(None,)], "date timestamp_ntz")
    assert [split.times_at(df, "date", (i / 15,), lambda n: (i,))[0] for i in range(15)] == [*times, None]  # noqa: B023
    assert split.times_at(df, "date", (0.2, 0.9), lambda n: (3, 13)) == [times[3], times[13]]
    # A position far from its share is found by wider brackets.
    assert split.times_at(df, "date", (0.0,), lambda n: (9,)) == [times[9]]


def test_boundaries_take_two_scans(spark, monkeypatch):
    """One for the sketch and one for the counts, of which the driver gets a row each; equal to sorting all."""
    rng = random.Random(4)
    base = dt.datetime(2020, 1, 1)
    times = [base + dt.timedelta(seconds=rng.choice([rng.randrange(10**6), 77])) for _ in range(20_000)] + [None] * 50
    df = spark.createDataFrame([(t,) for t in times], "date timestamp_ntz").repartition(5)
    path = spark.conf.get("spark.checkpoint.dir") + "/two-scans"
    df.write.mode("overwrite").parquet(path)
    df = spark.read.parquet(path)
    plans = []
    first = type(df).first

    def counting(self):
        plans.append(self._jdf.queryExecution().executedPlan().toString().count("FileScan"))
        return first(self)

    monkeypatch.setattr(type(df), "first", counting)
    got = split.boundaries(df, PanelSpec("date", (), "y"))
    order = sorted(times, key=lambda t: (t is None, t or base))
    n = len(order)
    assert got == (order[int(n * 0.8)], order[int(n * (0.8 + 0.1))]) and plans == [1, 1]


def test_checks_raise(spark):
    from millrace.operators import audit, join
    from millrace.spec import check_unique

    twice = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d")], "k int, v string")
    with pytest.raises(ValueError):
        join.many_to_one(spark.createDataFrame([(1, 2)], "k int, x int"), twice, ["k"])
    check_unique(twice.where("k is null or v = 'a'"), ["k"])
    spec = PanelSpec("date", ("id",), "y")
    one = spark.createDataFrame([(dt.datetime(2020, 1, 1), "a", 1.0)], "date timestamp_ntz, id string, y double")
    with pytest.raises(ValueError):
        audit.differences(one, one.withColumn("id", F.lit("b")), spec, check=True)
    assert audit.differences(one, one, spec, check=True).first()["diff"] == 0.0


def test_samples_by_role_and_normalizer(spark):
    spec = PanelSpec("date", ("id",), "y")
    rows = [("train", "a", i, float(i + 1), i * 10, None if i == 1 else i) for i in range(6)]
    d = spark.createDataFrame(rows, "split string, id string, time_idx long, y double, k int, u int")
    roles = samples.FeatureRoles(["id"], ["k", "time_idx"], ["y", "u"])
    got = samples.training_samples(d, spec, encoder=3, decoder=2, roles=roles).orderBy("time_idx").collect()
    assert [r["time_idx"] for r in got] == [3, 4]
    assert got[0]["encoder"] == [1, 2, 3] and got[0]["decoder"] == [4, 5]
    assert got[0]["encoder_k"] == [0, 10, 20] and got[0]["decoder_k"] == [30, 40] and got[0]["decoder_time_idx"] == [3, 4]
    assert got[0]["encoder_u"] == [0, None, 2] and "decoder_u" not in got[0].asDict()
    stats = split.series_normalizer(d, spec)
    n = samples.normalize_samples(samples.training_samples(d, spec, encoder=3, decoder=2), stats, spec).orderBy("time_idx").first()
    z = [math.log(math.expm1(y)) for y in range(1, 7)]
    m = sum(z) / 6
    s = (sum((x - m) ** 2 for x in z) / 5) ** 0.5
    assert n["encoder"] == pytest.approx([(x - m) / s for x in z[:3]]) and n["decoder"] == pytest.approx([(x - m) / s for x in z[3:5]])


def test_holiday_rules_have_a_first_and_a_last_year(spark):
    from millrace.functions import calendar

    days = {
        "1953-06-17": None, "1954-06-17": "Tag der deutschen Einheit", "1990-06-17": "Tag der deutschen Einheit", "1991-06-17": None,
        "1989-10-03": None, "1990-10-03": "Tag der Deutschen Einheit", "2150-10-03": "Tag der Deutschen Einheit",
        "1994-11-16": "Bu\u00df- und Bettag", "1995-11-22": None, "1990-11-21": "Bu\u00df- und Bettag", "1981-11-18": "Bu\u00df- und Bettag",
        "1990-04-13": "Karfreitag", "2150-04-10": "Karfreitag", "2150-04-13": "Ostermontag", "2017-10-31": "Reformationstag", "2018-10-31": None,
        "9999-12-25": "1. Weihnachtstag", "2008-05-01": "Christi Himmelfahrt",
    }
    d = spark.createDataFrame([(dt.datetime.fromisoformat(x),) for x in days] + [(None,)], "date timestamp_ntz")
    got = calendar.holiday_features(d, include_name=True)
    assert {str(r["date"])[:10]: (r["is_holiday_de"], r["holiday_name"]) for r in got.collect()} == {k: (int(v is not None), v) for k, v in days.items()} | {"None": (0, None)}
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    # The dimension says the same of every day of a century.
    days = spark.sql("SELECT explode(sequence(DATE '1950-01-01', DATE '2049-12-31')) AS day")
    h = calendar.holidays(days.selectExpr("year(day) AS year"))
    d = days.withColumn("name", calendar.holiday_name(F.col("day"))).join(h, F.col("day") == F.col("date"), "left")
    assert d.where("NOT (name <=> holiday_name)").count() == 0 and d.where("name IS NOT NULL").count() > 900
