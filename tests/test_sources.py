import datetime as dt

import pytest

from millrace.operators import scoring, split
from millrace.sources import io
from millrace.spec import PanelSpec


def test_csv_and_tables(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("country,date,store,product,num_sold,extra\nDE,2020-01-01,s,p,3,x\nDE,bad,s,p,many,y\n")
    d = io.read_sales_csv(spark, str(tmp_path / "raw.csv"))
    rows = d.collect()
    assert [r["num_sold"] for r in rows] == [3.0, None] and rows[0]["date"] == dt.datetime(2020, 1, 1) and rows[1]["date"] is None
    assert rows[0]["extra"] == "x"
    io.write_table(d, str(tmp_path / "t.PARQUET"), ("country",))
    assert io.read_table(spark, str(tmp_path / "t.PARQUET")).count() == 2
    assert io.read_table(spark, str(tmp_path / "raw.csv")).count() == 2
    with pytest.raises(ValueError):
        io.read_table(spark, "x.xlsx")
    n, cols, head = io.preview(d, 1)
    assert n == 2 and "date" in cols and head.count() == 1


def test_splits_and_manifest(spark, tmp_path):
    at = [dt.datetime(2020, 1, 1) + dt.timedelta(i) for i in range(10)]
    d = spark.createDataFrame([(t, "a", float(i)) for i, t in enumerate(at)], "date timestamp_ntz, id string, y double")
    spec = PanelSpec("date", ("id",), "y")
    parts = split.assign_split(d, at[6], at[8], spec)
    io.write_splits(parts, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/split=val")).count() == 2
    m = split.split_manifest(parts, at[6], at[8], spec, source="x", scaled_cols=["y"])
    io.write_json(m, str(tmp_path / "m"))
    got = spark.read.json(str(tmp_path / "m")).first()
    assert got["rows"]["train"] == 6 and got["val_start"] == "2020-01-07" and got["scaled_cols"] == ["y"]


def test_run_logs_with_different_headers(spark, tmp_path):
    for run, text in {"run_a": "epoch,train_loss_epoch,val_loss\n0,1.5,\n0,,2.5\n1,1.0,2.0\n", "run_b": "epoch,val_loss,lr-Adam\r\n0,3.0,0.01\r\n"}.items():
        (tmp_path / run).mkdir()
        (tmp_path / run / "metrics.csv").write_text(text)
    log = io.read_run_logs(spark, f"{tmp_path}/run_*/metrics.csv")
    s = {r["run_id"]: r for r in scoring.run_summary(scoring.run_epochs(log)).collect()}
    assert s["run_a"]["best_val_loss"] == 2.0 and s["run_a"]["n_epochs"] == 2 and s["run_b"]["final_lr"] == 0.01
    io.write_comparison(scoring.compare_runs(scoring.run_summary(scoring.run_epochs(log))), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_results_and_summary_of_each_run(spark, tmp_path):
    """One folder for each run; absent values are left out of the objects, present ones keep their order."""
    import json

    rows = [("a", 1, 0.5, 2.0, None), ("a", 0, 1.5, None, 0.1), ("b", 0, None, None, None), ("c/d", 0, 1.0, 1.0, 0.2)]
    epochs = spark.createDataFrame(rows, "run_id string, epoch int, train_loss double, val_loss double, lr double")
    io.write_run_results(epochs, str(tmp_path / "out"), meta={"k": "v"})
    results = json.loads(next((tmp_path / "out/results/run=a").glob("*.json")).read_text())
    assert results == {"run_id": "a", "results": [{"epoch": 0, "train_loss": 1.5, "learning_rate": 0.1}, {"epoch": 1, "train_loss": 0.5, "val_loss": 2.0}]}
    summary = json.loads(next((tmp_path / "out/summary/run=a").glob("*.json")).read_text())
    assert summary == {"run_id": "a", "n_epochs": 2, "metrics": {"final_train_loss": 0.5, "final_val_loss": 2.0, "best_val_loss": 2.0, "best_val_epoch": 1, "initial_lr": 0.1}, "meta": {"k": "v"}}
    got, sums = io.read_run_results(spark, str(tmp_path / "out"))
    assert {r["run_id"]: len(r["results"]) for r in got.collect()} == {"a": 2, "b": 1, "c/d": 1}
    assert {r["run_id"]: r["metrics"]["best_val_epoch"] for r in sums.collect()} == {"a": 1, "b": None, "c/d": 0}
    io.write_run_results(epochs.where("run_id = 'b'"), str(tmp_path / "out"))
    assert [r["run_id"] for r in io.read_run_results(spark, str(tmp_path / "out"))[0].collect()] == ["b"]


def test_a_log_in_many_splits_keeps_its_order(spark, tmp_path):
    """One file read by several tasks: steps are the rows' places; no window takes a whole file."""
    (tmp_path / "run_a").mkdir()
    text = "val_loss,note,lr-x\n" + "".join(f'{i},"a, b",{i / 10}\n' + "\n" * (i % 50 == 0) for i in range(3000))
    (tmp_path / "run_a/metrics.csv").write_text(text)
    (tmp_path / "run_b").mkdir()
    (tmp_path / "run_b/metrics.csv").write_text("epoch,val_loss\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        log = io.read_run_logs(spark, f"{tmp_path}/run_*/metrics.csv")
        got = [(r["run_id"], r["step"], r["val_loss"], r["lr-x"]) for r in log.orderBy("step").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == [("run_a", i + 1, float(i), i / 10) for i in range(3000)]
    plan = log._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(path" in plan and all("block" in p[:120] for p in plan.split("windowspecdefinition(path")[1:])


def test_a_table_is_replaced_only_once_it_is_written(spark, tmp_path):
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    path = str(tmp_path / "t.parquet")
    io.write_table(spark.range(10), path)
    io.write_table(io.read_table(spark, path).withColumn("id", F.col("id") + 1), path)
    assert sorted(r["id"] for r in io.read_table(spark, path).collect()) == list(range(1, 11))
    broken = io.read_table(spark, path).withColumn("id", F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("id")))
    with pytest.raises(PySparkException):
        io.write_table(broken, path)
    assert io.read_table(spark, path).count() == 10 and [p.name for p in tmp_path.iterdir()] == ["t.parquet"]


def test_parts_are_counted_while_they_are_written(spark, tmp_path, monkeypatch):
    """Counts, first and last times, checks and manifest come from the writing pass: no action but the write."""
    at = [dt.datetime(2020, 1, 1) + dt.timedelta(i) for i in range(10)]
    d = spark.createDataFrame([(t, "a", float(i)) for i, t in enumerate(at)], "date timestamp_ntz, id string, y double")
    spec = PanelSpec("date", ("id",), "y")
    parts = split.assign_split(d, at[6], at[8], spec)
    for name in ("collect", "count", "first", "toPandas"):
        monkeypatch.setattr(type(d), name, lambda *a, **k: pytest.fail("another scan"))
    seen = io.write_splits(parts, str(tmp_path / "s"), spec)
    split.check_parts(seen)
    m = split.manifest_of(spark, seen, at[6], at[8], spec, source="x")
    monkeypatch.undo()
    assert seen == {"train": {"rows": 6, "first": at[0], "last": at[5]}, "val": {"rows": 2, "first": at[6], "last": at[7]}, "test": {"rows": 2, "first": at[8], "last": at[9]}}
    assert m.drop("source").collect() == split.split_manifest(parts, at[6], at[8], spec).drop("source").collect()
    empty = io.write_splits(parts.where("split <> 'val'"), str(tmp_path / "e"), spec)
    with pytest.raises(ValueError, match="val"):
        split.check_parts(empty)
    with pytest.raises(ValueError, match="overlaps"):
        split.check_parts(seen | {"test": {"rows": 1, "first": at[2], "last": at[3]}})


def test_unreadable_values_are_kept_apart(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("country,date,store,product,num_sold\nDE,2020-01-01,s,p,3\nDE,bad,s,p,many\nDE,bad,s,p,4\nDE,,s,p,\n")
    rows, rejects = io.read_checked_csv(spark, str(tmp_path / "raw.csv"))
    assert sorted(map(tuple, rejects.collect())) == [("date", "bad", 2), ("num_sold", "many", 1)]
    assert rows.count() == 4 and rows.where("date is null").count() == 3 and "__bad" not in rows.columns
    assert "csv" not in rejects._jdf.queryExecution().executedPlan().toString().lower().replace("raw.csv", "")


def test_files_of_many_runs(spark, tmp_path):
    """Logs that name their runs in a column, and results without folders: files do not grow with the runs."""
    (tmp_path / "one.csv").write_text("run_id,epoch,val_loss\na,0,2.5\nb,0,3.0\na,0,2.0\n")
    (tmp_path / "two.csv").write_text("run_id,val_loss,lr-x\nc,1.0,0.1\n")
    log = io.read_run_logs(spark, f"{tmp_path}/*.csv")
    got = sorted((r["run_id"], r["step"], r["epoch"], r["val_loss"], r["lr-x"]) for r in log.collect())
    assert got == [("a", 1, 0.0, 2.5, None), ("a", 3, 0.0, 2.0, None), ("b", 2, 0.0, 3.0, None), ("c", 1, None, 1.0, 0.1)]
    epochs = spark.range(600).selectExpr("id div 2 AS run_id", "CAST(id % 2 AS INT) AS epoch", "1.5D AS train_loss", "CAST(NULL AS DOUBLE) AS val_loss", "0.1D AS lr")
    io.write_run_results(epochs, str(tmp_path / "out"), meta={"k": "v"}, folders=False)
    assert len(list((tmp_path / "out").rglob("*.json"))) <= 16
    results, sums = io.read_run_results(spark, str(tmp_path / "out"))
    assert {(r["run_id"], len(r["results"])) for r in results.collect()} == {(str(i), 2) for i in range(300)}
    assert {(r["run_id"], r["n_epochs"], r["metrics"]["initial_lr"], r["meta"]["k"]) for r in sums.collect()} == {(str(i), 2, 0.1, "v") for i in range(300)}
