import os

import pytest

import __spark_entry__ as entry
from millrace.plans import registry
from oracle import SF, assert_same


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SF), registry.SQL[name])


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.SQL) == set(registry.QUERIES)
    assert entry.entry(spark).count() > 0


def test_one_shuffle_of_the_facts(spark):
    """Aligning, cleaning and all features shuffle the panel once, by series."""
    import re

    from millrace.plans.features import feature_table

    p = registry.panel(spark, SF)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/panel"
    p.write.mode("overwrite").parquet(path)
    d = feature_table(spark.read.parquet(path), 2000, "2000-01-01", 2000, (3, 4, 5))
    plan = d._jdf.queryExecution().executedPlan().toString()
    # What else is shuffled is the holidays, a dimension.
    assert len(re.findall(r"Exchange hashpartitioning\(country", plan)) == 1


def test_filters_reach_the_scan(spark):
    from millrace.operators import audit

    p = spark.read.parquet(f"{SF}/events.parquet")
    from millrace.spec import PanelSpec

    d = audit.in_year(p, 2024, PanelSpec("ts", ("user_id",), "value")).select("value")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "props" not in plan


def test_facts_are_scanned_once(spark):
    """Aligning reads the panel that was written, and one scan of it gives the factors."""
    plan = registry.QUERIES["align_yearly"](spark, SF)._jdf.queryExecution().toString()
    assert "lineitem" not in plan and plan.split("== Physical Plan ==")[1].count("FileScan") == 2
    p = registry.panel(spark, SF, keep=True)
    from millrace.operators import align

    assert align.level_factors(p, 2000)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_the_feature_table_reads_its_facts_twice(spark):
    """Once for levels and the first time, once for the features."""
    from millrace.plans.features import feature_table

    p = registry.panel(spark, SF, keep=True)
    plan = feature_table(p, 2000, "2000-01-01", 2000, (3, 4, 5))._jdf.queryExecution().executedPlan().toString()
    # What else is read is the factors and the first time, both written once.
    assert plan.count("FileScan") == 3 and plan.count("ReadSchema: struct<date") == 1 and plan.count("ReadSchema: struct<first") == 1


def test_before_and_after_in_one_pass_equal_the_join(spark):
    from pyspark.sql import functions as F

    from millrace.operators import audit, clean

    p = registry.panel(spark, SF, keep=True)
    d = clean.clean(p.withColumn("before", F.col("num_sold")), "2000-01-01", 2000, (3, 4, 5))
    one, two = audit.differences_within(d, "before", year=2000), audit.differences(p, d.drop("before"), year=2000)
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty() and one.count() > 0
    one = audit.daily_totals_of(d, {"before": "aligned", "num_sold": "cleaned"}, 2000)
    two = audit.daily_before_after(p, d, 2000)
    key = lambda x: sorted((r["date"], r["country"], r["variant"], round(r["total"], 6)) for r in x.collect())
    assert key(one) == key(two)


def test_own_tables_are_released(spark):
    import os

    from millrace import storage

    path = storage.stored(spark.range(3), "own").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    storage.release(spark)
    assert not os.path.exists(path)


def test_queries_run_without_the_corpus_operators(tmp_path):
    """The entry imports, and keeps the panel's queries, where the corpus operators are missing."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, check=True)
    assert out.stdout.split()[-2:] == [str(len(registry.QUERIES))] * 2


@pytest.mark.parametrize("name", ["row_number_epochs", "run_log_files"])
def test_run_logs_keep_their_order(spark, tmp_path, name):
    """Events that come in no order from many tasks: rows of a written log stand in the order of their steps."""
    import os

    from oracle import TABLES

    for t in TABLES:
        if t != "events":
            os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.read.parquet(f"{SF}/events.parquet").where("user_id < 40").repartition(8).write.parquet(str(tmp_path / "events.parquet"))
    assert_same(registry.QUERIES[name](spark, str(tmp_path)), registry.SQL[name], str(tmp_path))


@pytest.mark.parametrize("name", ["row_number_epochs", "run_log_files"])
def test_run_logs_keep_the_sign_of_their_runs(spark, tmp_path, name):
    """Runs below 0 stay apart from those above, and odd ones below 0 stay out where the SQL leaves them out."""
    import os

    from oracle import TABLES

    for t in TABLES:
        if t != "events":
            os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    e = spark.read.parquet(f"{SF}/events.parquet").where("user_id < 40")
    e.withColumn("user_id", e["user_id"] - 20).write.parquet(str(tmp_path / "events.parquet"))
    assert_same(registry.QUERIES[name](spark, str(tmp_path)), registry.SQL[name], str(tmp_path))
