"""Runs a query in Spark and in DuckDB on the same tables and compares them by value."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir=SF):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if type(v).__name__ == "NaTType":
        return None
    if isinstance(v, float):
        return round(v, 4) + 0.0
    return v


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(v) for v in r) for r in pdf[cols].itertuples(index=False)), key=repr)


def assert_same(df, sql, sf_dir=SF):
    ours, theirs = rows(df.toPandas()), rows(connect(sf_dir).sql(sql).df())
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    bad = [(a, b) for a, b in zip(ours[1], theirs[1]) if repr(a) != repr(b)]
    assert not bad, bad[:3]
