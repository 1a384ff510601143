"""Tables that a job writes for itself, in the folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  A folder of our own is made only where that setting is missing
    and the master is local."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own_dirs:
        _own_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return _own_dirs[sc.applicationId]


def new_path(spark: SparkSession, label: str, folder: str = "tables") -> str:
    return f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}/{folder}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Deletes all tables that this application has written for itself, once no result that reads them is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(new_path(spark, "x")).getParent()
    path.getFileSystem(spark.sparkContext._jsc.sc().hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back, for what several steps read."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
