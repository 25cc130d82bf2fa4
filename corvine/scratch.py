"""Cutting lineage through tables in a folder that every executor can reach."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_LOCAL: dict[str, str] = {}


def is_local(spark: SparkSession) -> bool:
    """True where driver and executors are one process."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode where none is set."""
    found = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if found:
        return found.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not is_local(spark):
        raise ValueError(f"set {_CONF} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-corvine-")
    return _LOCAL[app]


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/corvine/{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Delete what this application has cut so far; to be called when no result of it is read any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    Unlike an eager checkpoint this evaluates the plan once, and the columnar copy can be pruned.
    """
    spark = df.sparkSession
    path = f"{_own(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
