"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where none is set, on one machine only, a
    temporary folder, which becomes the checkpoint folder and goes at exit."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not at:
        own = tempfile.mkdtemp(prefix="thalweg-net-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(at := f"file://{own}")
    return at.rstrip("/")


#: Largest table, by the bytes of its files, that joins send to all executors over the driver.
BROADCAST = 1 << 20


def bound_broadcasts(spark: SparkSession) -> None:
    """Lower the session's threshold for broadcasts to ``BROADCAST``.  Files of ids hold a
    fraction of what their rows take, and a query joins its tables dozens of times; with
    Spark's 10 MB each of these joins sends millions of rows to the driver."""
    if spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() > BROADCAST:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(BROADCAST))


_cleaned: set[str] = set()


def _clean_up(spark: SparkSession, app: str, path: str) -> None:
    """Remove a run's tables when Python ends, unless the session has ended before."""
    with suppress(Exception):
        if spark.sparkContext._jsc is not None and spark.sparkContext.applicationId == app:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame, tag: str = "table") -> DataFrame:
    """Write and read back: cuts the lineage, survives lost executors.  Tables go when
    the driver ends.  Joins of the session broadcast small tables only from then on."""
    spark = df.sparkSession
    bound_broadcasts(spark)
    app = spark.sparkContext.applicationId
    run = f"{shared_dir(spark)}/thalweg-{app}"
    if run not in _cleaned:
        _cleaned.add(run)
        atexit.register(_clean_up, spark, app, run)
    path = f"{run}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
