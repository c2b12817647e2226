"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset (a local session), a folder made once."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="chronomotif-"))
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


def saved(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written there as Parquet and read again: loops cut their lineage so, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _stored[id(out)] = path
    weakref.finalize(out, _stored.pop, id(out), None)
    return out


#: Where tables of :func:`saved` lie, as long as their frames are held.
_stored: dict[int, str] = {}


def released(*frames: DataFrame) -> None:
    """Remove the tables of :func:`saved` that these frames read, once nothing reads them any more."""
    for df in frames:
        path = _stored.pop(id(df), None)
        if path:
            spark = df.sparkSession
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
