"""Small tables that many queries read: written once for an input, read from then on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_written: dict[tuple, str] = {}


def _stamp(spark: SparkSession, path: str) -> tuple:
    """Length and time of the files of an input."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(sc._jsc.hadoopConfiguration())
    status = files.getFileStatus(p)
    return status.getLen(), status.getModificationTime(), files.getContentSummary(p).getLength()


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local folder if there is one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    base = tempfile.mkdtemp(prefix="linkloom-shared-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def saved(df: DataFrame, name: str) -> DataFrame:
    """A table, written to the shared folder and read from there; it goes when the application ends."""
    spark = df.sparkSession
    at = f"{folder(spark)}/linkloom-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(at)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(at)


def stored(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``build`` makes of the input at ``source``; it is built once in an application, unless the input changes."""
    key = (spark.sparkContext.applicationId, name, source, _stamp(spark, source))
    if key not in _written:
        at = f"{folder(spark)}/linkloom-{name}-{uuid.uuid4().hex[:12]}"
        build().write.parquet(at)
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
        _written[key] = at
    return spark.read.parquet(_written[key])
