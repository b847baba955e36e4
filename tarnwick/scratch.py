"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir``: it
survives lost executors, is columnar, and gives the next plan real sizes.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only in local mode."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tarnwick-')}")
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tarnwick/{uuid.uuid4().hex}-{name}"
    _written.append(path)
    return path


def make_folder(spark: SparkSession, path: str) -> None:
    """An empty folder that can be read even if no task writes into it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)


def table(spark: SparkSession, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and return a scan of what was written."""
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, df_or_path: DataFrame | str) -> None:
    """Delete a scratch table once nothing will read it again."""
    paths = [df_or_path] if isinstance(df_or_path, str) else {f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
        if path in _written:
            _written.remove(path)


def release(spark: SparkSession) -> None:
    """Have Spark drop the broadcasts and shuffle files of finished jobs, which it does once the driver collects garbage.

    What the driver's Python has freed, as after a model was fitted, goes back to the system.
    """
    gc.collect()
    if _trim:
        _trim(0)
    spark._jvm.System.gc()


def sweep(spark: SparkSession) -> None:
    """Delete every scratch table of this process; call when results are stored."""
    for path in list(_written):
        drop(spark, path)
    release(spark)
