"""Scratch tables in the shared folder that the session names in spark.checkpoint.dir; they end a plan's lineage."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """Folder in spark.checkpoint.dir; where that is unset, a temporary one in a local session, as in tests, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the executors of {master} share")
        root = "file://" + tempfile.mkdtemp(prefix="moiety-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/moiety-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared scratch folder and read it back: lineage ends there.

    ``free`` asks the driver to collect its garbage afterwards, so that large shuffles no longer needed leave the disks."""
    spark, schema = df.sparkSession, df.schema
    root = scratch_root(spark)
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.option("compression", "lz4").parquet(path)
    if free:
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(release)
    return spark.read.schema(schema).parquet(path)


def release() -> None:
    """Delete this application's scratch tables (at exit; earlier only when no result is read any more)."""
    try:
        spark = SparkSession.getActiveSession()
        root = scratch_root(spark)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _ROOTS.discard(root)
    except Exception:  # the JVM may be gone already; the folder's owner removes the rest
        pass
