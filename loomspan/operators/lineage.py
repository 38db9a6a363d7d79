"""Lineage cuts outside any one executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> None:
    """Make sure that checkpoints have a folder that all executors share (``spark.checkpoint.dir``). Only a local session where none is
    set gets a private one; on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomspan-")
    context.setCheckpointDir(root)


def fixed(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder: what its rows and their places are read from later never changes, and a
    lost executor costs no recomputation. Spark deletes the files as the table is dropped where its cleaner is set to clean checkpoints."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, label: str) -> str:
    """An empty folder of its own in the shared one; it goes when the driver ends."""
    shared_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(place)
    system.deleteOnExit(place)
    return path
