"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Holds the folder of a local session whose checkpoint folder is unset.
LOCAL = "spark.pulsegrid.cuts"
#: Folders that go when the application ends.
MARKED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session (tests, a laptop) may leave it unset; a temporary
    folder takes its place there.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", "") or spark.conf.get(LOCAL, "")
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pulsegrid-")
        spark.conf.set(LOCAL, root)
    return f"{root.rstrip('/')}/cuts-{sc.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again.

    What is read has the sizes of its files, not estimates multiplied through
    every join before it, so loops that cut each round keep small plans and
    sound statistics; a lost executor costs a read.
    """
    spark = df.sparkSession
    root = shared_dir(spark)
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.option("compression", "lz4").parquet(path)
    if root not in MARKED:
        _, file_system, folder = hadoop(spark, root)
        MARKED.add(root)
        file_system.deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def hadoop(spark: SparkSession, path: str):
    """The JVM, the file system of a path, and the path there."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def clear(spark: SparkSession) -> None:
    """Delete what this application has cut so far; frames that still read it must be done."""
    _, file_system, folder = hadoop(spark, shared_dir(spark))
    file_system.delete(folder, True)
