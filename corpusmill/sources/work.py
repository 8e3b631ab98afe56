"""Work space for intermediate results in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, as Spark resolves them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop_path(spark, path)
    return fs.exists(p)


def replace(spark: SparkSession, source: str, target: str) -> None:
    """The folder source takes the place of target."""
    (a, fs), (b, _) = hadoop_path(spark, source), hadoop_path(spark, target)
    fs.delete(b, True)
    if not fs.rename(a, b):
        raise OSError(f"{source} cannot be renamed to {target}")


def work_dir(spark: SparkSession) -> str:
    """A new path in the shared folder of spark.checkpoint.dir, with its scheme.

    Without that setting a temporary folder serves, on a local master only; on a cluster it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        root = getattr(spark, "_corpusmill_work", None)
        if root is None:
            root = tempfile.mkdtemp(prefix="corpusmill-")
            spark._corpusmill_work = root
    p, fs = hadoop_path(spark, f"{root.rstrip('/')}/corpusmill/{uuid.uuid4().hex}")
    return fs.makeQualified(p).toString()


def clear_work(spark: SparkSession) -> None:
    """Delete all that was written to work folders; for the end of a job, when no result is read any more."""
    p, fs = hadoop_path(spark, work_dir(spark))
    fs.delete(p.getParent(), True)
