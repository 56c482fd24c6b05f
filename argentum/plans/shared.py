"""Tables written on the way: in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where none is named and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="argentum-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = "file://" + folder
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver imported it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    return spark


#: Folders of this process, one for each shared folder: what is in them goes at exit.
_own: dict[str, str] = {}


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the driver's process ends."""
    base = shared_dir(spark)
    if base not in _own:
        _own[base] = f"{base}/argentum-{uuid.uuid4().hex}"
        atexit.register(_delete, _own[base])
    return f"{_own[base]}/{name}-{uuid.uuid4().hex}"


def _delete(path: str) -> None:
    jvm = SparkContext._jvm
    if jvm is None:
        return
    try:
        at = jvm.org.apache.hadoop.fs.Path(path)
        context = SparkContext._active_spark_context
        at.getFileSystem(context._jsc.hadoopConfiguration() if context else jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
    except Exception as e:  # the JVM may have gone before; the tables then stay
        print(f"not deleted: {path} ({type(e).__name__})")


def cut(df: DataFrame, name: str = "step", **options: str) -> DataFrame:
    """Write a table in the shared folder and read it again: a later failure restarts from there. options: of the writer."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
