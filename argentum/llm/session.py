"""What the operators of this subpackage need from the session: shared folder, sizes, shipping."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argentum.plans.shared import cut, place, shared_dir

__all__ = ["cut", "documents", "parts_for", "place", "plan_bytes", "shared_dir", "ship"]

#: Bytes of text that one task of a grouped step should hold.
PART_BYTES = 32 << 20
#: Rows of a batch that goes to a Python worker.
BATCH_ROWS = 1000
#: Settings of the C library's allocator in Python workers.
MALLOC = {"MALLOC_MMAP_THRESHOLD_": str(16 << 20), "MALLOC_TRIM_THRESHOLD_": str(64 << 20), "MALLOC_ARENA_MAX": "2"}


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver imported it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    # Workers give the memory of large arrays back at once instead of keeping it for later.
    for key, value in MALLOC.items():
        env.setdefault(key, value)
    # Texts may be long: the default of 10,000 rows a batch would not bound what a worker holds.
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def plan_bytes(df: DataFrame, column: str = "text") -> int:
    """About how many bytes of text a DataFrame holds: from file sizes where known, else counted."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size < 1 << 50:
        return 2 * size  # text is most of a table, and files hold it compressed
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])


def parts_for(df: DataFrame, column: str = "text", each: int = PART_BYTES) -> int:
    """Number of parts so that each holds about `each` bytes of text."""
    return max(1, -(-plan_bytes(df, column) // each))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The columns named of the table documents."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))
