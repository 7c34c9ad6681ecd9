"""The folder that driver and executors share, and tables written there.

Intermediate results are cut from their lineage by writing them as Parquet under
the folder that the cluster names in ``spark.checkpoint.dir``.  A lost executor
then costs only its running tasks.  Where the setting is absent a local master (as
in tests) uses a folder below ``/tmp/checkpoints``, removed at exit; any other is
an error.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Whether shuffle files go when their query has ended, not when the driver next
#: collects the objects that stood for them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A URI prefix that every executor can read and write."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = f"/tmp/checkpoints/threadmill-{uuid.uuid4().hex}"
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return _OWN["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a table on shared storage: computed once, read back with known sizes.
    Nothing reads its shuffles again, so their files go with the end of the write."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers each that may be broadcast.
BROADCAST_ROWS = 1_000_000


def sized(table: DataFrame) -> DataFrame:
    """A written table of narrow rows as the small side of a join: broadcast if its
    rows, which are counted, are few, and merged after a shuffle otherwise."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table.hint("merge")


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of tables that are written by now.

    Its cleaner removes them when the driver collects the objects that stood for
    them, which an idle driver may not do for half an hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
