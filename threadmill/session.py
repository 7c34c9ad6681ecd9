"""A session with the settings that the engine assumes."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def build(master: str | None = None, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """UTC, adaptive execution with skew joins, Arrow.  On a cluster leave master and
    partitions to its own settings; adaptive execution coalesces small partitions."""
    b = SparkSession.builder.appName("threadmill").config("spark.sql.session.timeZone", "UTC")
    b = b.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        b = b.master(master).config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """spark with a checkpoint folder: the one that spark.checkpoint.dir names, which
    driver and executors share.  Only a local master may do without the setting."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not named:
            named = tempfile.mkdtemp(prefix="spark-checkpoints-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return spark
