"""Tables written on the way: shared between driver and executors, computed once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import with_checkpoints

#: Rows of a few numbers each that may be broadcast.
BROADCAST_ROWS = 1_000_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder."""
    sc = with_checkpoints(spark).sparkContext
    return f"{(sc.getCheckpointDir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the checkpoint folder: a lost executor costs its running tasks."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(table: DataFrame) -> DataFrame:
    """A cheap table of narrow rows as the small side of a join: broadcast if its rows,
    which are counted, are few, and merged after a shuffle otherwise."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table.hint("merge")
