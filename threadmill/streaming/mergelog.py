"""A table kept current by changes: batches are appended, merged when they are read, and
what fails is kept and holds the checkpoint back.

A batch costs what it brings, whatever the table holds.  It is written in two steps:
its changes and its failures, each in a folder of its number, then its commit.  Without
a commit a batch is not there, and when it is run again it replaces what it left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMIT = "epoch bigint, base boolean, mark timestamp"


def commits(spark: SparkSession, path: str, schema: str = _COMMIT) -> DataFrame:
    """epoch, base and mark (how far the batch's source was read) of every commit."""
    return spark.read.schema(schema).parquet(f"{path}/commits")


def create(spark: SparkSession, path: str, columns: str) -> None:
    """An empty table of these columns; doing it again changes nothing that is there."""
    none = spark.createDataFrame([], columns)
    none.write.mode("ignore").parquet(f"{path}/schema")
    spark.createDataFrame([(-1, True, None)], _COMMIT).coalesce(1).write.mode("ignore").parquet(f"{path}/commits/e=-1")


def _schema(spark: SparkSession, path: str):
    return spark.read.parquet(f"{path}/schema").schema


def commit_batches(path: str, keys: list[str], updated: str, good: Column, retry: Callable[[DataFrame], DataFrame] | None = None):
    """A foreachBatch function.  Rows that are not good are given to retry once; what is
    not good then goes to the dead letters.  updated: the column by which the source is
    read on.  A batch's own order does not matter: of a key's rows the newest counts."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        columns = _schema(spark, path)
        fits = F.coalesce(good, F.lit(False))
        batch = batch.select(columns.names)
        again = batch.where(~fits)
        if retry is not None:
            again = retry(again).select(columns.names)
        batch.where(fits).unionByName(again.where(fits)).write.mode("overwrite").parquet(f"{path}/changes/e={epoch}")
        again.where(~fits).write.mode("overwrite").parquet(f"{path}/dead/e={epoch}")
        commit(spark, path, epoch, batch.agg(F.max(updated)).first()[0])

    return write


def commit(spark: SparkSession, path: str, epoch: int, mark, base: bool = False) -> None:
    rows = spark.createDataFrame([(epoch, base, mark)], _COMMIT)
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/e={epoch}{'.base' if base else ''}")


def _rows(spark: SparkSession, path: str, what: str, epochs: list[int]) -> DataFrame:
    schema = _schema(spark, path)
    out = spark.createDataFrame([], schema).withColumn("_epoch", F.lit(0).cast("long"))
    if epochs:
        found = spark.read.schema(schema).option("basePath", f"{path}/{what}").parquet(*[f"{path}/{what}/e={e}" for e in epochs])
        # The folder says of which batch a row is.
        number = F.regexp_extract(F.col("_metadata.file_path"), r"/e=(-?\d+)/", 1).cast("long")
        out = found.select(*schema.names, number.alias("_epoch"))
    return out


def _live(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """The newest base, and the batches after it."""
    done = commits(spark, path).where("epoch >= 0").select("epoch", "base").collect()
    base = max((r["epoch"] for r in done if r["base"]), default=None)
    return base, sorted(r["epoch"] for r in done if not r["base"] and (base is None or r["epoch"] > base))


def read(spark: SparkSession, path: str, keys: list[str], updated: str) -> DataFrame:
    """The table: for each key and column the newest value that says something.

    Newest is by updated, then by batch; a null leaves what is there.
    """
    base, epochs = _live(spark, path)
    rows = _rows(spark, path, "changes", epochs)
    if base is not None:
        rows = rows.unionByName(_rows(spark, path, "bases", [base]))
    rest = [c for c in rows.columns if c not in (*keys, "_epoch")]
    order = F.struct(F.col(updated), F.col("_epoch"))
    newest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in rest]
    return rows.groupBy(*keys).agg(*newest)


def compact(spark: SparkSession, path: str, keys: list[str], updated: str) -> None:
    """Everything up to the newest batch as one base; reading starts from it."""
    base, epochs = _live(spark, path)
    if not epochs:
        return
    read(spark, path, keys, updated).write.mode("overwrite").parquet(f"{path}/bases/e={epochs[-1]}")
    commit(spark, path, epochs[-1], None, base=True)


def dead_letters(spark: SparkSession, path: str, keys: list[str], updated: str) -> DataFrame:
    """Rows that failed twice and have not come through since, with their batch."""
    done = [r["epoch"] for r in commits(spark, path).where("epoch >= 0 and not base").select("epoch").collect()]
    dead = _rows(spark, path, "dead", done)
    came = _rows(spark, path, "changes", done).groupBy(*keys).agg(F.max("_epoch").alias("_since"))
    return dead.join(came, keys, "left").where("_since is null or _since < _epoch").drop("_since")


def checkpoint(spark: SparkSession, path: str, keys: list[str], updated: str):
    """From when on the source is to be read again: what its newest batch reached, or the
    oldest row that is still a dead letter; null if nothing was read yet."""
    reached = commits(spark, path).where("not base").agg(F.max("mark")).first()[0]
    held = dead_letters(spark, path, keys, updated).agg(F.min(updated)).first()[0]
    return reached if held is None or reached is None else min(reached, held)
