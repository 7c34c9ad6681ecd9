"""Approximate nearest vectors by an inverted file.

Centroids are fitted on a bounded sample; every vector is written to the list of its
nearest centroid; a query reads the lists of the few centroids nearest to it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import written

LISTS = 100
#: Vectors that centroids are fitted on: so many a list, and so many at least.
SAMPLE_A_LIST = 50
SAMPLE_LEAST = 10_000
ROUNDS = 10
#: Vectors of a list, and queries, that meet in one group, about.
BLOCK_ROWS = 4096


def _unit(vector: str) -> Column:
    """The vector with length 1; null where cosine has no meaning."""
    v = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (norm > 0) & (norm < float("inf"))
    return F.when(ok, F.transform(v, lambda x: x / norm))


def _nearest(centroids: np.ndarray, n: int):
    """The n centroids nearest to a unit vector, nearest first."""

    @F.pandas_udf("array<int>")
    def lists(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        near = -(np.stack(v.to_numpy()) @ centroids.T)
        return pd.Series(list(np.argsort(near, axis=1, kind="stable")[:, :n].astype(np.int32)))

    return lists


def units(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key and v of every vector that has a direction.  Vectors that are null or zero or
    hold null or non-finite components are not in an index by cosine."""
    return vectors.select(F.col(key).alias("key"), _unit(vector).alias("v")).where("v is not null")


def fit(rows: DataFrame, lists: int = LISTS, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Centroids of unit vectors by Lloyd's rounds over a seeded sample of about
    max(SAMPLE_A_LIST lists, SAMPLE_LEAST) rows.  They start as the sample's rows of
    smallest hash; a centroid without vectors stays where it is.  The driver sees
    lists x dimensions numbers each round."""
    most = max(SAMPLE_A_LIST * lists, SAMPLE_LEAST)
    share = min(1.0, most / max(1, rows.count()))
    mark = F.xxhash64(F.lit(seed), "key")
    sample = written(rows.withColumn("mark", mark).where(F.pmod("mark", F.lit(1 << 20)) < int(share * (1 << 20))), "ivf-sample")
    c = np.array([r["v"] for r in sample.orderBy("mark", "key").select("v").limit(lists).collect()])
    for _ in range(rounds if len(c) else 0):
        at = sample.select(_nearest(c, 1)("v")[0].alias("list"), F.posexplode("v").alias("i", "x"))
        c = c.copy()
        for r in at.groupBy("list", "i").agg(F.avg("x").alias("x")).collect():
            c[r["list"], r["i"]] = r["x"]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
    return c


def build(vectors: DataFrame, key: str, vector: str, path: str, lists: int = LISTS, rounds: int = ROUNDS) -> None:
    """The index of all vectors in a new folder: lists as partitions, and centroids.

    All vectors are of one length.  A list of very many vectors is split between tasks
    when it is written.
    """
    spark = vectors.sparkSession
    rows = units(vectors, key, vector)
    c = fit(rows, lists, rounds)
    spark.createDataFrame([(i, v) for i, v in enumerate(c.tolist())], "list int, v array<double>").write.parquet(f"{path}/centroids")
    rows.limit(0).write.parquet(f"{path}/empty")  # says of what type keys are, if there is no list
    near = _nearest(c, 1)("v")[0] if len(c) else F.lit(0)
    rows.withColumn("list", near).hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/lists")


def centroids(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r["v"] for r in spark.read.parquet(f"{path}/centroids").orderBy("list").collect()])


def _lists(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(f"{path}/empty").schema
    return spark.read.schema(schema.add("list", T.IntegerType())).parquet(f"{path}/lists")


def topk(spark: SparkSession, path: str, queries: DataFrame, key: str, vector: str, probes: int, k: int) -> DataFrame:
    """query, key, similarity and place of the k nearest vectors in the probes nearest
    lists of each query; with as many probes as lists the exact k nearest.

    Queries are dealt to their lists and meet only those, which are the only ones read;
    blocks of queries meet blocks of vectors, and each such meeting returns k rows for
    each query.  Of equal similarities the smaller key comes first.  Queries without a
    direction find nothing.
    """
    c = centroids(spark, path)
    asked = units(queries, key, vector).select(F.col("key").alias("query"), F.col("v").alias("q"))
    if not len(c):
        kind = _lists(spark, path).schema["key"].dataType.simpleString()
        return asked.select("query", F.lit(None).cast(kind).alias("key"), F.lit(0.0).alias("similarity"), F.lit(0).alias("place")).where("false")
    asked = written(asked.select("query", "q", F.explode(_nearest(c, min(probes, len(c)))("q")).alias("list")), "ivf-asked")
    n_asked = asked.groupBy("list").agg(F.count(F.lit(1)).alias("asked"))
    named = [r["list"] for r in n_asked.select("list").collect()]
    rows = _lists(spark, path).where(F.col("list").isin(named))
    # One row for each list.
    plan = rows.groupBy("list").agg(F.count(F.lit(1)).alias("held")).join(n_asked, "list")
    parts = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK_ROWS).cast("int"), F.lit(1))
    plan = F.broadcast(written(plan.select("list", parts("held").alias("pieces"), parts("asked").alias("blocks")), "ivf-plan"))
    mine = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = rows.join(plan, "list").select("list", mine("key", "pieces").alias("piece"), every("blocks").alias("block"), "key", "v")
    asking = asked.join(plan, "list").select("list", every("pieces").alias("piece"), mine("query", "blocks").alias("block"), "query", "q")
    by = ("list", "piece", "block")
    kinds = ", ".join(f"{n} {t.schema[n].dataType.simpleString()}" for t, n in ((asking, "query"), (held, "key")))
    scored = held.groupBy(*by).cogroup(asking.groupBy(*by)).applyInArrow(_best(k), f"{kinds}, similarity double")
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def _best(k: int):
    """The k best of some vectors for each of some queries."""

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return np.asarray(column.combine_chunks().flatten()).reshape(len(column), -1)

    def run(held: pa.Table, asking: pa.Table) -> pa.Table:
        empty = pa.table({"query": asking["query"].slice(0, 0), "key": held["key"].slice(0, 0), "similarity": pa.array([], pa.float64())})
        if not len(held) or not len(asking):
            return empty
        held = held.sort_by("key")  # of equal similarities the smaller key is first
        v, out = matrix(held["v"]), [empty]
        for a in range(0, len(asking), 64):
            some = asking.slice(a, 64)
            # Summed in the same order for every pair, so that copies are equally near.
            s = np.einsum("id,jd->ij", matrix(some["q"]), v)
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            row = np.repeat(np.arange(len(some)), top.shape[1])
            out.append(pa.table({"query": some["query"].take(pa.array(row)), "key": held["key"].take(pa.array(top.ravel())), "similarity": s[row, top.ravel()]}))
        return pa.concat_tables(out)

    return run


def nearest_to(spark: SparkSession, path: str, query: list[float], probes: int, k: int) -> DataFrame:
    """key and similarity of the nearest vectors to one query: only its lists are read."""
    c = centroids(spark, path)
    q = np.array(query, np.float64)
    q = q / np.linalg.norm(q)
    lists = np.argsort(-(c @ q), kind="stable")[:probes].tolist() if len(c) else []
    rows = _lists(spark, path).where(F.col("list").isin(lists))
    dot = F.aggregate(F.zip_with(F.array(*map(F.lit, q.tolist())), "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return rows.select("key", dot.alias("similarity")).orderBy(F.desc("similarity"), "key").limit(k)
