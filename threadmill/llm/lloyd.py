"""Centroid clustering: Lloyd's rounds with a cover tree on either side.

Vectors are turned into integers, so that sums, means and distances are exact and
the result does not depend on how the rows are dealt out.  Each task lays its
vectors into cover trees of bounded size, once; the trees are written.  In every
round a second cover tree holds the centroids, and both are descended together: a
pair of nodes is dropped when the distance bounds of the balls around them show
that some other centroid is nearer to every vector of the one than any centroid of
the other, and a node of vectors with one centroid left is assigned as a whole, by
its stored sum.  What is left at the leaves is compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

DIMS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
#: Vectors of one tree, and of a node that is not divided further.
TREE_ROWS = 4096
LEAF_ROWS = 16
#: Integer components beyond this could overflow a squared distance.
MOST = 1 << 27
_ROWS = 256


@dataclass
class CoverTree:
    """Nodes in breadth-first order.  A node is a ball around one of its points; its
    points are ``order[start:end]``, those before ``own`` are its own and the rest its
    children's, which are ``first`` to ``first + kids``.

    Centres of a node's parts are within its radius of its centre and more than half
    of that apart; every point lies within that half of its part's centre, so radii
    halve from level to level.  Parts of at most ``leaf`` points are the node's own.
    """

    order: np.ndarray
    nodes: np.ndarray  # start, end, own, centre, first, kids
    radius: np.ndarray

    @staticmethod
    def build(x: np.ndarray, leaf: int) -> "CoverTree":
        y = x.astype(np.float64)
        far = lambda rows, c: np.sqrt(((y[rows] - y[c]) ** 2).sum(axis=1))
        order = np.arange(len(x))
        nodes, radius = [[0, len(x), len(x), 0, 0, 0]], []
        i = 0
        while i < len(nodes):
            start, end, _, centre, _, _ = nodes[i]
            rows = order[start:end]
            d = far(rows, centre)
            radius.append(float(d.max()))
            if len(rows) > leaf and radius[i] > 0:
                near = d <= radius[i] / 2
                parts, rest = [(centre, rows[near])], rows[~near]
                while len(rest):
                    near = far(rest, rest[0]) <= radius[i] / 2
                    parts.append((rest[0], rest[near]))
                    rest = rest[~near]
                small = [p for p in parts if len(p[1]) <= leaf]
                large = [p for p in parts if len(p[1]) > leaf]
                order[start:end] = np.concatenate([p for _, p in small + large])
                at = start + sum(len(p) for _, p in small)
                nodes[i][2], nodes[i][4], nodes[i][5] = at, len(nodes), len(large)
                for c, p in large:
                    nodes.append([at, at + len(p), at + len(p), int(c), 0, 0])
                    at += len(p)
            i += 1
        return CoverTree(order, np.array(nodes, np.int64), np.array(radius))


class Centroids:
    """Centroids and their tree, flattened to items: nodes, then single centroids."""

    def __init__(self, c: np.ndarray):
        self.c, self.y = c, c.astype(np.float64)
        t = CoverTree.build(c, 1)
        self.centre = np.concatenate([t.nodes[:, 3], np.arange(len(c))])
        self.radius = np.concatenate([t.radius, np.zeros(len(c))])
        self.inner = np.arange(len(self.centre)) < len(t.nodes)
        self.parts = [np.concatenate([len(t.nodes) + t.order[s:own], np.arange(f, f + k)]) for s, _, own, _, f, k in t.nodes]
        self.all = [np.sort(t.order[s:e]) for s, e, *_ in t.nodes] + [np.array([i]) for i in range(len(c))]

    def numbers(self, items: np.ndarray) -> np.ndarray:
        return np.sort(np.concatenate([self.all[i] for i in items]))

    def opened(self, items: np.ndarray, which: np.ndarray) -> np.ndarray:
        return np.concatenate([items[~which], *[self.parts[i] for i in items[which]]])


@dataclass
class VectorTree:
    """Some vectors in tree order, their tree and the sum of every node."""

    x: np.ndarray
    nodes: np.ndarray
    radius: np.ndarray

    @cached_property
    def sums(self) -> np.ndarray:
        up = np.vstack([np.zeros((1, self.x.shape[1]), np.int64), np.cumsum(self.x, axis=0)])
        return up[self.nodes[:, 1]] - up[self.nodes[:, 0]]

    def assign(self, cs: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest centroid of every vector (of equally near ones the smallest
        number), and the sum and the count of each centroid's vectors."""
        out = np.zeros(len(self.x), np.int64)
        total, count = np.zeros(cs.c.shape, np.int64), np.zeros(len(cs.c), np.int64)
        centres = self.x[self.nodes[:, 3]].astype(np.float64)
        todo = [(0, np.array([0]))]
        while todo:
            i, items = todo.pop()
            start, end, own, _, first, kids = self.nodes[i]
            r = self.radius[i]
            open_to = r if kids else 0.0  # at a leaf every item is opened
            while True:
                d = np.sqrt(((cs.y[cs.centre[items]] - centres[i]) ** 2).sum(axis=1))
                most = d.min() + r  # a centre is a centroid, so one is as near to every vector
                items = items[d - r - cs.radius[items] <= most * (1 + 1e-9) + 1e-6]
                wide = cs.inner[items] & (cs.radius[items] >= open_to)
                if not wide.any():
                    break
                items = cs.opened(items, wide)
            if len(items) == 1 and not cs.inner[items[0]]:
                n = cs.centre[items[0]]
                out[start:end] = n
                total[n] += self.sums[i]
                count[n] += end - start
                continue
            numbers = cs.numbers(items)
            for a in range(start, own, _ROWS):
                b = min(own, a + _ROWS)
                gap = self.x[a:b, None, :] - cs.c[numbers][None, :, :]
                out[a:b] = numbers[np.einsum("ijk,ijk->ij", gap, gap).argmin(axis=1)]
                np.add.at(total, out[a:b], self.x[a:b])
                np.add.at(count, out[a:b], 1)
            todo += [(k, items) for k in range(first, first + kids)]
        return out, total, count


def _grow(dims: int):
    """Trees of at most TREE_ROWS of a task's vectors each."""

    def tree(keys: list[pa.Array], xs: list[np.ndarray]) -> pa.RecordBatch:
        x, key = np.concatenate(xs), pa.concat_arrays(keys)
        t = CoverTree.build(x, LEAF_ROWS)
        at = np.empty(len(x), np.int64)
        at[t.order] = np.arange(len(x))
        t.nodes[:, 3] = at[t.nodes[:, 3]]  # centres by their place in tree order
        lists = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), key.take(pa.array(t.order)))
        cells = [pa.array([a.tobytes()], pa.binary()) for a in (x[t.order].astype(np.int32), t.nodes, t.radius)]
        return pa.RecordBatch.from_arrays([lists, *cells], ["keys", "x", "nodes", "radius"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, xs, n = [], [], 0
        for batch in batches:
            x = np.asarray(batch["v"].flatten()).reshape(-1, dims)
            for a in range(0, len(x), TREE_ROWS):
                keys.append(batch["key"].slice(a, TREE_ROWS))
                xs.append(x[a : a + TREE_ROWS])
                n += len(xs[-1])
                if n >= TREE_ROWS:
                    yield tree(keys, xs)
                    keys, xs, n = [], [], 0
        if n:
            yield tree(keys, xs)

    return run


def _read(batch: pa.RecordBatch, dims: int) -> Iterator[VectorTree]:
    for x, nodes, radius in zip(batch["x"], batch["nodes"], batch["radius"]):
        vectors = np.frombuffer(x.as_buffer(), np.int32).astype(np.int64).reshape(-1, dims)
        yield VectorTree(vectors, np.frombuffer(nodes.as_buffer(), np.int64).reshape(-1, 6), np.frombuffer(radius.as_buffer(), np.float64))


def _sum(c: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cs = Centroids(c)
        total, count = np.zeros(c.shape, np.int64), np.zeros(len(c), np.int64)
        for batch in batches:
            for t in _read(batch, c.shape[1]):
                _, s, n = t.assign(cs)
                total += s
                count += n
        k, dims = c.shape
        at = np.repeat(np.arange(k), dims)
        cols = [at, np.tile(np.arange(dims), k), total.ravel(), count[at]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["cluster", "dim", "total", "n"])

    return run


def _label(c: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cs = Centroids(c)
        for batch in batches:
            for keys, t in zip(batch["keys"], _read(batch, c.shape[1])):
                near, _, _ = t.assign(cs)
                gap = t.x - c[near]
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(near.astype(np.int32)), pa.array((gap * gap).sum(axis=1))], ["key", "cluster", "distance"])

    return run


def kmeans(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = DIMS, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(assignment, centroids): key, ``cluster`` and ``distance`` (squared) of every
    kept vector, and the final centroids as a matrix of integers.

    Kept are vectors of exactly dims components, none null or not finite, each of
    which becomes floor(256 x); vectors with a component beyond 2**27 after that
    (where a squared distance could leave 64 bits) are left out too.  Centroids
    start as the vectors with the smallest SHA-256 of ``2:<key>`` (equal keys in the
    order of their vectors; a null key starts none); with fewer vectors there are
    fewer centroids.  Repeated rows are vectors of their own, null keys stay null,
    other columns are dropped.  Without a vector that has a key nothing is returned.

    Scale: vectors move nowhere.  The driver sees the first centroids and, each
    round, one row for every centroid and component, summed up before.
    """
    spark = df.sparkSession
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: x * SCALE)
    plain = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MOST))
    rows = df.select(F.col(key).alias("key"), F.when(F.col(vector).isNotNull() & (F.size(vector) == dims) & plain, v).alias("v"))
    rows = rows.where("v is not null").select("key", F.transform("v", lambda x: F.floor(x)).alias("v"))
    name = F.sha2(F.concat(F.lit("2:"), F.col("key").cast("string")), 256)
    start = rows.where("key is not null").select("v").orderBy(name, "v").limit(clusters).collect()
    kind = df.schema[key].dataType.simpleString()
    if not start:
        return spark.createDataFrame([], f"key {kind}, cluster int, distance bigint").withColumnRenamed("key", key), np.zeros((0, dims), np.int64)
    c = np.array([r["v"] for r in start], np.int64)
    trees = written(rows.mapInArrow(_grow(dims), f"keys array<{kind}>, x binary, nodes binary, radius binary"), "lloyd-trees")
    for _ in range(rounds):
        sums = trees.mapInArrow(_sum(c), "cluster bigint, dim bigint, total bigint, n bigint")
        sums = sums.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        c = c.copy()
        for r in sums.where("n > 0").collect():
            c[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    labels = written(trees.mapInArrow(_label(c), f"key {kind}, cluster int, distance bigint"), "lloyd-labels")
    return labels.withColumnRenamed("key", key), c


def clustered(df: DataFrame, key: str = "vec_id", vector: str = "embedding", **settings) -> DataFrame:
    """The assignment of ``kmeans`` with ``cluster_inertia`` and ``inertia`` (distances
    summed over the cluster and over all; null beyond 64 bits) and
    ``centroid_sha256`` (of its components, joined by commas)."""
    labels, c = kmeans(df, key, vector, **settings)
    per = {r["cluster"]: int(r["s"]) for r in labels.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = lambda n: n if n < 1 << 63 else None
    sha = lambda row: hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()
    table = [(k, whole(n), whole(sum(per.values())), sha(c[k])) for k, n in sorted(per.items())]
    table = df.sparkSession.createDataFrame(table, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # At most one row for each centroid.
    return labels.join(F.broadcast(table), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
