"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine t or more are at most the squared distance 2 - 2t apart.
A seeded rotation spreads that distance over all coordinates; the coordinates are
cut into blocks, and in one block at least the two vectors are no further apart
than the block's share of the distance.  Each block is therefore range-joined on
its own, in a grid over its first coordinates whose cells are as wide as the
block's radius, and whatever any block finds is verified in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import sized, written

THRESHOLD = 0.95
BLOCK_DIMS = 8
GRID_DIMS = 2
#: Home vectors of one grid cell that a task holds (some 600 bytes each at 64
#: dimensions); larger cells are split.
CELL_ROWS = 200_000
#: Pairs that are looked at together.
_PAIRS = 1 << 18
_EPS = 1e-9
#: What a squared distance in single precision may be off; what passes is verified.
_SLACK = 1e-5


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks(dims: int, threshold: float) -> list[tuple[slice, float]]:
    """The coordinates of each block and its share of the squared distance."""
    n = max(1, dims // BLOCK_DIMS)
    cuts = [dims * i // n for i in range(n + 1)]
    return [(slice(a, b), (2 - 2 * threshold) * (b - a) / dims) for a, b in zip(cuts, cuts[1:])]


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(threshold: float, kind: str):
    """Rows of a vector: one for its own cell in each block, and one for each
    neighbouring cell on the upper side, where those of that cell meet it."""
    steps = [s for s in np.ndindex(*[3] * GRID_DIMS)]
    steps = [tuple(x - 1 for x in s) for s in steps]
    steps = [s for s in steps if s > (0,) * GRID_DIMS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch["vec"].to_pylist()
            sizes = np.array([len(v) // np.dtype(kind).itemsize for v in raw], np.int64)
            for dims in np.unique(sizes):
                rows = np.flatnonzero(sizes == dims)
                x = _unit([raw[i] for i in rows], kind) @ rotation(int(dims))
                for b, (part, budget) in enumerate(blocks(int(dims), threshold)):
                    width = math.sqrt(budget) + _EPS
                    cell = np.floor(x[:, part][:, :GRID_DIMS] / width).astype(np.int64)
                    for home, step in [(True, (0,) * GRID_DIMS), *((False, s) for s in steps)]:
                        at = cell + np.array(step)[: cell.shape[1]]
                        if cell.shape[1] < GRID_DIMS and any(step[cell.shape[1] :]):
                            continue
                        # No part of a cell across a corner is near to those far from it.
                        gap = np.where(np.array(step)[: cell.shape[1]] > 0, at * width - x[:, part][:, :GRID_DIMS], np.where(np.array(step)[: cell.shape[1]] < 0, x[:, part][:, :GRID_DIMS] - (at + 1) * width, 0))
                        close = np.flatnonzero((gap**2).sum(axis=1) <= budget + _EPS)
                        at, some = at[close], batch.take(pa.array(rows[close]))
                        name = [f"{dims}/{b}/" + ",".join(map(str, c)) for c in at]
                        yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(np.full(len(close), home)), some["rid"], some["n"], some["vec"]], ["cell", "home", "rid", "n", "vec"])

    return run


def _labels(lab: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Components after joining i and j; labels are the smallest member."""
    while len(i):
        low = np.minimum(lab[i], lab[j])
        np.minimum.at(lab, lab[i], low)
        np.minimum.at(lab, lab[j], low)
        lab = lab[lab]
        lab = lab[lab]
        go = lab[i] != lab[j]
        i, j = i[go], j[go]
    return lab


class _Cell:
    """The home vectors of a cell (or a piece of them), which other rows meet as they come."""

    def __init__(self, cell: str, threshold: float, kind: str):
        dims, b, _ = cell.split("/")
        self.dims, self.block, self.threshold, self.kind = int(dims), int(b), threshold, kind
        self.parts = blocks(self.dims, threshold)
        self.turn = rotation(self.dims)[:, : self.parts[self.block][0].stop]
        self.come: list[pa.RecordBatch] = []
        self.closed = False

    def _read(self, rows: pa.RecordBatch | pa.Table):
        x = _unit(rows["vec"].to_pylist(), self.kind)
        part = (x @ self.turn[:, self.parts[self.block][0]]).astype(np.float32)
        return x, part, (part**2).sum(axis=1), np.asarray(rows["n"]), np.asarray(rows["rid"])

    def _close(self) -> None:
        self.x, self.part, self.sq, self.n, self.rid = self._read(pa.Table.from_batches(self.come))
        self.come, self.closed = [], True
        self.links, self.lab = np.zeros(len(self.rid), np.int64), np.arange(len(self.rid))
        self.lab = self._meet(self.x, self.part, self.sq, self.n, self.links, True)

    def _meet(self, x, part, sq, n, links, own: bool) -> np.ndarray:
        """Counts the links of the homes and of some rows (the homes themselves, if
        own); the labels of both afterwards."""
        most, first = self.parts[self.block][1] + _SLACK, 0 if own else len(self.lab)
        lab = self.lab if own else np.append(self.lab, np.arange(first, first + len(x)))
        # Squared distances, less the most that may be, in one product.
        one = np.ones_like
        homes = np.column_stack([self.part, one(self.sq), self.sq]).T
        rows = np.column_stack([-2 * part, sq - np.float32(most), one(sq)])
        step = max(1, _PAIRS // len(self.x))
        for k in range(0, len(x), step):
            q, p = np.divmod(np.flatnonzero(rows[k : k + step] @ homes <= 0), len(self.x))
            q += k
            if own:
                p, q = p[p < q], q[p < q]
            for m in range(0, len(p), 1 << 16):
                u, v = p[m : m + (1 << 16)], q[m : m + (1 << 16)]
                good = np.einsum("ij,ij->i", self.x[u], x[v]) >= self.threshold
                u, v = u[good], v[good]
                # A pair belongs to the first block that finds it.
                gap = ((self.x[u] - x[v]) @ self.turn) ** 2
                found = [gap[:, c].sum(axis=1) <= budget + _EPS for c, budget in self.parts[: self.block + 1]]
                good = found[-1] & ~np.any([np.zeros(len(u), bool), *found[:-1]], axis=0)
                u, v = u[good], v[good]
                np.add.at(self.links, u, n[v])
                np.add.at(links, v, self.n[u])
                lab = _labels(lab, u, first + v)
        return lab

    def add(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Homes come before all others, which are done with as soon as they have met them."""
        homes = int(np.count_nonzero(np.asarray(rows["left"])))
        if homes:
            self.come.append(rows.slice(0, homes))
        if homes < rows.num_rows:
            if not self.closed:
                self._close()
            x, part, sq, n, rid = self._read(rows.slice(homes))
            links = np.zeros(len(rid), np.int64)
            lab = self._meet(x, part, sq, n, links, False)
            self.lab, to = lab[: len(self.rid)], lab[len(self.rid) :]
            at = np.flatnonzero(links)
            yield _found(rid[at], links[at], self.rid[to[at]])

    def done(self) -> pa.RecordBatch:
        if not self.closed:
            self._close()
        at = np.flatnonzero(self.links)
        return _found(self.rid[at], self.links[at], self.rid[self.lab[at]])


def _found(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rid", "links", "with"])


def _join_cells(threshold: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, at = batch["cell"], np.asarray(batch["at"])
            other = np.asarray(pa.compute.not_equal(cell.slice(1), cell.slice(0, len(cell) - 1))) | (at[1:] != at[:-1])
            edges = [0, *(np.flatnonzero(other) + 1), len(cell)]
            for i, j in zip(edges, edges[1:]):
                name = (cell[i].as_py(), at[i])
                if name != now:
                    if held:
                        yield held.done()
                    now, held = name, _Cell(name[0], threshold, kind)
                yield from held.add(batch.slice(i, j - i))
        if held:
            yield held.done()

    return run


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """key, ``n_links``, ``component_id`` and ``kept`` for every row of df.

    n_links: other rows whose cosine with this one is threshold or more, in double
    precision.  component_id: the smallest key that links lead to, the row's own
    included.  Rows whose vector is null, zero, empty or holds a null or a number
    that is not finite link with nothing and are their own component, and so do
    vectors of different lengths with each other.  Repeated rows and copies are
    rows of their own that link with each other.  A null key is never a component's
    id unless its component has no other, and counts as a row; other columns are
    dropped.  An empty table stays empty.

    Scale: copies are one vector from the start, so a vector that a third of the
    rows share costs no more than another.  A task holds the home vectors of a cell
    and streams what else meets them, so what moves grows with the rows until a
    cell has more than CELL_ROWS homes (at 64 dimensions, some two million random
    directions); then its other rows are sent once for each piece.  The pairs
    looked at grow with the square of a cell.  Tasks return sums and a spanning
    forest, never pairs.
    """
    spark = df.sparkSession
    # Floats travel as floats; every product is formed in double precision.
    kind = "<f4" if df.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    vec = F.col(vector) if kind == "<f4" else F.col(vector).cast("array<double>")
    plain = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    ok = F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & plain, F.lit(False))
    rows = df.select(F.col(key).alias("key"), F.when(ok, vec).alias("v"))
    rows = rows.withColumn("h1", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).withColumn("h2", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v")))
    ids = written(rows.select("key", "h1", "h2"), "vec-rows")

    distinct = rows.where("v is not null").groupBy("h1", "h2").agg(F.first("v").alias("v"), F.min("key").alias("low"), F.count(F.lit(1)).alias("n"))
    distinct = written(distinct.withColumn("rid", F.monotonically_increasing_id()), "vec-distinct")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch["v"]
            flat, offs = np.asarray(v.flatten()).astype(kind), np.asarray(v.offsets) - v.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([batch["rid"], batch["n"], pa.array([flat[a:b].tobytes() for a, b in zip(offs, offs[1:])], pa.binary())], ["rid", "n", "vec"])

    packed = distinct.select("rid", "n", "v").mapInArrow(pack, "rid bigint, n bigint, vec binary")
    cells = packed.mapInArrow(_cells(threshold, kind), "cell string, home boolean, rid bigint, n bigint, vec binary")
    # A cell's homes are held by the task in which its other rows pass by.  Of crowded
    # cells the homes are dealt into pieces, each of which meets what is not in a
    # piece before it.
    crowd = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.count_if("home").alias("homes")).where("homes > 0 and rows > 1")
    crowd = written(crowd.select("cell", F.ceil(F.col("homes") / CELL_ROWS).cast("int").alias("pieces")), "vec-cells")
    # The grid of 64 dimensions has a few thousand cells however many vectors there
    # are; wider vectors have more, so they are counted.
    dealt = cells.join(sized(crowd), "cell")
    piece = F.when(F.col("home"), F.pmod(F.xxhash64(F.lit(2), "rid"), F.col("pieces")).cast("int"))
    dealt = dealt.withColumn("piece", piece).withColumn("at", F.explode(F.sequence(F.lit(0), F.coalesce("piece", F.col("pieces") - 1))))
    dealt = dealt.select("cell", "at", F.coalesce(F.col("at") == F.col("piece"), F.lit(False)).alias("left"), "rid", "n", "vec")
    dealt = dealt.repartition("cell", "at").sortWithinPartitions("cell", "at", F.desc("left"))
    found = dealt.mapInArrow(_join_cells(threshold, kind), "rid bigint, links bigint, with bigint")
    found = written(found, "vec-links")

    roots = connected_components(found.select("rid", "with"), "rid", "with")
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    each = distinct.select("rid", "h1", "h2", "low", "n").join(links, "rid", "left").join(roots.withColumnRenamed("node", "rid"), "rid", "left")
    each = each.withColumn("root", F.coalesce("root", "rid"))
    lows = each.groupBy("root").agg(F.min("low").alias("component"))
    each = each.join(lows, "root").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component")
    out = ids.join(each, ["h1", "h2"], "left")
    component = F.when(F.col("links").isNull(), F.col("key")).otherwise(F.col("component"))
    out = out.select(F.col("key").alias(key), F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
