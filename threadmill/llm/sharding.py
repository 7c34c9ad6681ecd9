"""A uniform shuffle into shards of exact sizes.

How many rows each input partition sends to each shard is drawn first, from the
multivariate hypergeometric law that a uniform permutation would give.  Each
partition then permutes its rows and deals them out by those counts, and each
shard permutes what it got.  Only DataFrame functions touch the rows.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Rows of a shard that one task puts into their final order.
SLOT_ROWS = 1_000_000
#: The communication matrix is broadcast up to this size and shuffled beyond it.
BROADCAST_BYTES = 32 << 20
_LOCAL = (1 << 33) - 1


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` draws without replacement are good.

    Inversion from the mode outwards with exact ratios of neighbouring
    probabilities; only the mode's own probability uses logarithms of factorials.
    """
    lo, hi = max(0, draws - bad), min(good, draws)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma

    def log_choose(n: int, k: int) -> float:
        return lg(n + 1) - lg(k + 1) - lg(n - k + 1)

    p = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    u = rng.random()
    u -= p
    left = right = mode
    pl = pr = p
    while u > 0 and (left > lo or right < hi):
        if right < hi:
            pr *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            u -= pr
            if u <= 0:
                return right
        if left > lo:
            pl *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= pl
            if u <= 0:
                return left
        if pl < 1e-300 and pr < 1e-300:
            break
    return mode


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """matrix[i][j]: how many rows partition i sends to shard j.

    Row sums are ``rows``, column sums are ``shards``.
    """
    rng = random.Random(seed)
    left = list(shards)
    out = []
    for n in rows:
        line, rest, need = [], sum(left), n
        for j, room in enumerate(left):
            x = hypergeometric(rng, room, rest - room, need) if need else 0
            rest -= room
            need -= x
            line.append(x)
        left = [a - b for a, b in zip(left, line)]
        out.append(line)
    return out


def shard(df: DataFrame, n_shards: int, seed: int = 11) -> DataFrame:
    """df with ``shard`` (0 to n_shards - 1) and ``slot`` (0, 1, ... in each shard).

    Shard sizes differ by one at most.  Every arrangement of the rows is equally
    likely up to the quality of the hash that stands in for random numbers, so
    equal rows, nulls and texts of any length need no care: a row is known by its
    place in the written input, never by its values.  Columns of df that are
    called shard or slot, in any case, are replaced; all others stay, whatever
    their names.  An empty table stays empty.

    The rows are first written to the shared folder, so that the partitions that
    were counted are the ones dealt out whatever executor is lost meanwhile.
    What reaches the driver is one number for each input partition.
    """
    spark = df.sparkSession
    plain = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    # First permutation: inside each input partition, by a hash of the row's place, a
    # sort that moves no row to another task.  _at: the row's place after that (its
    # partition above, its rank in the lower 33 bits); it alone feeds what follows.
    # The input's columns travel as one, so that no name of theirs meets one used here.
    place = df.select(F.struct(*plain).alias("_row"), F.monotonically_increasing_id().alias("_place"))
    permuted = place.sortWithinPartitions(F.xxhash64(F.lit(seed), "_place"), "_place")
    rows = written(permuted.select("_row", F.monotonically_increasing_id().alias("_at")), "shard-input")
    part = F.shiftright("_at", 33)
    counts = sorted((r["_part"], r["n"]) for r in rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in counts)
    sizes = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    matrix = communication_matrix([n for _, n in counts], sizes, seed)
    lines = [{"_part": p, "_ends": [sum(line[: j + 1]) for j in range(n_shards)]} for (p, _), line in zip(counts, matrix)]

    rank = F.col("_at").bitwiseAND((1 << 33) - 1)
    dealt = rows.withColumns({"_part": part, "_rank": rank})
    ends = _table(spark, lines, n_shards)
    ends = F.broadcast(ends) if len(lines) * (n_shards + 4) * 8 <= BROADCAST_BYTES else ends.hint("merge")
    dealt = dealt.join(ends, "_part").withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))).cast("int"))

    # Second permutation: inside each shard, by another hash.  A shard is cut into
    # hash ranges, so that no task has to order a whole shard.
    pieces = max(1, math.ceil(total / n_shards / SLOT_ROWS))
    key = F.xxhash64(F.lit(seed + 1), F.col("_at"))
    piece = F.floor(F.shiftrightunsigned(key, 33) / float(1 << 31) * pieces).cast("int")
    moved = dealt.select("_row", "_at", "shard", key.alias("_key"), piece.alias("_piece"))
    inner = F.row_number().over(Window.partitionBy("shard", "_piece").orderBy("_key", "_at")) - 1
    ranked = moved.withColumn("slot", inner.cast("long"))
    if pieces > 1:
        per = moved.groupBy("shard", "_piece").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
        per = per.select("shard", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        ranked = ranked.join(per, ["shard", "_piece"]).withColumn("slot", F.col("slot") + F.col("_before"))
    return ranked.select("_row.*", "shard", "slot")


def _table(spark, lines: list[dict], n_shards: int) -> DataFrame:
    """The matrix as a table, by way of JSON text so that no Python worker is needed."""
    import json

    kind = "array<struct<_part:bigint,_ends:array<bigint>>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(lines)), kind)))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in slot order."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
