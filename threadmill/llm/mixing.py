"""Mixing sources to target weights by fitting each source's budget exactly.

Every source gets a word budget.  Whole passes over the source come first (each
document once per pass).  What is left of the budget is a subset-sum problem
over document lengths: a histogram of exact lengths is enough to solve it, so
the documents themselves are only touched when a number of them is picked from
each length.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .textbatch import slices

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_REPEATS = 2
#: The dynamic programme is given so many times the longest document's words.
DP_SPAN = 4
#: Documents of one source and length that one task ranks.
RANK_ROWS = 50_000


def count_words(text: pd.Series) -> pd.Series:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each whole text; 0 for a null."""
    parts = [np.bincount(s.words[2], minlength=s.n) for s in slices(pa.array(text, pa.large_string(), from_pandas=True))]
    return pd.Series(np.concatenate(parts) if parts else np.zeros(0, np.int64), dtype="int64")


def fit_budget(length: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum to at
    most ``budget`` and as near to it as the programme finds.

    The lengths first give like shares of their words, up to DP_SPAN times the
    longest length below the budget, so that the choice keeps the source's length
    profile: every length takes what brings the words so far nearest to its part
    of that sum.  The rest, which has the same size for every budget, is a bounded
    knapsack: ``via[s]`` is the length that first reached the sum s.  Lengths of 0
    are never taken.
    """
    length, count = np.asarray(length, np.int64), np.where(np.asarray(length) > 0, np.asarray(count, np.int64), 0)
    take = np.zeros_like(count)
    total = int((length * count).sum())
    if budget <= 0 or total <= 0:
        return take
    if budget >= total:
        return count
    goal = max(0, budget - DP_SPAN * int(length.max()))
    seen = done = 0
    for i in np.argsort(-length):
        step, n = int(length[i]), int(count[i])
        if n:
            seen += step * n
            take[i] = min(n, max(0, (goal * seen // total - done + step // 2) // step))
            done += int(take[i]) * step
    rest = budget - done
    via, reached = np.zeros(rest + 1, np.int64), np.zeros(rest + 1, bool)
    reached[0] = True
    for i in np.argsort(-length):
        step, spare = int(length[i]), int(count[i] - take[i])
        if not 0 < step <= rest or reached[rest]:
            continue
        edge = reached
        for _ in range(min(spare, rest // step)):
            new = np.zeros_like(reached)
            new[step:] = edge[:-step]
            new &= ~reached
            if not new.any():
                break
            via[new] = i + 1
            reached = reached | new
            edge = new
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i = int(via[at]) - 1
        take[i] += 1
        at -= int(length[i])
    return take


def targets(sources: DataFrame, share: float = SHARE) -> DataFrame:
    """source, words -> with ``target``.

    Weights repeat over the sources in code-point order, null last.  A target
    stops at MAX_REPEATS times its source's words and the excess is shared again
    by weight until none is above.  Places in the order come from sorted
    partitions and how many rows each has; every round of sharing is one sum over
    the sources, so no source's row has to pass a single task.
    """
    ordered = sources.repartitionByRange(F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id())
    ordered = written(ordered, "mix-sources")
    place, offsets = 0, {}
    for part, n in sorted(tuple(r) for r in ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets[part], place = place, place + n
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1
    before = F.element_at(F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair]), F.col("part")) if offsets else F.lit(0)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((before + within) % len(WEIGHTS) + 1).cast("int"))
    s = ordered.select("source", "words", weight.alias("weight"), (MAX_REPEATS * F.col("words")).cast("double").alias("cap"))
    s = written(s, "mix-weights")
    words, full, open_ = s.agg(F.sum("words"), F.lit(0.0), F.sum("weight")).first()
    budget, level = share * (words or 0), 0.0
    while open_:
        last, level = open_, (budget - full) / open_
        above = F.col("cap") < F.lit(level) * F.col("weight")
        full, open_ = s.agg(F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if open_ == last:
            break
    return s.select("source", "words", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def mix_plan(docs: DataFrame, key: list[str], source: str = "source", text: str = "text", seed: int = 7, share: float = SHARE) -> DataFrame:
    """key columns, size, source_size, target and ``times`` for every row of docs.

    ``times`` (0 to MAX_REPEATS) is how often the mix takes the row.  A null text
    has size 0 and is never taken, nor are empty texts; a null source is a source
    of its own, in last place.  Rows that are equal in every way are told apart
    by nothing, so which of them is taken does not matter.  Reruns agree: picks
    follow a seeded hash of the key, the text and the source.

    Scale: one scan counts words; sizes without texts are written to the shared
    folder; shuffles carry a few numbers per row.  A source or a length that
    holds most rows is ranked in pieces of RANK_ROWS by hash range.
    """
    src, n_words = F.col(source), F.pandas_udf(count_words, "bigint")
    rank = F.xxhash64(F.lit(seed), *[F.col(k) for k in key], F.col(text), src)
    sized = docs.select(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(key)], src.alias("source"), n_words(text).alias("size"), rank.alias("pick"))
    sized = written(sized, "mix-sizes")
    hist = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    hist = written(hist, "mix-lengths")
    goal = targets(hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words")), share)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        words, target = int(pdf["words"].iat[0]), float(pdf["target"].iat[0])
        passes = min(MAX_REPEATS, int(target // words)) if words else 0
        budget = math.floor(target + 0.5) - passes * words
        more = fit_budget(pdf["size"].to_numpy(), pdf["n"].to_numpy(), budget) if passes < MAX_REPEATS else 0
        out = pdf[["source", "size", "n", "words", "target"]].copy()
        out["passes"], out["more"] = passes, more
        return out

    # Groups are a source's distinct lengths: at most the square root of twice its words.
    same = F.col("h.source").eqNullSafe(F.col("g.source"))
    budgeted = hist.alias("h").join(goal.alias("g"), same).select("h.source", "h.size", "h.n", "g.words", "g.target")
    plan = budgeted.groupBy("source").applyInPandas(fit, "source string, size bigint, n bigint, words bigint, target double, passes int, more bigint")
    plan = written(plan, "mix-plan")

    same = F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size"))
    chosen = sized.alias("d").join(plan.alias("p"), same).select("d.*", F.col("p.n").alias("n"), "p.words", "p.target", "p.passes", "p.more")
    # The picks of a length are its ``more`` smallest hashes.  The hash range is
    # cut into pieces; pieces wholly below or above the cut need no ranking.
    pieces = F.ceil(F.col("n") / RANK_ROWS)
    unit = F.shiftrightunsigned("pick", 33) / float(1 << 31)
    chosen = chosen.withColumn("piece", F.least(F.floor(unit * pieces), pieces - 1))
    open_, fixed = F.col("more").between(1, F.col("n") - 1), ~F.col("more").between(1, F.col("n") - 1)
    part = Window.partitionBy("source", "size", "piece").orderBy("pick", *[f"key_{i}" for i in range(len(key))])
    per_piece = chosen.where(open_ & (F.col("n") > RANK_ROWS)).groupBy("source", "size", "piece").agg(F.count(F.lit(1)).alias("rows"))
    below = Window.partitionBy("source", "size").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    per_piece = per_piece.withColumn("below", F.coalesce(F.sum("rows").over(below), F.lit(0))).drop("rows")
    same = F.col("c.source").eqNullSafe(F.col("b.source")) & (F.col("c.size") == F.col("b.size")) & (F.col("c.piece") == F.col("b.piece"))
    ranked = chosen.where(open_).withColumn("rank", F.row_number().over(part)).alias("c").join(per_piece.alias("b"), same, "left")
    ranked = ranked.select("c.*", F.coalesce("b.below", F.lit(0)).alias("below"))
    extra = F.when(F.col("below") + F.col("rank") <= F.col("more"), 1).otherwise(0)
    keys = [F.col(f"key_{i}").alias(k) for i, k in enumerate(key)]
    cols = [*keys, F.col("source").alias("mix_source"), "size", F.col("words").alias("source_size"), "target"]
    some = ranked.select(*cols, (F.col("passes") + extra).alias("times"))
    rest = chosen.where(fixed).select(*cols, (F.col("passes") + F.when(F.col("more") > 0, 1).otherwise(0)).alias("times"))
    return some.unionByName(rest).withColumn("times", F.when(F.col("size") > 0, F.col("times")).otherwise(0))
