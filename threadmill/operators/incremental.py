"""Keeping tables current: upserts, content hashes, reuse, repairs and page cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import with_checkpoints


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """old with the rows of new by key; the highest version of a key stays, and of
    equal ones the new table's."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    # One struct is summed up for each key; null versions are the lowest.
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}") for c in old.columns])


def merge_truthy(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fields are overwritten only by values that say something (no null, no '')."""
    n = new.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_there"))
    joined = old.withColumn("_here", F.lit(True)).join(n, key, "full")
    fresh = {c: F.coalesce(F.when(F.col(f"_{c}").cast("string") != "", F.col(f"_{c}")), F.col(c)) for c in columns}
    return joined.withColumns(fresh).drop("_here", "_there", *[f"_{c}" for c in columns])


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Delete and recreate: all children of the parents that new names come from new."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def hash_diff(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """key and state (same, changed, new, removed) by SHA-256 of the text."""
    a = old.select(key, F.sha2(F.col(text), 256).alias("old_hash"), F.lit(True).alias("in_old"))
    b = new.select(key, F.sha2(F.col(text), 256).alias("new_hash"), F.lit(True).alias("in_new"))
    state = F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "removed").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, state.alias("state"))


def reuse_embeddings(chunks: DataFrame, prior: DataFrame, text: str, vector: str, version: str) -> DataFrame:
    """chunks with the vector of a prior chunk of the very same text, if there is one:
    that of the highest version.  Equal SHA-256 hashes are taken for equal texts."""
    known = prior.where(F.col(vector).isNotNull()).select(F.sha2(F.col(text), 256).alias("_h"), F.col(vector).alias("_v"), F.col(version).alias("_version"))
    last = known.groupBy("_h").agg(F.max_by("_v", "_version").alias(vector))
    return chunks.withColumn("_h", F.sha2(F.col(text), 256)).join(last, "_h", "left").select(*chunks.columns, vector)


def unembedded(chunks: DataFrame, vectors: list[str], exclude: DataFrame, key: str) -> DataFrame:
    """Chunks without a vector in any of the columns, but for those excluded."""
    missing = F.lit(True)
    for v in vectors:
        missing = missing & F.col(v).isNull()
    return chunks.where(missing).join(exclude.select(key), key, "left_anti")


def since_checkpoint(df: DataFrame, runs: DataFrame, updated: str, overlap: str = "INTERVAL 1 HOUR") -> DataFrame:
    """Rows that changed since the last completed run began, less an overlap; all
    rows if no run was completed.  Runs are few; theirs is the broadcast side."""
    mark = runs.where("status = 'completed'").agg((F.max("started_at") - F.expr(overlap)).alias("_mark"))
    return df.crossJoin(F.broadcast(mark)).where(F.col("_mark").isNull() | (F.col(updated) >= F.col("_mark"))).drop("_mark")


def stale_runs(runs: DataFrame, now: Column, after: str = "INTERVAL 10 MINUTES") -> DataFrame:
    """Running rows that are older than a live run could be become failed."""
    dead = (F.col("status") == "running") & (F.col("started_at") < now - F.expr(after))
    return runs.withColumn("status", F.when(dead, "failed").otherwise(F.col("status")))


def map_merge(left: Column, right: Column) -> Column:
    """Both maps; the right one wins, and so does a null in it."""
    kept = F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k))
    return F.map_concat(kept, right)


def junk_override(old: Column, override: Column, new: Column) -> Column:
    """A human verdict sticks."""
    return F.when(override, old).otherwise(new)


def without_junk(chunks: DataFrame, before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """chunks but those of rows that have become junk; what is no junk any more gets
    none back.  before and after: key, junk (null: not)."""
    was = before.where("junk").select(key)
    return chunks.join(after.where("junk").select(key).join(was, key, "left_anti"), key, "left_anti")


def crawl(pages: DataFrame, start: str, url: str, links: str, text: str, most: int = 300, shortest: int = 120) -> DataFrame:
    """Breadth-first crawl of a stored corpus: the url and depth of the first ``most``
    pages that start leads to.

    links: absolute targets of each page.  Only pages of start's origin below its
    path are visited; one whose text is shorter than ``shortest`` is no result, but
    its links are followed.  Each round joins the last round's pages only, drops what
    was visited and ends the crawl once there are enough results; it is written
    between rounds by checkpoint().
    """
    with_checkpoints(pages.sparkSession)
    root = start.split("#")[0].split("?")[0]
    origin = "/".join(root.split("/")[:3])
    below = root[: root.rfind("/") + 1] if root.count("/") > 2 else f"{origin}/"
    kept = pages.select(F.col(url).alias("u"), links, (F.length(text) >= shortest).alias("long")).where(F.col("u").startswith(below) | (F.col("u") == start))
    seen = kept.where(F.col("u") == start).select("u", F.lit(0).alias("depth"), "long").dropDuplicates(["u"]).checkpoint()
    last, depth = seen, 0
    while not last.isEmpty() and seen.where("long").limit(most).count() < most:
        depth += 1
        step = kept.join(last.select("u"), "u", "left_semi").select(F.explode(links).alias("u")).distinct()
        last = kept.join(step.join(seen.select("u"), "u", "left_anti"), "u", "left_semi").select("u", F.lit(depth).alias("depth"), "long").dropDuplicates(["u"]).checkpoint()
        seen = seen.unionByName(last)
    return seen.where("long").orderBy("depth", "u").limit(most).select("u", "depth")
