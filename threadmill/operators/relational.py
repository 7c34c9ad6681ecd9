"""Work queues, lists, coverage and resume logic as DataFrame operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def all_of(predicates: list[Column | None]) -> Column:
    """AND of those that are given; true if none is."""
    return reduce(lambda a, b: a & b, [p for p in predicates if p is not None], F.lit(True))


def contains_ci(column: Column, needle: str) -> Column:
    """Substring match without case, and without wildcards in the needle."""
    return F.contains(F.lower(column), F.lower(F.lit(needle)))


def listed(conversations: DataFrame, key: str, files: DataFrame, chunks: DataFrame, *, state: str | None = None, brand=None, tag: str | None = None, email: str | None = None, operator=None, attachment: bool = False, junk: str | None = None, preview: str | None = None, since: Column | None = None, until: Column | None = None, product: str | None = None) -> DataFrame:
    """Conversations for which every given filter holds; an empty filter is none.

    conversations: key, state, brand, tags, email, operator, junk, preview,
    last_message_at.  email and preview are substrings in any case, the preview's
    trimmed; junk is "hide" or "only"; since and until belong to the range; a product
    is that of a chunk (key, product) or a tag.  A null never passes a filter on its
    column.  files: key.  The free search is ``found_or_like`` on top.
    """
    cut = (preview or "").strip()
    c = conversations.where(
        all_of(
            [
                F.col("state") == state if state else None,
                F.col("brand") == brand if brand else None,
                F.array_contains("tags", tag) if tag else None,
                contains_ci(F.col("email"), email) if email else None,
                F.col("operator") == operator if operator else None,
                F.col("junk") == (junk == "only") if junk in ("hide", "only") else None,
                contains_ci(F.col("preview"), cut) if cut else None,
                F.col("last_message_at") >= since if since is not None else None,
                F.col("last_message_at") <= until if until is not None else None,
            ]
        )
    )
    if attachment:
        c = c.join(files.select(key), key, "left_semi")
    if not product:
        return c
    held = chunks.where(F.col("product") == product).select(key).distinct().withColumn("_product", F.lit(True))
    tagged = F.coalesce(F.array_contains("tags", product), F.lit(False))
    return c.join(held, key, "left").where(F.col("_product").isNotNull() | tagged).drop("_product")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of an ordered list; numbers start at 1, sizes are held to 1..100."""
    number, size = max(1, number), min(100, max(1, size))
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def n_pages(total: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / size))


# Work queue tabs.  ``cut`` is the moment before which a clock is due; null clocks are never due.
def flagged(cut: Column) -> Column:
    """Still open, and a reply has come or a promise is due."""
    due = F.coalesce(F.col("promised_at") <= cut, F.lit(False))
    return (F.col("status") != "dismissed") & (F.col("has_reply") | due)


def backlog(cut: Column) -> Column:
    """Open and new, but not flagged."""
    return (F.col("status") == "new") & ~flagged(cut)


def needs_reply(cut: Column) -> Column:
    return flagged(cut) | backlog(cut)


def needs_resolved(cut: Column) -> Column:
    waited = F.coalesce(F.col("waiting_since") <= cut, F.lit(False))
    return (F.col("status") != "dismissed") & waited & ~F.col("resolved")


def tab_counts(threads: DataFrame, cut: Column) -> DataFrame:
    """Every tab's size in one pass."""
    tabs = {"needs_reply": needs_reply(cut), "flagged": flagged(cut), "backlog": backlog(cut), "needs_resolved": needs_resolved(cut), "dismissed": F.col("status") == "dismissed", "drafted": F.col("status") == "drafted", "every": F.lit(True)}
    return threads.agg(*[F.count_if(p).alias(name) for name, p in tabs.items()])


def whole_days(since: Column, now: Column) -> Column:
    return F.floor((F.unix_millis(now.cast("timestamp")) - F.unix_millis(since.cast("timestamp"))) / DAY_MS)


def _winner(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key whose order is the smallest.  An aggregate of one struct, so
    a key with very many rows is summed up before the shuffle and needs no sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}") for c in df.columns])


def newest_per_key(df: DataFrame, keys: list[str], time: str, position: str) -> DataFrame:
    """The newest row of each key (undated ones last); of equally new ones, the first."""
    return _winner(df, keys, [F.col(time).isNull(), -F.unix_micros(F.col(time).cast("timestamp")), F.col(position)])


def first_per_key(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """First wins: unlike dropDuplicates, it depends on the position, not on luck."""
    return _winner(df, keys, [F.col(position)])


def coverage(df: DataFrame, time: str) -> DataFrame:
    """Rows of each month (UTC); undated ones are left out."""
    known = df.where(F.col(time).isNotNull())
    return known.groupBy(F.year(time).alias("year"), F.month(time).alias("month")).agg(F.count(F.lit(1)).alias("n"))


def intensity(count: Column, most: Column) -> Column:
    """0 for nothing, else 1 to 4 by the square root of the share of the most."""
    share = F.sqrt(count / most)
    return F.when((count <= 0) | (most <= 0), 0).when(share <= 0.25, 1).when(share <= 0.5, 2).when(share <= 0.75, 3).otherwise(4)


def coverage_grid(months: DataFrame, max_years: int = 15) -> DataFrame:
    """All months of all years from the first to the last (the last max_years of
    them), with counts and levels; the most is that of all months."""
    span = months.agg(F.min("year").alias("a"), F.max("year").alias("b"), F.max("n").alias("most")).where("a is not null")
    first = F.greatest(F.col("a"), F.col("b") - (max_years - 1))
    cells = span.select("most", F.explode(F.sequence(first, F.col("b"))).alias("year")).withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    grid = cells.join(months, ["year", "month"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return grid.select("year", "month", "n", intensity(F.col("n"), F.col("most")).alias("level"))


def explode_counts(df: DataFrame, tags: Column) -> DataFrame:
    """Rows of each tag, blank ones left out, most frequent first, then by name."""
    each = df.select(F.explode(tags).alias("tag")).where(F.trim("tag") != "")
    return each.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag")


def resume_pages(runs: DataFrame) -> DataFrame:
    """brand and the page to go on from, by its runs' page maps.

    runs: run, started_at, pages (brand -> struct(from, to, synced, ceiling)).  A
    run moved a brand on if it synced something or went past its first page.  A
    brand whose latest run hit the ceiling has no page to go on from (null).
    """
    each = runs.select("run", "started_at", F.explode("pages").alias("brand", "p"))
    moved = (F.col("p.synced") > 0) | (F.col("p.to") > F.col("p.from"))
    g = each.groupBy("brand").agg(F.max(F.when(moved, F.col("p.to"))).alias("top"), F.max_by("p.ceiling", F.struct("started_at", "run")).alias("ceiling"))
    return g.select("brand", F.when(~F.col("ceiling"), F.greatest(F.coalesce("top", F.lit(1)), F.lit(1))).alias("page"))


def range_stats(df: DataFrame, updated: str, created: str, start: Column, end: Column) -> DataFrame:
    """How a page of rows lies to a window: rows without a date are neither in nor out."""
    basis = F.coalesce(F.col(updated), F.col(created))
    inside = lambda c: c.between(start, end)
    return df.agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if(inside(basis)).alias("basis_in"),
        F.count_if(~inside(basis)).alias("basis_out"),
        F.count_if(inside(F.col(updated))).alias("in_by_updated"),
        F.count_if(inside(F.col(created))).alias("in_by_created"),
    )


def either_parent(child: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Children with a match on one of two parents: marks from two joins and one OR,
    so a child with both parents is returned once."""
    a = left.select(F.col(left_key)).distinct().withColumn("_a", F.lit(True))
    b = right.select(F.col(right_key)).distinct().withColumn("_b", F.lit(True))
    marked = child.join(a, left_key, "left").join(b, right_key, "left")
    return marked.where(F.coalesce("_a", F.lit(False)) | F.coalesce("_b", F.lit(False))).drop("_a", "_b")


def child_counts(parents: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    """Every parent with the number of its children, 0 included."""
    n = children.groupBy(F.col(child_key).alias(key)).agg(F.count(F.lit(1)).alias("n_children"))
    return parents.join(n, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def set_null_on_delete(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """ON DELETE SET NULL: the key of children whose parent was deleted becomes null."""
    gone = deleted.select(F.col(key)).distinct().withColumn("_gone", F.lit(True))
    return children.join(gone, key, "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")


def cascade_on_delete(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """ON DELETE CASCADE: children of deleted parents are gone."""
    return children.join(deleted.select(key), key, "left_anti")
