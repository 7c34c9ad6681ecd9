"""Walks over numbered pages that stop by what the pages say, without walking.

A walk would ask for one page after another.  Here every page is summed up first, and
a page is walked if it and all pages before it let the walk go on: a running maximum
over the summaries of a brand, of which there is one for each page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import small, written


def first_pages(brands: DataFrame, resume: DataFrame, override: DataFrame) -> DataFrame:
    """brand and start: the override's page, or else where the last run left off, or else
    1.  resume: brand and page, null where a brand's pages are known to end; without an
    override such a brand is not walked, and start is null.  override: brand and page."""
    left = brands.select("brand").join(resume.select("brand", F.struct("page").alias("r")), "brand", "left").join(override.select("brand", F.col("page").alias("o")), "brand", "left")
    return left.select("brand", F.when(F.col("o").isNotNull(), F.col("o")).when(F.col("r").isNotNull(), F.col("r.page")).otherwise(1).alias("start"))


def walk(rows: DataFrame, starts: DataFrame, fresh: Column, inside: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(synced, progress): the rows that a walk of each brand takes, and for each page
    that it visits brand, page, taken, total (taken up to and with it) and last (why
    it is the last, if it is).

    rows: brand, page, session and more, as a source lists them; starts: brand and
    start, null for none.  A walk takes the rows of a page that are fresh and have a
    session.  It ends before a page that the source does not have (``end``) or of which
    nothing is inside a range, if one is given (``range``), and after a page of which
    nothing was fresh (``stale``).
    """
    good = F.coalesce(fresh, F.lit(False)) & F.col("session").isNotNull()
    within = F.coalesce(inside, F.lit(False)) if inside is not None else F.lit(True)
    pages = rows.groupBy("brand", "page").agg(F.count_if(good).alias("taken"), F.count_if(within).alias("inside"))
    pages = pages.join(starts.where("start is not null"), "brand").where("page >= start")
    order = Window.partitionBy("brand").orderBy("page")
    here = F.col("page") == F.col("start") + F.row_number().over(order) - 1
    pages = pages.withColumn("here", here).withColumn("halt", ~F.col("here") | (F.col("inside") == 0))
    up_to, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    halted = F.max("halt").over(up_to) | F.coalesce(F.max(F.col("taken") == 0).over(before), F.lit(False))
    ahead = F.lead(F.struct("here", "inside")).over(order)
    last = F.when(F.col("taken") == 0, "stale").when(ahead.isNull() | ~ahead["here"], "end").when(ahead["inside"] == 0, "range")
    walked = pages.select("brand", "page", "taken", F.sum("taken").over(up_to).alias("total"), last.alias("last"), halted.alias("halted"))
    progress = written(walked.where("not halted").drop("halted"), "walk")
    return rows.where(good).join(small(progress.where("taken > 0").select("brand", "page")), ["brand", "page"], "left_semi"), progress
