"""Imports where what came before decides: a row is skipped if an earlier row that was
taken has one of its names.

One row after another would be a loop.  Here a row is taken as soon as no undecided
row before it shares a name with it, and whatever shares a name with a taken row is
out; both are aggregations and joins, repeated until every row is decided.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.desk import matcher_key, slugify
from ..tables import written


def first_free(rows: DataFrame, existing: DataFrame, names: list[str], order: str) -> DataFrame:
    """Rows that an import in the order of ``order`` (distinct) takes: none of their
    names (in any case) is in existing or among those of a row taken before.  A null
    name is no one's."""
    low = [F.lower(n).alias(f"n{i}") for i, n in enumerate(names)]
    left = rows.select(F.col(order).alias("at"), *low)
    for i, n in enumerate(names):
        known = existing.select(F.lower(n).alias(f"n{i}")).where(F.col(f"n{i}").isNotNull()).distinct()
        left = left.join(known, f"n{i}", "left_anti")
    taken = []
    left = written(left, "import-left")
    while not left.isEmpty():
        ahead = left
        for i in range(len(names)):
            first = left.where(F.col(f"n{i}").isNotNull()).groupBy(f"n{i}").agg(F.min("at").alias(f"first{i}"))
            ahead = ahead.join(first, f"n{i}", "left")
        free = [F.col(f"n{i}").isNull() | (F.col("at") == F.col(f"first{i}")) for i in range(len(names))]
        marked = written(ahead.select("at", *[f"n{i}" for i in range(len(names))], reduce(Column.__and__, free).alias("free")), "import-round")
        now = marked.where("free").drop("free")
        taken.append(now.select("at"))
        left = marked.where("not free").drop("free")
        for i in range(len(names)):
            left = left.join(now.select(f"n{i}").where(F.col(f"n{i}").isNotNull()), f"n{i}", "left_anti")
        left = written(left, "import-left")
    if not taken:
        return rows.where("false")
    return rows.join(reduce(DataFrame.unionByName, taken).withColumnRenamed("at", order), order, "left_semi").select(rows.columns)


def free_slugs(taken: DataFrame, existing: DataFrame, base: str, other: str, order: str, slug: str = "slug") -> DataFrame:
    """taken with slug: base, or base and other where base is used by then, in existing
    or by an earlier row (in any case).

    Of rows with the same base all but the first are certain to find it used; the first
    finds it used if an earlier row's longer slug is the same, which may make another
    one longer in turn.
    """
    rows = taken.select(F.col(order).alias("at"), F.lower(base).alias("base"), F.lower(F.concat_ws("-", base, other)).alias("longer"))
    first = rows.groupBy("base").agg(F.min("at").alias("first"))
    known = existing.select(F.lower(slug).alias("base")).where("base is not null").distinct().withColumn("known", F.lit(True))
    state = rows.join(first, "base").join(known, "base", "left")
    state = written(state.select("at", "base", "longer", (F.col("known").isNotNull() | (F.col("at") > F.col("first"))).alias("used")), "import-slugs")
    while True:
        longer = state.where("used").groupBy(F.col("longer").alias("base")).agg(F.min("at").alias("since"))
        more = state.where("not used").join(longer, "base").where("since < at").select("at", F.lit(True).alias("now"))
        more = written(more, "import-slugs-more")
        if more.isEmpty():
            break
        state = written(state.join(more, "at", "left").select("at", "base", "longer", (F.col("used") | F.col("now").isNotNull()).alias("used")), "import-slugs")
    used = state.select(F.col("at").alias(order), "used")
    return taken.join(used, order).withColumn(slug, F.when(F.col("used"), F.concat_ws("-", base, other)).otherwise(F.col(base))).drop("used")


def import_products(listed: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """order, name, page, slug and keywords of the listed products that are new.

    listed: order, page (the product's address) and name; existing: name, slug and
    page.  The page is a keyword if the name without white space does not say it.
    """
    taken = first_free(listed.select(order, "page", "name"), existing.select("page", "name"), ["page", "name"], order)
    named = written(taken.withColumn("base", F.coalesce(F.nullif(slugify(F.col("name")), F.lit("")), "page")), "import-taken")
    keywords = F.when(F.lower("page") != matcher_key(F.col("name")), F.array("page")).otherwise(F.array().cast("array<string>"))
    return free_slugs(named, existing, "base", "page", order).select(order, "name", "page", "slug", keywords.alias("keywords"))
