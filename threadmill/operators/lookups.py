"""Finding the stored thread of a topic whatever the spelling of its address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import FORUM_HOST, topic_slug


def topic_threads(refs: DataFrame, threads: DataFrame, ref: str, thread: str, host: str = FORUM_HOST) -> DataFrame:
    """ref and thread of every match.

    refs: ref, canonical and raws (other spellings in hand); threads: thread, guid and
    url.  They match if guid or url is the canonical address or one of the spellings, or
    holds the topic's path, bounded by a slash or the end, so that one slug never
    meets another that it begins.

    Any of these conditions would make the join a comparison of all with all.  So each
    side is expanded to keys that any of them implies, whole addresses and slugs from
    anywhere in the path, which are joined by equality; pairs found twice count once.
    """
    slug = topic_slug(F.col("canonical"), host)
    whole = lambda c: F.struct(F.lit("address").alias("kind"), c.alias("value"))
    part = lambda c: F.struct(F.lit("slug").alias("kind"), c.alias("value"))
    raws = F.coalesce("raws", F.array().cast("array<string>"))
    asked = F.concat(F.array(whole(F.col("canonical")), part(slug)), F.transform(F.filter(raws, lambda r: r != ""), whole))
    left = refs.select(F.col(ref).alias("ref"), F.inline(F.array_distinct(asked)))
    # The slash behind a slug is looked at, not taken, so that it can begin the next path.
    slugs = lambda c: F.coalesce(F.regexp_extract_all(c, F.lit(r"/support/topic/([^/]+)(?=/|\z)"), F.lit(1)), F.array().cast("array<string>"))
    kept = F.concat(F.array(whole(F.col("guid")), whole(F.col("url"))), F.transform(F.concat(slugs(F.col("guid")), slugs(F.col("url"))), part))
    right = threads.select(F.col(thread).alias("thread"), F.inline(F.array_distinct(kept)))
    pairs = left.where("value is not null").join(right.where("value is not null"), ["kind", "value"])
    return pairs.select(F.col("ref").alias(ref), F.col("thread").alias(thread)).distinct()
