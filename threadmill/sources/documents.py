"""Readers of raw payloads that arrive as text: feeds, sitemaps, mails and chat records."""

from __future__ import annotations

from email import message_from_string, policy

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_topic, decode_entities

CONVERSATION = """session_id string, website_id string, state string, created_at bigint, updated_at bigint,
active struct<now: boolean, last: bigint>, last_message string, assigned struct<user_id: string>,
meta struct<nickname: string, email: string, phone: string, ip: string, segments: array<string>,
device: struct<geolocation: struct<country: string, city: string>, locales: array<string>>>"""


def epoch_ms(ms: Column) -> Column:
    """A moment from milliseconds; nothing for 0, negatives and null."""
    return F.when(ms > 0, F.timestamp_millis(ms))


def parse_conversations(raw: DataFrame, json: str) -> DataFrame:
    """Chat records from JSON, permissively; the raw text stays beside the columns."""
    p = raw.withColumn("_p", F.from_json(json, CONVERSATION))
    tags = F.filter(F.coalesce("_p.meta.segments", F.array().cast("array<string>")), lambda t: t.isNotNull())
    return p.select(
        F.col("_p.session_id").alias("session_id"),
        F.col("_p.state").alias("state"),
        epoch_ms(F.col("_p.created_at")).alias("created_at"),
        epoch_ms(F.col("_p.updated_at")).alias("updated_at"),
        F.coalesce(epoch_ms(F.col("_p.active.last")), epoch_ms(F.col("_p.updated_at"))).alias("last_message_at"),
        F.col("_p.last_message").alias("preview"),
        F.col("_p.meta.email").alias("email"),
        tags.alias("tags"),
        F.lower(F.substring(F.get("_p.meta.device.locales", F.lit(0)), 1, 2)).alias("language"),
        F.col(json).alias("raw"),
    )


def message_key(fingerprint: Column, at: Column, kind: Column, sender: Column, content: Column) -> Column:
    """The fingerprint, or a key generated from what the message says."""
    digest = F.substring(F.sha2(F.to_json(F.array(at.cast("string"), kind, sender, content)), 256), 1, 16)
    return F.coalesce(fingerprint.cast("string"), F.concat(F.lit("gen-"), at.cast("string"), F.lit("-"), digest))


def sitemap_urls(xml: Column) -> Column:
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), decode_entities)


def site_pages(maps: DataFrame, roots: DataFrame, url: str = "url", xml: str = "xml", most: int = 300, children: int = 10) -> DataFrame:
    """root, place (1, 2, ...) and page of every root map: the first ``most`` locations.

    A map that names only maps (``sitemap*.xml``) is an index: its first ``children``
    maps are read in its place, one level deep.  Maps that are not there give nothing;
    of maps with one url the smallest text counts.
    """
    one = maps.groupBy(F.col(url).alias("map")).agg(F.min(xml).alias("xml"))
    locs = one.select("map", F.posexplode(sitemap_urls(F.col("xml"))).alias("i", "page"))
    first = locs.join(roots.select(F.col(url).alias("map")).distinct(), "map", "left_semi")
    is_map = F.col("page").rlike(r"(?i)sitemap[^/]*\.xml")
    kinds = first.groupBy("map").agg(F.bool_and(is_map).alias("index"))
    first = first.join(kinds, "map").select(F.col("map").alias("root"), "index", "i", "page")
    flat = first.where("not index").select("root", F.lit(0).alias("child"), "i", "page")
    inner = first.where(F.col("index") & (F.col("i") < children)).select("root", F.col("i").alias("child"), F.col("page").alias("map"))
    pages = flat.unionByName(inner.join(locs, "map").select("root", "child", "i", "page"))
    place = F.row_number().over(Window.partitionBy("root").orderBy("child", "i"))
    return pages.select("root", place.alias("place"), "page").where(F.col("place") <= most)


def excerpt(html: Column, most: int = 4000) -> Column:
    """The first characters of a feed's description as lines; blank ones part paragraphs."""
    text = F.regexp_replace(html, r"<!\[CDATA\[|\]\]>", "")
    text = F.regexp_replace(text, r"(?i)</(?:p|div|li|br)>", "\n")
    text = decode_entities(F.regexp_replace(text, r"<[^>]+>", " "))
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    text = F.regexp_replace(F.array_join(lines, "\n"), r"\n{2,}", "\n\n")
    return F.substring(F.regexp_replace(text, r"\A\s+|\s+\z", ""), 1, most)


def feed_items(feeds: DataFrame, xml: str, host: str) -> DataFrame:
    """Items of RSS feeds: position, title, link, guid, author, published, topic, is_reply,
    excerpt (of topics; of the content or else the description).

    An item is a reply if its link or guid points to a post of a topic.  Of replies
    with the same guid, and of topics with the same guid up to a #, the first stays.
    Times that cannot be read are null.
    """

    def tag(name: str) -> Column:
        inner = F.regexp_extract("item", rf"(?is)<{name}[^>]*>(.*?)</{name}>", 1)
        plain = F.trim(decode_entities(F.regexp_replace(F.regexp_replace(inner, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), r"<[^>]+>", " ")))
        return F.when(plain != "", plain)

    def raw(name: str) -> Column:
        whole = F.regexp_extract("item", rf"(?is)<{name}[^>]*>.*?</{name}>", 0)
        return F.when(whole != "", F.regexp_extract(whole, rf"(?is)\A<{name}[^>]*>(.*)</{name}>\z", 1))

    items = feeds.select(F.posexplode(F.regexp_extract_all(xml, F.lit(r"(?is)<item[\s>].*?</item>"), F.lit(0))).alias("pos", "item"))
    link = tag("link")
    guid = F.coalesce(tag("guid"), link)
    date = F.regexp_replace(tag("pubDate"), r"\A\s*[A-Za-z]+,\s*", "")
    out = items.select(
        "pos",
        tag("title").alias("title"),
        link.alias("link"),
        guid.alias("guid"),
        tag("dc:creator").alias("author"),
        F.expr("1").alias("_"),
        F.try_to_timestamp(date, F.lit("d MMM yyyy HH:mm:ss Z")).alias("published"),
        canonical_topic(link, host).alias("topic"),
        (F.coalesce(link, F.lit("")).rlike(r"#post-[0-9]+") | F.coalesce(guid, F.lit("")).rlike(r"#post-[0-9]+")).alias("is_reply"),
        F.coalesce(raw("content:encoded"), raw("description"), F.lit("")).alias("body"),
    ).drop("_")
    out = out.withColumn("excerpt", F.when(~F.col("is_reply"), excerpt(F.col("body")))).drop("body")
    own = F.when(F.col("is_reply"), F.col("guid")).otherwise(F.substring_index("guid", "#", 1))
    from ..operators.relational import first_per_key

    out = out.where("link is not null and (is_reply or title is not null)").withColumn("own", own)
    return first_per_key(out, ["is_reply", "own"], "pos").drop("own")


def mail_body(raw: Column) -> Column:
    """The text of a mail: its text and HTML leaves, decoded, in order."""

    def run(s: pd.Series) -> pd.Series:
        def one(text: str) -> str:
            message = message_from_string(text, policy=policy.default)
            leaves = [p for p in message.walk() if p.get_content_type() in ("text/plain", "text/html")]
            return "\n".join(str(p.get_content()).strip("\n") for p in leaves)

        return s.map(one, na_action="ignore")

    return F.pandas_udf(run, "string")(raw)
