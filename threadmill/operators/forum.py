"""Forum pages as tables: topic rows of listings, posts of topics, mails about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import desk as D
from ..functions import text as T


def listing_rows(pages: DataFrame, key: str, html: str, host: str = T.FORUM_HOST) -> DataFrame:
    """key, place, url, title, replies, resolved, sticky of each topic of a listing;
    of rows with the same topic the first stays.  A row without a topic link is none."""
    cut = F.split(html, r'(?i)(?=<ul[^>]+id="bbp-topic-[0-9]+")')
    rows = pages.select(key, F.posexplode(cut).alias("place", "row")).where(F.col("row").rlike(r'(?i)\A<ul[^>]+id="bbp-topic-[0-9]+"'))
    link = r'(?is)<a[^>]*href="([^"#]*/support/topic/[^"#]*)"[^>]*>(.*?)</a>'
    replies = F.regexp_extract("row", r'(?is)<li[^>]*class="[^"]*bbp-topic-reply-count[^"]*"[^>]*>(.*?)</li>', 1)
    opening = F.regexp_extract("row", r"(?i)\A<ul[^>]*>", 0)
    out = rows.select(
        key,
        "place",
        T.canonical_topic(F.regexp_extract("row", link, 1), host).alias("url"),
        F.regexp_replace(plain(F.regexp_extract("row", link, 2)), r"(?i)\A\[\s*resolved\s*\]\s*", "").alias("title"),
        T.bound(replies, lambda n: F.regexp_replace(F.when(n.rlike("[<&]"), plain(n)).otherwise(n), "[^0-9]", "").try_cast("int")).alias("replies"),
        D.unnamed_posts_resolved(F.col("row")).alias("resolved"),
        opening.rlike(r'(?i)class="[^"]*(?<![A-Za-z0-9_])sticky(?![A-Za-z0-9_])').alias("sticky"),
    ).where("url is not null")
    first = out.groupBy(key, "url").agg(F.min_by(F.struct("place", "title", "replies", "resolved", "sticky"), "place").alias("r"))
    return first.select(key, "r.place", "url", "r.title", "r.replies", "r.resolved", "r.sticky")


def plain(html: Column) -> Column:
    """A fragment without tags, on one line."""
    return F.trim(F.regexp_replace(T.decode_entities(F.regexp_replace(html, r"<[^>]*>", " ")), r"\s+", " "))


def topic_posts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, place, post, author, role and body of the posts of topic pages.

    A post reaches from its numbered element to the next one; its body is what its
    content element holds, and only white space tells lines apart.  Posts that are
    repeated on a later page of the topic are the first one's.
    """
    cut = F.split(html, r'(?i)(?=<(?:div|li)[^>]+id="post-[0-9]+")')
    posts = pages.select(key, F.posexplode(cut).alias("place", "part")).where(F.col("part").rlike(r'(?i)\A<(?:div|li)[^>]+id="post-[0-9]+"'))
    body = F.regexp_extract("part", r'(?is)<div[^>]+class="[^"]*(?:bbp-topic-content|bbp-reply-content)[^"]*"[^>]*>(.*)', 1)
    links = F.regexp_extract_all("part", F.lit(r'(?is)<a[^>]+href="[^"]*/users/[^"]*"[^>]*>(.*?)</a>'), F.lit(1))
    author = F.get(F.filter(F.transform(links, plain), lambda x: x != ""), F.lit(0))
    role = plain(F.regexp_extract("part", r'(?is)<[^>]+class="[^"]*bbp-author-role[^"]*"[^>]*>(.*?)</', 1))
    out = posts.select(
        key,
        "place",
        F.regexp_extract("part", r'(?i)id="post-([0-9]+)"', 1).cast("long").alias("post"),
        F.coalesce(author, F.lit("anonymous")).alias("author"),
        F.when(role != "", role).alias("role"),
        plain(body).alias("body"),
    )
    first = out.groupBy(key, "post").agg(F.min_by(F.struct("place", "author", "role", "body"), "place").alias("p"))
    return first.select(key, "p.place", "post", "p.author", "p.role", "p.body")


def has_page(html: Column, topic: Column, number: Column) -> Column:
    """Whether a page links to page ``number`` of the very topic, not of another."""
    path = F.regexp_extract(topic, r"\A[a-z]+://[^/]+(/[^?#]*?)/?(?:[?#].*)?\z", 1)
    return (path != "") & F.contains(F.lower(html), F.lower(F.concat(path, F.lit("/page/"), number.cast("string"), F.lit("/"))))


def mail_topic(text: Column, html: Column, host: str = T.FORUM_HOST) -> Column:
    """The first forum topic that a mail links to, in its text before its HTML."""
    link = F.lit(r"""(?i)https?://[^\s"'<>)\]]+""")
    urls = F.concat(F.regexp_extract_all(F.coalesce(text, F.lit("")), link, F.lit(0)), F.regexp_extract_all(F.coalesce(html, F.lit("")), link, F.lit(0)))
    return F.get(F.filter(F.transform(urls, lambda u: T.canonical_topic(u, host)), lambda u: u.isNotNull()), F.lit(0))


def subject_hint(subject: Column) -> Column:
    """What stands in the first brackets of a subject."""
    hint = F.trim(F.regexp_extract(subject, r"\[([^\]]+)\]", 1))
    return F.when(hint != "", hint)


def worth_a_thread(topics: DataFrame, posts: DataFrame, key: str, most: int = 200) -> DataFrame:
    """Topics with two posts or more, at least 80 characters of them, that are not
    sticky and not known to be without a reply; the first ``most`` in their order."""
    sizes = posts.groupBy(key).agg(F.count(F.lit(1)).alias("n_posts"), F.sum(F.length("body")).alias("n_chars"))
    good = topics.where(~F.col("sticky") & (F.col("replies").isNull() | (F.col("replies") > 0))).join(sizes, key)
    return good.where("n_posts >= 2 and n_chars >= 80").orderBy("place", key).limit(most)
