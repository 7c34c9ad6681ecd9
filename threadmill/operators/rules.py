"""Rules that keep sources, targets and topics right: what a feed knows better than a
page, forums stored as pages, slugs that changed, where to look for a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.desk import escaped
from ..functions.text import FORUM_HOST, source_type, truncated

# What is announced, and how long its parts may be.
TITLE_CHARS, EXCERPT_CHARS, DRAFT_CHARS = 200, 300, 1500
NO_FOLLOWUP = "_A follow-up draft couldn't be generated yet — open /suggestions and hit Regenerate._"
NO_DRAFT = "_A draft reply couldn't be generated yet — open /suggestions to draft one manually._"

#: What a page gives as the author when it names none.
NAMELESS = "anonymous"
#: Pages and products of an author that are read.
AUTHOR_PAGES, AUTHOR_PRODUCTS = 3, 300


def forum_of(slug: Column, host: str = FORUM_HOST) -> Column:
    """The address of a product's forum."""
    return F.concat(F.lit(f"https://{host}/support/plugin/"), slug, F.lit("/"))


def canonical_forum(url: Column, host: str = FORUM_HOST) -> Column:
    """https, no www, no query or fragment, a slash at the end; other hosts keep their scheme."""
    bare = F.regexp_replace(url, r"[?#].*\z", "")
    ours = F.regexp_replace(bare, rf"(?i)\Ahttps?://(?:www\.)?((?:[a-z0-9-]+\.)*{host.replace('.', '[.]')})(?=[:/]|\z)", "https://$1")
    return F.when(ours.endswith("/"), ours).otherwise(F.concat(ours, F.lit("/")))


def feed_over_page(page: Column, feed: Column) -> Column:
    """struct(title, author, published, activity) of a thread just made from a page and
    its feed item.

    page: title, author, published, last_post and activity; feed: title, author and
    published.  A page without a title takes the feed's; a nameless author likewise.
    The feed's date is exact and wins; it is the last activity too if the page does
    not date its last post.
    """
    has = lambda c: c.isNotNull() & (c != "")
    title = F.when(~F.coalesce(has(page["title"]), F.lit(False)) & has(feed["title"]), feed["title"]).otherwise(page["title"])
    author = F.when((page["author"] == NAMELESS) & has(feed["author"]), feed["author"]).otherwise(page["author"])
    activity = F.when(feed["published"].isNotNull() & page["last_post"].isNull(), feed["published"]).otherwise(page["activity"])
    return F.struct(title.alias("title"), author.alias("author"), F.coalesce(feed["published"], page["published"]).alias("published"), activity.alias("activity"))


def healed(sources: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources with forums called forums, and pages without those of sources that were
    something else until now.  sources: source, url and type; pages: source and more."""
    forum = (source_type(F.col("url")) == "forum") & (F.col("type") != "forum")
    marked = sources.withColumn("flipped", F.coalesce(forum, F.lit(False)))
    kept = pages.join(marked.where("flipped").select("source"), "source", "left_anti")
    return marked.withColumn("type", F.when(F.col("flipped"), "forum").otherwise(F.col("type"))).drop("flipped"), kept


def sources_to_add(wanted: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """Which of the wanted sources (order, plugin, url, type) are made, in this order.

    A forum's address makes a source a forum, whatever it was called, and is written
    in one way.  A plugin has one forum source: another is not made if it has one, by
    type or by address, or if an earlier wanted one made it; other types always are.
    existing: plugin, url and type.
    """
    forum = F.coalesce(source_type(F.col("url")) == "forum", F.lit(False)) | (F.col("type") == "forum")
    rows = wanted.withColumn("type", F.when(forum, "forum").otherwise(F.col("type")))
    rows = rows.withColumn("url", F.when(F.col("type") == "forum", canonical_forum(F.col("url"))).otherwise(F.col("url")))
    forums = rows.where("type = 'forum'")
    has = existing.where("type = 'forum'").select("plugin").distinct()
    same = existing.select("plugin", "url").distinct()
    forums = forums.join(has, "plugin", "left_anti").join(same, ["plugin", "url"], "left_anti")
    # One whose address a plain source made before it has is there already.
    plain = rows.where("type <> 'forum'").groupBy("plugin", "url").agg(F.min(order).alias("since"))
    forums = forums.join(plain, ["plugin", "url"], "left").where(F.col("since").isNull() | (F.col("since") > F.col(order))).drop("since")
    first = F.row_number().over(Window.partitionBy("plugin").orderBy(order))
    forums = forums.withColumn("n", first).where("n = 1").drop("n")
    return forums.select(rows.columns).unionByName(rows.where("type <> 'forum'"))


def repointed(plugins: DataFrame, sources: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, pages) after plugins got their slugs (null: untouched).

    A plugin without a forum source gets an idle one; one that points at another forum
    is pointed at the new one, idle, with counters and dates reset and without its
    pages.  plugins: plugin and slug; sources: source, plugin, url, type, status,
    pages, chunks, crawled and error; of several forum sources the first counts.
    """
    set_ = plugins.where("slug is not null and slug <> ''").select("plugin", forum_of(F.col("slug")).alias("forum"))
    at = sources.join(set_, "plugin", "left")
    found = at.withColumn("is_it", F.coalesce((F.col("type") == "forum") | (F.col("url") == F.col("forum")), F.lit(False)) & F.col("forum").isNotNull())
    first = found.where("is_it").groupBy("plugin").agg(F.min("source").alias("chosen"))
    found = found.join(first, "plugin", "left")
    move = (F.col("source") == F.col("chosen")) & (F.col("url") != F.col("forum"))
    found = found.withColumn("move", F.coalesce(move, F.lit(False)))
    reset = {"url": F.col("forum"), "type": F.lit("forum"), "status": F.lit("idle"), "pages": F.lit(0), "chunks": F.lit(0), "crawled": F.lit(None), "error": F.lit(None)}
    kind = {f.name: f.dataType for f in sources.schema}
    after = found.select(*[F.when(F.col("move"), reset[c].cast(kind[c])).otherwise(F.col(c)).alias(c) if c in reset else F.col(c) for c in sources.columns])
    new = set_.join(first, "plugin", "left_anti")
    made = {**reset, "plugin": F.col("plugin"), "source": F.lit(None)}
    after = after.unionByName(new.select(*[made[c].cast(kind[c]).alias(c) for c in sources.columns]))
    return after, pages.join(found.where("move").select("source"), "source", "left_anti")


def sync_targets(brands: DataFrame, default: str | None) -> DataFrame:
    """brand, site, name and place of what is synced: the brands in the order they were
    made; without any the default site alone; without that either, nothing.
    brands: brand, site, name and created."""
    placed = brands.select("brand", "site", "name", F.row_number().over(Window.orderBy("created", "brand")).alias("place"))
    kind = brands.schema["brand"].dataType.simpleString()
    none = brands.agg((F.count(F.lit(1)) == 0).alias("none")).where(F.col("none") & F.lit(default is not None))
    return placed.unionByName(none.select(F.lit(None).cast(kind).alias("brand"), F.lit(default).alias("site"), F.lit("default").alias("name"), F.lit(1).alias("place")))


def found_at(probes: DataFrame) -> DataFrame:
    """session, site and outcome of looking for each session: at its known brand first,
    then at the others in order.

    probes: session, known (the session's brand, or null) and answers, an array of
    structs of brand, site, place and status (what the site answers).  Sites that do
    not have it (404) are passed over, any other error ends the search: ``found``,
    ``error`` or ``missing`` (site null).  A session's probes may be several rows; the
    first answer of each is found where the row is, so one travels.
    """

    def known_first(a: Column) -> Column:
        other = ~F.coalesce(a["brand"] == F.col("known"), F.lit(False))
        return F.struct(F.struct(other.alias("other"), a["place"].alias("place")).alias("o"), a["site"].alias("site"), a["status"].alias("status"))

    first = F.array_min(F.transform(F.filter("answers", lambda a: a["status"] != 404), known_first))
    answers = probes.select("session", first.alias("a")).groupBy("session").agg(F.min("a").alias("a"))
    outcome = F.when(F.col("a").isNull(), "missing").when(F.col("a.status") == 200, "found").otherwise("error")
    return answers.select("session", F.when(outcome == "found", F.col("a.site")).alias("site"), outcome.alias("outcome"))


def author_products(listed: DataFrame) -> DataFrame:
    """author, slug, name and place of the products that authors' pages list.

    listed: author, page, pages (how many the page says there are; null: none more),
    pos, slug and name.  Pages are read while there are more, AUTHOR_PAGES at most;
    a slug counts once, trimmed, a blank one not at all; a product without a name
    has its slug's; AUTHOR_PRODUCTS at most.
    """
    by = Window.partitionBy("author")
    ahead = listed.groupBy("author", "page").agg(F.max(F.coalesce("pages", F.lit(0))).alias("said"))
    # A page is read if every page before it says that it is there.
    least = F.min(F.when(F.col("said") > 0, F.col("said")).otherwise(F.col("page"))).over(by.orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    there = F.row_number().over(by.orderBy("page")) == F.col("page")
    ahead = ahead.withColumn("read", there & F.coalesce(least >= F.col("page"), F.lit(True)) & (F.col("page") <= AUTHOR_PAGES)).where("read").select("author", "page")
    rows = listed.join(ahead, ["author", "page"]).withColumn("slug", F.trim("slug")).where("slug <> ''")
    first = rows.groupBy("author", "slug").agg(F.min(F.struct("page", "pos", "name")).alias("f"))
    placed = first.withColumn("place", F.row_number().over(by.orderBy("f.page", "f.pos")))
    name = F.coalesce(F.nullif(F.col("f.name"), F.lit("")), F.col("slug"))
    return placed.where(F.col("place") <= AUTHOR_PRODUCTS).select("author", "slug", name.alias("name"), "place")


def topic_payload(kind: Column, product: Column, title: Column, url: Column, author: Column, excerpt: Column, draft: Column, review: str) -> Column:
    """struct(text, blocks): what is announced of a new topic or of a reply to one (kind
    ``new_reply``), escaped and cut.

    Author and excerpt describe a topic's first post, so they are left out for a
    reply; without a draft a note says so.
    """
    reply = F.coalesce(kind == "new_reply", F.lit(False))
    cut = lambda c, n: truncated(escaped(F.coalesce(c, F.lit(""))), n)
    says = lambda c, other: F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(other)
    head = F.concat(F.when(reply, ":speech_balloon: *New customer reply — ").otherwise(":speech_balloon: *New wp.org topic — "), escaped(product), F.lit("*\n<"), url, F.lit("|"), cut(title, TITLE_CHARS), F.lit(">"))
    who = F.concat(F.lit("Author: "), says(escaped(author), F.lit("unknown")))
    what = F.concat(F.lit("> "), says(cut(excerpt, EXCERPT_CHARS), F.lit("(no excerpt)")))
    label = F.when(reply, "*Suggested follow-up:*").otherwise("*Draft:*")
    text = F.concat(label, F.lit("\n```"), cut(draft, DRAFT_CHARS), F.lit("```"))
    none = F.when(reply, NO_FOLLOWUP).otherwise(NO_DRAFT)
    body = F.when(F.coalesce(draft, F.lit("")) != "", text).otherwise(none)
    blocks = F.when(reply, F.array(head, body, F.lit(review))).otherwise(F.array(head, who, what, body, F.lit(review)))
    plain = F.concat(F.when(reply, "New customer reply for ").otherwise("New wp.org topic for "), product, F.lit(": "), title)
    return F.struct(plain.alias("text"), blocks.alias("blocks"))
