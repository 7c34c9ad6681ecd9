"""Predicates, summaries and state rules of a support desk's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR = "INTERVAL 1 HOUR"
# States and reasons that stored rows have.
OPEN_STATES = ["new", "failed", "drafted"]
CLOSED_STATES = ["dismissed", "reviewed"]
# End of fixed values.


# Filters


def not_older(day: Column, cut: Column) -> Column:
    """Rows from the cut on; undated ones stay (topics)."""
    return day.isNull() | (day >= cut)


def dated_from(day: Column, cut: Column) -> Column:
    """Rows from the cut on; undated ones go (replies)."""
    return F.coalesce(day >= cut, F.lit(False))


def source_gaps(plugins: DataFrame, sources: DataFrame, plugin: str) -> DataFrame:
    """plugin, missing_docs, missing_forum, never_ingested.

    sources: plugin, forum, chunks.  Never ingested means that there are sources and
    none of them has a chunk; a plugin without a source misses both kinds.
    """
    s = sources.groupBy(plugin).agg(F.bool_or("forum").alias("forum"), F.bool_or(~F.col("forum")).alias("docs"), F.max("chunks").alias("chunks"))
    joined = plugins.join(s, plugin, "left")
    missing = lambda c: ~F.coalesce(c, F.lit(False))
    return joined.select(*[plugins[c] for c in plugins.columns], missing(F.col("docs")).alias("missing_docs"), missing(F.col("forum")).alias("missing_forum"), F.coalesce(F.col("chunks") == 0, F.lit(False)).alias("never_ingested"))


def has_draft(drafts: Column) -> Column:
    """Whether a JSON list of drafts has one with text; anything but a list has none."""
    texts = F.from_json(F.when(drafts.rlike(r"\A\s*\["), drafts), "array<struct<text: string>>")
    return F.coalesce(F.exists(texts, lambda d: F.coalesce(d["text"], F.lit("")) != ""), F.lit(False))


def draftless(status: Column, answer: Column, drafts: Column) -> Column:
    return status.isin(OPEN_STATES) & answer.isNull() & ~has_draft(drafts)


def refresh_due(status: Column, waiting: Column, resolved: Column, updated: Column, slug: Column, now: Column) -> Column:
    """Topics that wait, were not looked at within the hour, and are still open."""
    return waiting.isNotNull() & ~resolved & (updated < now - F.expr(HOUR)) & ~status.isin(CLOSED_STATES) & slug.isNotNull()


def verify_due(status: Column, waiting: Column, resolved: Column) -> Column:
    """Of topics that are about to be announced, those that are looked at first."""
    return waiting.isNotNull() & ~resolved & (status != "dismissed")


def refreshed_first(threads: DataFrame, due: Column, key: str, ids: DataFrame | None = None, most: int = 20) -> DataFrame:
    """The topics that wait longest, among those due and, if ids is given, in it."""
    t = threads if ids is None else threads.join(ids.select(key), key, "left_semi")
    return t.where(due).orderBy("waiting_since", key).limit(most)


def work_lists(conversations: DataFrame, chunks: DataFrame, chunkable: DataFrame, key: str) -> DataFrame:
    """key and what a rebuild does with it: rebuild (resolved, no junk), purge_junk
    (junk that has chunks) or purge_stale (has chunks, is not resolved and could
    not be chunked); all else is left out."""
    held = chunks.select(key).distinct().withColumn("_held", F.lit(True))
    fit = chunkable.select(key).distinct().withColumn("_fit", F.lit(True))
    c = conversations.join(held, key, "left").join(fit, key, "left")
    has, resolved = F.col("_held").isNotNull(), F.col("state").eqNullSafe("resolved")
    work = F.when(F.col("junk") & has, "purge_junk").when(~F.col("junk") & resolved, "rebuild").when(~F.col("junk") & has & ~resolved & F.col("_fit").isNull(), "purge_stale")
    return c.select(key, work.alias("work")).where("work is not null")


def found_or_like(docs: DataFrame, ids: DataFrame, key: str, like: Column, columns: Column) -> DataFrame:
    """Rows whose columns match, or that full text found; only if that found nothing
    at all, rows whose text matches as a substring."""
    none = ids.agg((F.count(F.lit(1)) == 0).alias("_none"))
    marked = docs.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left").crossJoin(F.broadcast(none))
    return marked.where(columns | F.col("_hit").isNotNull() | (F.col("_none") & like)).drop("_hit", "_none")


# Lists and lookups


def top_of_each(df: DataFrame, halves: list[Column], order: list[Column], most: int = 50) -> DataFrame:
    """The first rows of each of some disjoint parts, with ``half``: its number."""
    parts = [df.where(p).orderBy(*order).limit(most).withColumn("half", F.lit(i)) for i, p in enumerate(halves)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gathered(parents: DataFrame, children: DataFrame, key: str, order: list[str], columns: list[str], name: str) -> DataFrame:
    """parents with their children as an ordered list (empty if there are none)."""
    lists = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *columns))).alias(name))
    kind = lists.schema[name].dataType.simpleString()
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def hinted(rows: DataFrame, plugins: DataFrame, hint: str, page_slug: str) -> DataFrame:
    """rows with ``plugin``: that of the hint as a name or a slug, in any case, or else
    of the page's slug.  plugins: plugin, name, slug; of equal names the first id."""
    by = lambda c, out: plugins.where(F.col(c).isNotNull()).groupBy(F.lower(c).alias(f"_{out}")).agg(F.min("plugin").alias(out))
    a, b, c = by("name", "by_name"), by("slug", "by_slug"), by("slug", "by_page")
    j = rows.join(a, F.lower(hint) == F.col("_by_name"), "left").join(b, F.lower(hint) == F.col("_by_slug"), "left").join(c, F.lower(page_slug) == F.col("_by_page"), "left")
    return j.select(*[rows[x] for x in rows.columns], F.coalesce(F.least("by_name", "by_slug"), F.col("by_page")).alias("plugin"))


def post_ends(posts: DataFrame, key: str, order: str, customer: Column) -> DataFrame:
    """key, first, last and latest customer post (the last one if no customer wrote)."""
    return posts.groupBy(key).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.coalesce(F.max(F.when(customer, F.col(order))), F.max(order)).alias("latest_customer"))


# Summaries


def knowledge(sources: DataFrame, chunks: Column, cap: int) -> DataFrame:
    """One row: sources, ready and failed ones, pages (0 for none), holders with a
    chunk, and the plugins of sources that reached the cap without failing."""
    failed = F.col("status") == "failed"
    capped = F.when(~failed & (F.col("pages") >= cap), F.struct((-F.col("pages")).alias("p"), "source"))
    return sources.agg(
        F.count(F.lit(1)).alias("n_sources"),
        F.count_if(F.col("status") == "ready").alias("n_ready"),
        F.count_if(failed).alias("n_failed"),
        F.coalesce(F.sum("pages"), F.lit(0)).cast("long").alias("pages"),
        F.count_distinct(F.when(chunks > 0, F.col("plugin"))).alias("holders"),
        F.size(F.collect_list(capped)).cast("long").alias("n_capped"),
    )


def junk_summary(scanned: DataFrame, cleaned: DataFrame, key: str) -> DataFrame:
    """reason (null: all) with scanned, junk and cleaned rows.  cleaned: junk whose
    chunks a scan removed."""
    c = cleaned.select(key).distinct().withColumn("_c", F.lit(1))
    rows = scanned.join(c, key, "left")
    per = [F.count(F.lit(1)).alias("scanned"), F.count_if("junk").alias("junk"), F.count_if(F.col("junk") & F.col("_c").isNotNull()).alias("cleaned")]
    return rows.where("junk").groupBy("reason").agg(*per).unionByName(rows.agg(*per).withColumn("reason", F.lit(None).cast("string")).select("reason", "scanned", "junk", "cleaned"))


def resume_page(runs: DataFrame) -> DataFrame:
    """The furthest page of a run that moved on and was no range run; 1 if none did."""
    moved = (F.col("kind") != "range") & ((F.col("synced") > 0) | (F.col("page_to") > F.col("page_from")))
    return runs.agg(F.greatest(F.coalesce(F.max(F.when(moved, F.col("page_to"))), F.lit(1)), F.lit(1)).alias("page"))


def resume_index(runs: DataFrame, index: str, plugins: DataFrame) -> DataFrame:
    """Where a numbered walk over the plugins goes on: after the last index, within them."""
    last = runs.agg((F.coalesce(F.max(index), F.lit(0)) + 1).alias("next"))
    n = plugins.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))
    return last.crossJoin(F.broadcast(n)).select(F.least("next", "n").alias("index"))


def rebuild_advice(chunks: Column, recorded: Column, current: Column, rules_then: Column, rules_now: Column) -> Column:
    """Why an index should be rebuilt, or null: definitions or rules differ from those
    of the last rebuild, or none was recorded.  Nothing to rebuild, no advice."""
    return F.when(chunks == 0, None).when(recorded.isNull(), "never_recorded").when(recorded != current, "defs_changed").when(rules_then != rules_now, "rules_updated")


def digest_due(rows: Column, last_sent: Column, now: Column, hours: int = 22) -> Column:
    """Whether a digest goes out: there is something, and the last was long enough ago."""
    return (rows > 0) & (last_sent.isNull() | (now - last_sent >= F.expr(f"INTERVAL {hours} HOURS")))


def digest_lines(rows: DataFrame, order: list[Column], line: Column, most: int = 15) -> DataFrame:
    """One row: the first lines in order, and how many more there are (null for none)."""
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    first = rows.select(line.alias("line"), F.struct(*order).alias("o")).orderBy("o").limit(most)
    text = first.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    more = F.when(F.col("n") > most, F.concat(F.lit("+"), F.col("n") - most, F.lit(" more")))
    return text.crossJoin(F.broadcast(total)).select("lines", more.alias("more"))


# State rules


def draft_status(drafts: Column, providers: Column) -> Column:
    """struct(status, answer): the first draft with text makes a thread drafted; none
    of any provider makes it failed; without a provider it stays new."""
    good = F.filter(drafts, lambda d: F.coalesce(d["text"], F.lit("")) != "")
    status = F.when(F.size(good) > 0, "drafted").when(providers > 0, "failed").otherwise("new")
    return F.struct(status.alias("status"), F.get(good, F.lit(0))["text"].alias("answer"))


def waiting_after_draft(waiting: Column, outcome: Column, page: Column, reply: Column, prior: Column, now: Column) -> Column:
    """The waiting clock after a follow-up pass.

    Support spoke last (support_last, gentle_close): the clock starts at the best
    known date, and one that runs is moved where the page disagrees by more than
    an hour.  A draft stops it; a pass that failed or saw no reply leaves it.
    """
    waiting, page = waiting.cast("timestamp"), page.cast("timestamp")
    off = F.abs(F.unix_millis(page) - F.unix_millis(waiting)) > 3_600_000
    start = F.when(waiting.isNull(), F.coalesce(page, reply, prior, now)).when(off, page).otherwise(waiting)
    return F.when(outcome.isin("support_last", "gentle_close"), start).when(outcome.isin("fetch_failed", "no_replies"), waiting)


def followup_outcome(fetched: Column, posts: Column, support_last: Column, promised: Column, gentle: Column, resolved: Column) -> Column:
    """What a follow-up pass does, by what it sees."""
    closes = support_last & ~promised & gentle & ~resolved
    return F.when(~fetched, "fetch_failed").when(posts < 2, "no_replies").when(closes, "gentle_close").when(support_last & ~promised, "support_last").otherwise("draft")


def page_from(kind: Column, pages: Column, keys: Column) -> Column:
    """The first page of a run: 1 for ranges, else that of its first key, or 1."""
    known = F.try_element_at(pages, F.get(keys, F.lit(0)))
    return F.when(kind == "range", F.lit(1)).otherwise(F.coalesce(known, F.lit(1)))


def roster_name(first: Column, last: Column) -> Column:
    name = F.trim(F.concat_ws(" ", F.nullif(F.trim(first), F.lit("")), F.nullif(F.trim(last), F.lit(""))))
    return F.when(name != "", name)


def ingest_done(old: DataFrame, new: DataFrame, failed: DataFrame, key: str, hash_: str, kind: str, forum: bool) -> DataFrame:
    """The pages' state after an ingest: key, hash, kind and chunks (keep, rebuild or none).

    A page of another kind than before is a new one.  Pages whose embedding failed
    (failed: key) are stored without a hash, so that the next ingest takes them up
    again; a page that keeps its hash cannot fail.  Pages that are gone are dropped,
    those of a forum stay as they are.
    """
    a = old.select(key, F.col(hash_).alias("_old"), F.col(kind).alias("_was"))
    b = new.select(key, F.col(hash_).alias("_new"), F.col(kind).alias("_is"), F.lit(True).alias("_in"))
    f = failed.select(key).distinct().withColumn("_failed", F.lit(True))
    same = F.coalesce((F.col("_old") == F.col("_new")) & (F.col("_was") == F.col("_is")), F.lit(False))
    gone = F.col("_in").isNull()
    hash_now = F.when(gone, F.col("_old")).when(~same & F.col("_failed").isNotNull(), None).otherwise(F.col("_new"))
    work = F.when(gone | same, "keep").when(F.col("_failed").isNotNull(), "none").otherwise("rebuild")
    out = a.join(b, key, "full").join(f, key, "left").where(~gone | F.lit(forum))
    return out.select(key, hash_now.alias(hash_), F.when(gone, F.col("_was")).otherwise(F.col("_is")).alias(kind), work.alias("chunks"))


def ingest_plan(old: DataFrame, new: DataFrame, key: str, hash_: str, forum: bool) -> DataFrame:
    """key and plan: keep (same hash), rechunk (another one, or none stored), add or
    drop; pages of a forum are never dropped."""
    a = old.select(key, F.col(hash_).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(key, F.col(hash_).alias("_new"), F.lit(True).alias("_in_new"))
    plan = F.when(F.col("_in_old").isNull(), "add").when(F.col("_in_new").isNull(), "keep" if forum else "drop").when(F.col("_old") == F.col("_new"), "keep").otherwise("rechunk")
    return a.join(b, key, "full").select(key, plan.alias("plan"))


def adopted(rows: DataFrame, brands: DataFrame, site: str, brand: str) -> DataFrame:
    """Rows without a brand take that of their site, if there is one."""
    b = brands.select(F.col(site), F.col(brand).alias("_b"))
    return rows.join(b, site, "left").withColumn(brand, F.coalesce(brand, "_b")).drop("_b")


def archive_starts(brands: DataFrame, rows: DataFrame, brand: str, day: str) -> DataFrame:
    """The first month index of every brand that is not known yet; null for an empty
    one, and no row at all if no brand has a month."""
    month = F.year(day) * 12 + F.month(day) - 1
    first = rows.where(F.col(day).isNotNull()).groupBy(brand).agg(F.min(month).alias("first_month"))
    found = brands.select(brand).join(first, brand, "left")
    some = first.join(brands.select(brand), brand, "left_semi").agg((F.count(F.lit(1)) > 0).alias("_some"))
    return found.crossJoin(F.broadcast(some)).where("_some").drop("_some")
