"""Registered queries of walks, source rules and announcements, with their SQL.

Events stand in for listed conversations and users for their brands, orders for threads
and sources, customers for plugins, parts for what authors list.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import query, read
from .functions.text import FORUM_HOST
from .operators import embedding as B
from .operators import rules as U
from .operators import walk as W
from .streaming import mergelog as G
from .tables import scratch

# Walks

_LISTED = """listed AS (SELECT user_id % 40 AS brand, event_id, CASE WHEN event_id % 29 <> 0 THEN event_id END AS session, CASE WHEN event_id % 31 <> 0 THEN ts - INTERVAL (event_id % 3) DAY END AS updated_at,
  ((row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts DESC, event_id) - 1) // 20 + 1 + CASE WHEN user_id % 40 = 7 AND ts < TIMESTAMP '2024-01-20' THEN 1 ELSE 0 END)::BIGINT AS page FROM events),
starts AS (SELECT brand, CASE WHEN brand % 10 = 0 THEN 3 WHEN brand % 5 = 0 THEN NULL WHEN brand % 4 = 1 THEN 2 ELSE 1 END AS start FROM range(40) t(brand)),
pages AS (SELECT brand, page, count(session) FILTER (updated_at IS NULL OR updated_at >= TIMESTAMP '2024-01-15') AS taken, count(*) FILTER (updated_at >= TIMESTAMP '2024-01-05') AS inside FROM listed GROUP BY ALL)"""
_WALK = """walked(brand, page, taken, total) AS (SELECT brand, page, taken, taken FROM pages JOIN starts USING (brand) WHERE page = start AND inside > 0
  UNION ALL SELECT p.brand, p.page, p.taken, w.total + p.taken FROM walked w JOIN pages p ON p.brand = w.brand AND p.page = w.page + 1 WHERE w.taken > 0 AND p.inside > 0)"""


def _walk(spark, d):
    e = read(spark, d, "events")
    brand, key = F.col("user_id") % 40, F.col("event_id")
    n = F.row_number().over(Window.partitionBy(brand).orderBy(F.desc("ts"), "event_id")) - 1
    hole = F.when((brand == 7) & (F.col("ts") < F.expr("TIMESTAMP '2024-01-20 00:00:00'")), 1).otherwise(0)
    page = (F.floor(n / 20) + 1 + hole).cast("long")
    updated = F.when(key % 31 != 0, F.col("ts") - F.expr("make_dt_interval(cast(event_id % 3 as int))"))
    rows = e.select(brand.alias("brand"), "event_id", F.when(key % 29 != 0, key).alias("session"), updated.alias("updated_at"), page.alias("page"))
    brands = spark.range(40).withColumnRenamed("id", "brand")
    b = F.col("brand")
    resume = brands.where((b % 5 == 0) | (b % 4 == 1)).select(b, F.when(b % 5 != 0, 2).alias("page"))
    override = brands.where(b % 10 == 0).select(b, F.lit(3).alias("page"))
    fresh = F.col("updated_at").isNull() | (F.col("updated_at") >= F.expr("TIMESTAMP '2024-01-15 00:00:00'"))
    return W.walk(rows, W.first_pages(brands, resume, override), fresh, F.col("updated_at") >= F.expr("TIMESTAMP '2024-01-05 00:00:00'"))


@query(f"WITH RECURSIVE {_LISTED}, {_WALK} SELECT brand, page, event_id FROM listed JOIN walked USING (brand, page) WHERE session IS NOT NULL AND (updated_at IS NULL OR updated_at >= TIMESTAMP '2024-01-15')")
def walk_synced(spark, d):
    """What an incremental walk takes: brands go on where they were, those at their end are skipped."""
    return _walk(spark, d)[0].select("brand", "page", "event_id")


@query(f"""WITH RECURSIVE {_LISTED}, {_WALK} SELECT w.brand, w.page, w.taken, w.total::BIGINT AS total, CASE WHEN w.taken = 0 THEN 'stale' WHEN p.page IS NULL THEN 'end' WHEN p.inside = 0 THEN 'range' END AS last
FROM walked w LEFT JOIN pages p ON p.brand = w.brand AND p.page = w.page + 1""")
def walk_progress(spark, d):
    return _walk(spark, d)[1]


# Sources and targets

_FORUM = f"https://{FORUM_HOST}/support/plugin/"
_TYPED = f"""typed AS (SELECT o_orderkey AS source, o_custkey AS plugin, CASE o_orderkey % 4 WHEN 0 THEN '{_FORUM}p' || o_custkey || '/' WHEN 1 THEN 'http://www.{FORUM_HOST}/support/plugin/p' || o_custkey WHEN 2 THEN 'https://docs.example/' || o_orderkey ELSE '{_FORUM}p' || o_custkey || '?view=all' END AS url,
  CASE WHEN o_orderkey % 3 = 0 THEN 'forum' WHEN o_orderkey % 3 = 1 THEN 'url' ELSE 'sitemap' END AS type FROM orders)"""


def typed(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    url = F.when(k % 4 == 0, F.concat(F.lit(_FORUM + "p"), c, F.lit("/"))).when(k % 4 == 1, F.concat(F.lit(f"http://www.{FORUM_HOST}/support/plugin/p"), c)).when(k % 4 == 2, F.concat(F.lit("https://docs.example/"), k)).otherwise(F.concat(F.lit(_FORUM + "p"), c, F.lit("?view=all")))
    kind = F.when(k % 3 == 0, "forum").when(k % 3 == 1, "url").otherwise("sitemap")
    return read(spark, d, "orders").select(k.alias("source"), F.col("o_custkey").alias("plugin"), url.alias("url"), kind.alias("type"))


@query(f"""WITH {_TYPED}, m AS (SELECT source, source % 4 <> 2 AS forum, type FROM typed)
SELECT source, CASE WHEN forum THEN 'forum' ELSE type END AS type, (SELECT count(*) FROM lineitem WHERE l_orderkey = source AND NOT (forum AND type <> 'forum')) AS n_pages FROM m""")
def forums_healed(spark, d):
    """Sources after forums are called so; those that were not before have lost their pages."""
    pages = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), "l_linenumber")
    sources, kept = U.healed(typed(spark, d), pages)
    n = kept.groupBy("source").agg(F.count(F.lit(1)).alias("n_pages"))
    return sources.join(n, "source", "left").select("source", "type", F.coalesce("n_pages", F.lit(0)).alias("n_pages"))


@query(f"""WITH {_TYPED}, w AS (SELECT source, plugin, CASE WHEN source % 4 <> 2 OR type = 'forum' THEN 'forum' ELSE type END AS type,
  CASE WHEN source % 4 <> 2 THEN '{_FORUM}p' || plugin || '/' WHEN type = 'forum' THEN url || '/' ELSE url END AS url FROM typed WHERE source % 10 <> 0),
e AS (SELECT source, plugin, url, CASE WHEN source % 20 = 0 THEN 'url' ELSE type END AS type FROM typed WHERE source % 10 = 0),
n AS (SELECT * FROM w WHERE type = 'forum' AND NOT EXISTS (SELECT 1 FROM e WHERE e.plugin = w.plugin AND (e.type = 'forum' OR e.url = w.url)))
SELECT source, plugin, url, type FROM w WHERE type <> 'forum' UNION ALL SELECT source, plugin, url, type FROM n WHERE NOT EXISTS (SELECT 1 FROM n o WHERE o.plugin = n.plugin AND o.source < n.source)""")
def forum_sources_added(spark, d):
    """Sources to make, one forum at most for each plugin."""
    rows, k = typed(spark, d), F.col("source")
    existing = rows.where(k % 10 == 0).withColumn("type", F.when(k % 20 == 0, "url").otherwise(F.col("type")))
    return U.sources_to_add(rows.where(k % 10 != 0), existing, "source").select("source", "plugin", "url", "type")


@query(f"""WITH {_TYPED}, s AS (SELECT source, plugin, url, type, 'ready' AS status, source % 9 AS pages FROM typed WHERE source % 2 = 0),
p AS (SELECT c_custkey AS plugin, '{_FORUM}' || CASE WHEN c_custkey % 3 = 1 THEN 'p' ELSE 'new' END || c_custkey || '/' AS forum FROM customer WHERE c_custkey % 3 <> 0),
f AS (SELECT plugin, min(source) AS chosen FROM s JOIN p USING (plugin) WHERE type = 'forum' OR url = forum GROUP BY plugin)
SELECT source, plugin, CASE WHEN move THEN forum ELSE url END AS url, CASE WHEN move THEN 'forum' ELSE type END AS type, CASE WHEN move THEN 'idle' ELSE status END AS status, (CASE WHEN move THEN 0 ELSE pages END)::BIGINT AS pages,
  (CASE WHEN move THEN 0 ELSE (SELECT count(*) FROM lineitem WHERE l_orderkey = source) END)::BIGINT AS n_pages
FROM (SELECT s.*, forum, coalesce(source = chosen AND url <> forum, false) AS move FROM s LEFT JOIN p USING (plugin) LEFT JOIN f USING (plugin))
UNION ALL SELECT NULL, plugin, forum, 'forum', 'idle', 0, 0 FROM p WHERE plugin NOT IN (SELECT plugin FROM f)""")
def forums_repointed(spark, d):
    """Sources and how many pages they have after two thirds of the plugins got a slug."""
    sources = typed(spark, d).where("source % 2 = 0").select("*", F.lit("ready").alias("status"), (F.col("source") % 9).alias("pages"), (F.col("source") % 5).alias("chunks"), F.lit(None).cast("timestamp").alias("crawled"), F.lit("x").alias("error"))
    c = F.col("c_custkey")
    slug = F.when(c % 3 == 1, F.concat(F.lit("p"), c)).when(c % 3 == 2, F.concat(F.lit("new"), c))
    pages = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), "l_linenumber")
    after, kept = U.repointed(read(spark, d, "customer").select(c.alias("plugin"), slug.alias("slug")), sources, pages)
    n = kept.groupBy("source").agg(F.count(F.lit(1)).alias("n_pages"))
    return after.join(n, "source", "left").select("source", "plugin", "url", "type", "status", F.col("pages").cast("long").alias("pages"), F.coalesce("n_pages", F.lit(0)).alias("n_pages"))


@query("SELECT s_suppkey AS brand, s_name AS name, row_number() OVER (ORDER BY s_acctbal, s_suppkey)::INT AS place FROM supplier")
def targets_in_order(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("brand"), F.concat(F.lit("site-"), "s_suppkey").alias("site"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("created"))
    return U.sync_targets(s, "default-site").select("brand", "name", "place")


@query("""WITH a AS (SELECT o_orderkey AS session, n_nationkey AS brand, n_name AS site, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey % 25 END AS known, CASE WHEN (o_orderkey * 7 + n_nationkey * 11) % 37 = 0 THEN 200 WHEN (o_orderkey + n_nationkey) % 61 = 0 THEN 500 ELSE 404 END AS status FROM orders, nation),
o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY coalesce(brand = known, false) DESC, brand) AS n FROM a WHERE status <> 404)
SELECT s.session, CASE WHEN status = 200 THEN site END AS site, CASE WHEN status IS NULL THEN 'missing' WHEN status = 200 THEN 'found' ELSE 'error' END AS outcome FROM (SELECT DISTINCT session FROM a) s LEFT JOIN o ON o.session = s.session AND n = 1""")
def resync_found(spark, d):
    """Where each session is found again, by what the sites answer."""
    k = F.col("o_orderkey")
    sites = read(spark, d, "nation").agg(F.collect_list(F.struct(F.col("n_nationkey").alias("brand"), F.col("n_name").alias("site"))).alias("sites")).where(F.size("sites") > 0)

    def answer(s):
        b = s["brand"]
        status = F.when((k * 7 + b * 11) % 37 == 0, 200).when((k + b) % 61 == 0, 500).otherwise(404)
        return F.struct(b.alias("brand"), s["site"].alias("site"), b.alias("place"), status.alias("status"))

    known = F.when(k % 4 != 0, F.col("o_custkey") % 25)
    probes = read(spark, d, "orders").crossJoin(F.broadcast(sites)).select(k.alias("session"), known.alias("known"), F.transform("sites", answer).alias("answers"))
    return U.found_at(probes)


@query("""WITH l AS (SELECT p_partkey % 30 AS author, (p_partkey // 30) // 12 + 1 AS page, p_partkey AS pos, CASE p_partkey % 30 % 4 WHEN 0 THEN NULL WHEN 1 THEN 2 ELSE 9 END AS pages, CASE WHEN p_partkey % 17 = 0 THEN '  ' ELSE ' ' || p_name || '-' || (p_partkey % 7) END AS slug, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END AS name FROM part),
r AS (SELECT author, trim(slug) AS slug, CASE WHEN name = '' THEN trim(slug) ELSE name END AS name, page, pos FROM l WHERE trim(slug) <> '' AND page <= CASE p_pages WHEN 0 THEN 1 ELSE least(3, p_pages) END),
f AS (SELECT *, row_number() OVER (PARTITION BY author, slug ORDER BY page, pos) AS n FROM r)
SELECT author, slug, name, (row_number() OVER (PARTITION BY author ORDER BY page, pos))::INT AS place FROM f WHERE n = 1""".replace("p_pages", "coalesce(pages, 0)"))
def authors_products(spark, d):
    k = F.col("p_partkey")
    a = k % 30
    pages = F.when(a % 4 == 1, 2).when(a % 4 != 0, 9)
    slug = F.when(k % 17 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit("-"), k % 7))
    listed = read(spark, d, "part").select(a.alias("author"), (F.floor(F.floor(k / 30) / 12) + 1).alias("page"), k.alias("pos"), pages.alias("pages"), slug.alias("slug"), F.when(k % 5 == 0, "").otherwise(F.col("p_type")).alias("name"))
    return U.author_products(listed)


# Topics


@query("""SELECT o_orderkey AS thread, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'feed ' || o_custkey WHEN o_orderkey % 3 = 0 THEN '' ELSE 'page ' || o_custkey END AS title, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 4 <> 0 THEN o_clerk WHEN o_orderkey % 5 = 0 THEN 'anonymous' ELSE 'author ' || o_custkey END AS author,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate ELSE o_orderdate - INTERVAL 2 DAY END AS published, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0 THEN o_orderdate ELSE o_orderdate + INTERVAL 3 DAY END AS activity FROM (SELECT *, o_orderpriority AS o_clerk FROM orders)""")
def feed_backfill(spark, d):
    """Title, author and dates of threads made from a page and a feed item."""
    k, at, day = F.col("o_orderkey"), F.col("o_orderdate"), lambda n: F.expr(f"INTERVAL {n} DAY")
    page = F.struct(F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("page "), "o_custkey")).alias("title"), F.when(k % 5 == 0, U.NAMELESS).otherwise(F.concat(F.lit("author "), "o_custkey")).alias("author"), (at - day(2)).alias("published"), F.when(k % 11 != 0, at).alias("last_post"), (at + day(3)).alias("activity"))
    feed = F.struct(F.when(k % 2 == 0, F.concat(F.lit("feed "), "o_custkey")).alias("title"), F.when(k % 4 != 0, F.col("o_orderpriority")).alias("author"), F.when(k % 7 != 0, at).alias("published"))
    rows = read(spark, d, "orders").select(k.alias("thread"), page.alias("page"), feed.alias("feed"))
    return rows.select("thread", U.feed_over_page(F.col("page"), F.col("feed")).alias("t")).select("thread", "t.*")


def _esc(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _cut(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) > {n} THEN left({c}, {n}) || '…' ELSE {c} END"


@query(f"""WITH t AS (SELECT doc_id, doc_id % 3 = 0 AS reply, coalesce(source, 'none') AS product, {_esc("coalesce(text, '')")} AS x, CASE WHEN doc_id % 5 <> 0 THEN lang END AS author, CASE WHEN doc_id % 4 <> 0 THEN {_esc("coalesce(text, '')")} ELSE '' END AS draft, coalesce(text, '') AS title FROM documents)
SELECT doc_id, md5(CASE WHEN reply THEN 'New customer reply for ' ELSE 'New wp.org topic for ' END || product || ': ' || title) AS text_md5,
md5(CASE WHEN reply THEN ':speech_balloon: *New customer reply — ' ELSE ':speech_balloon: *New wp.org topic — ' END || {_esc('product')} || '*' || chr(10) || '<https://x.example/' || doc_id || '|' || {_cut('x', 200)} || '>' || chr(1)
 || CASE WHEN reply THEN '' ELSE 'Author: ' || coalesce(author, 'unknown') || chr(1) || '> ' || CASE WHEN x = '' THEN '(no excerpt)' ELSE {_cut('x', 300)} END || chr(1) END
 || CASE WHEN draft = '' AND reply THEN '_A follow-up draft couldn''t be generated yet — open /suggestions and hit Regenerate._' WHEN draft = '' THEN '_A draft reply couldn''t be generated yet — open /suggestions to draft one manually._' ELSE CASE WHEN reply THEN '*Suggested follow-up:*' ELSE '*Draft:*' END || chr(10) || '```' || {_cut('draft', 1500)} || '```' END || chr(1) || 'Review in the desk') AS blocks_md5 FROM t""")
def topic_payloads(spark, d):
    """What is announced of every document as a topic or a reply."""
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    rows = read(spark, d, "documents")
    p = U.topic_payload(F.when(k % 3 == 0, "new_reply").otherwise("new_topic"), F.coalesce("source", F.lit("none")), text, F.concat(F.lit("https://x.example/"), k), F.when(k % 5 != 0, F.col("lang")), text, F.when(k % 4 != 0, text), "Review in the desk")
    return rows.select("doc_id", p.alias("p")).select("doc_id", F.md5("p.text").alias("text_md5"), F.md5(F.array_join("p.blocks", "\x01")).alias("blocks_md5"))


# Vectors and change logs


@query("""WITH p AS (SELECT d.text, arg_max(embedding, doc_id) AS v FROM documents d JOIN embeddings ON vec_id = doc_id AND vec_id % 3 <> 0 WHERE d.text IS NOT NULL GROUP BY d.text)
SELECT doc_id, CASE WHEN v IS NULL THEN 'embedded' ELSE 'reused' END AS how, 64::INT AS width, v[1]::DOUBLE AS first FROM documents d LEFT JOIN p ON p.text = d.text""")
def chunks_embedded(spark, d):
    """Every document with a vector: that of a known text, or one from the hashing model."""
    docs, v = read(spark, d, "documents").select("doc_id", "text"), read(spark, d, "embeddings")
    vector = F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 9)).otherwise(F.col("embedding"))  # of another width: not known
    prior = docs.join(v.select(F.col("vec_id").alias("doc_id"), vector.alias("vector")), "doc_id").select("text", "vector", F.col("doc_id").alias("at"))
    out = B.refreshed(docs, prior, "doc_id", "text", "at", B.hashing_model(64), 64)
    first = F.when(F.col("how") == "reused", F.col("vector")[0].cast("double"))
    return out.select("doc_id", "how", F.size("vector").alias("width"), first.alias("first"))


@query("""WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'again' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderdate AS updated FROM orders),
b AS (SELECT o_orderkey, 'late' AS status, NULL::DOUBLE AS price, o_orderdate - INTERVAL 1 DAY AS updated FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, NULL, o_totalprice * 2, o_orderdate + INTERVAL 1 DAY FROM orders WHERE o_orderkey % 13 = 0)
SELECT a.o_orderkey, a.status, CASE WHEN a.o_orderkey % 13 = 0 THEN o_totalprice * 2 ELSE a.price END AS price, a.updated + CASE WHEN a.o_orderkey % 13 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS updated FROM a JOIN orders USING (o_orderkey)""")
def merge_log_state(spark, d):
    """A table after three batches, one of which was merged into its base: what is older,
    or says nothing, changes nothing, and what failed first came through again."""
    o, k, day = read(spark, d, "orders"), F.col("o_orderkey"), F.expr("INTERVAL 1 DAY")
    path, none = scratch(spark, "mergelog"), lambda kind: F.lit(None).cast(kind)
    G.create(spark, path, "o_orderkey bigint, status string, price double, updated timestamp")
    write = G.commit_batches(path, ["o_orderkey"], "updated", F.col("status") != "bad", lambda x: x.withColumn("status", F.lit("again")))
    row = lambda status, price, at: (k, status.alias("status"), price.alias("price"), at.alias("updated"))
    write(o.select(*row(F.when(k % 7 == 0, "bad").otherwise(F.col("o_orderstatus")), F.when(k % 11 != 0, F.col("o_totalprice")), F.col("o_orderdate"))), 0)
    write(o.where(k % 5 == 0).select(*row(F.lit("late"), none("double"), F.col("o_orderdate") - day)), 1)
    G.compact(spark, path, ["o_orderkey"], "updated")
    # Good once it says anything but bad; a null status is good here.
    write = G.commit_batches(path, ["o_orderkey"], "updated", F.coalesce(F.col("status") != "bad", F.lit(True)))
    write(o.where(k % 13 == 0).select(*row(none("string"), F.col("o_totalprice") * 2, F.col("o_orderdate") + day)), 2)
    return G.read(spark, path, ["o_orderkey"], "updated")
