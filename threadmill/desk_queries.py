"""Registered queries of the desk operators, with their SQL.

As in ``catalog`` the tables of the test data stand in for the engine's: customers
are plugins and nations their brands, orders are threads or sources, events runs or
conversations, line items posts or chunks, conversations messages.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import query, read, threads, _THREADS
from .functions import desk as D
from .operators import desk as O
from .operators import imports as J
from .operators import incremental as I
from .operators import products as P
from .operators import search as S

AT = "TIMESTAMP '1998-08-02 00:00:00'"
_PLUGINS = """plugins AS (SELECT c_custkey AS plugin, c_name AS name, CASE WHEN c_custkey % 6 <> 0 THEN lower(replace(c_name, '#', '-')) END AS slug, c_nationkey AS brand FROM customer)"""
_SOURCES = """sources AS (SELECT o_orderkey AS source, o_custkey AS plugin, o_orderstatus = 'P' AS forum, o_orderkey % 3 AS chunks, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 400 END AS pages,
  CASE o_orderkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'idle' ELSE 'ready' END AS status FROM orders)"""


def plugins(spark, d):
    slug = F.when(F.col("c_custkey") % 6 != 0, F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))))
    return read(spark, d, "customer").select(F.col("c_custkey").alias("plugin"), F.col("c_name").alias("name"), slug.alias("slug"), F.col("c_nationkey").alias("brand"))


def sources(spark, d):
    k = F.col("o_orderkey")
    status = F.when(k % 5 == 0, "failed").when(k % 5 == 1, "idle").otherwise("ready")
    return read(spark, d, "orders").select(k.alias("source"), F.col("o_custkey").alias("plugin"), (F.col("o_orderstatus") == "P").alias("forum"), (k % 3).alias("chunks"), F.when(k % 7 != 0, k % 400).alias("pages"), status.alias("status"))


# Filters


@query(f"""WITH {_PLUGINS}, {_SOURCES}, g AS (SELECT plugin, bool_or(forum) AS f, bool_or(NOT forum) AS o, max(chunks) AS c FROM sources GROUP BY plugin)
SELECT plugin, NOT coalesce(o, false) AS missing_docs, NOT coalesce(f, false) AS missing_forum, coalesce(c = 0, false) AS never_ingested FROM plugins LEFT JOIN g USING (plugin)""")
def plugin_gaps(spark, d):
    return O.source_gaps(plugins(spark, d).select("plugin"), sources(spark, d), "plugin")


@query(f"WITH {_THREADS} SELECT id FROM threads WHERE promised_at IS NULL OR promised_at >= TIMESTAMP '1996-01-01'")
def topics_not_older(spark, d):
    return threads(spark, d).where(O.not_older(F.col("promised_at"), F.expr("TIMESTAMP '1996-01-01 00:00:00'"))).select("id")


@query(f"WITH {_THREADS} SELECT id FROM threads WHERE promised_at >= TIMESTAMP '1996-01-01'")
def replies_dated(spark, d):
    return threads(spark, d).where(O.dated_from(F.col("promised_at"), F.expr("TIMESTAMP '1996-01-01 00:00:00'"))).select("id")


_DRAFTS = """drafts AS (SELECT *, CASE id % 4 WHEN 0 THEN '[{"text":"t' || id || '"}]' WHEN 1 THEN '[{"provider":"x"},{"text":""}]' WHEN 2 THEN '{"text":"no list"}' END AS drafts,
  CASE WHEN id % 9 = 0 THEN 'answer' END AS answer FROM threads)"""


def drafts(spark, d):
    k = F.col("id")
    text = F.when(k % 4 == 0, F.concat(F.lit('[{"text":"t'), k, F.lit('"}]'))).when(k % 4 == 1, '[{"provider":"x"},{"text":""}]').when(k % 4 == 2, '{"text":"no list"}')
    return threads(spark, d).withColumns({"drafts": text, "answer": F.when(k % 9 == 0, "answer")})


@query(f"WITH {_THREADS}, {_DRAFTS} SELECT id FROM drafts WHERE status IN ('new', 'failed', 'drafted') AND answer IS NULL AND id % 4 <> 0")
def draftless_threads(spark, d):
    """Open threads without an answer and without any draft that has text."""
    return drafts(spark, d).where(O.draftless(F.col("status"), F.col("answer"), F.col("drafts"))).select("id")


@query(f"WITH {_THREADS}, {_DRAFTS} SELECT id, CASE WHEN status = 'drafted' AND answer IS NULL AND id % 4 <> 0 THEN 'new' ELSE status END AS status FROM drafts")
def repair_drafted(spark, d):
    """Drafted threads without a draft are new again."""
    empty = (F.col("status") == "drafted") & F.col("answer").isNull() & ~O.has_draft(F.col("drafts"))
    return drafts(spark, d).select("id", F.when(empty, "new").otherwise(F.col("status")).alias("status"))


@query(f"WITH {_THREADS} SELECT id FROM threads WHERE last_activity IS NULL OR last_activity >= TIMESTAMP '1998-08-02' - INTERVAL 30 DAY")
def repair_delete_stale(spark, d):
    return threads(spark, d).where(O.not_older(F.col("last_activity"), F.expr(f"{AT} - INTERVAL 30 DAYS"))).select("id")


@query(f"WITH {_THREADS} SELECT id, coalesce(last_activity, waiting_since) AS last_activity FROM threads")
def repair_last_activity(spark, d):
    return threads(spark, d).select("id", F.coalesce("last_activity", "waiting_since").alias("last_activity"))


_FOLLOW = """f AS (SELECT *, CASE id % 3 WHEN 0 THEN '{"skipped":"support_last","generatedAt":"1997-03-0' || (1 + id % 9) || 'T10:00:00Z"}' WHEN 1 THEN '{"skipped":"support_last","generatedAt":"never"}' ELSE '{"drafts":[]}' END AS follow FROM threads)"""


def follow(spark, d):
    k = F.col("id")
    text = F.when(k % 3 == 0, F.concat(F.lit('{"skipped":"support_last","generatedAt":"1997-03-0'), 1 + k % 9, F.lit('T10:00:00Z"}'))).when(k % 3 == 1, '{"skipped":"support_last","generatedAt":"never"}').otherwise('{"drafts":[]}')
    return threads(spark, d).withColumn("follow", text)


@query(f"WITH {_THREADS}, {_FOLLOW} SELECT id, CASE WHEN waiting_since IS NULL AND promised_at IS NULL AND id % 3 < 2 THEN last_activity ELSE waiting_since END AS waiting_since FROM f")
def repair_waiting(spark, d):
    """A clock for threads whose last pass saw support last."""
    seen = F.get_json_object("follow", "$.skipped") == "support_last"
    due = F.col("waiting_since").isNull() & F.col("promised_at").isNull() & seen
    return follow(spark, d).select("id", F.when(due, F.col("last_activity")).otherwise(F.col("waiting_since")).alias("waiting_since"))


@query(f"""WITH {_THREADS}, {_FOLLOW} SELECT id, coalesce(waiting_since, CASE WHEN promised_at IS NULL AND id % 3 = 0 THEN TIMESTAMP '1997-03-01 10:00:00' + INTERVAL 1 DAY * (id % 9)::INT END) AS waiting_since FROM f""")
def repair_waiting_again(spark, d):
    """The same from the time of the pass where no activity is known; unreadable
    times change nothing, and a second run changes nothing."""
    made = F.try_to_timestamp(F.get_json_object("follow", "$.generatedAt"))
    seen = (F.get_json_object("follow", "$.skipped") == "support_last") & F.col("promised_at").isNull()
    return follow(spark, d).select("id", F.coalesce("waiting_since", F.when(seen, made)).alias("waiting_since"))


@query(f"""WITH {_THREADS} SELECT id FROM threads WHERE waiting_since IS NOT NULL AND NOT resolved AND coalesce(last_activity, TIMESTAMP '1990-01-01') < TIMESTAMP '1998-08-02' - INTERVAL 1 HOUR AND status <> 'dismissed' AND plugin % 6 <> 0
ORDER BY waiting_since, id LIMIT 20""")
def refresh_candidates(spark, d):
    t = threads(spark, d).join(plugins(spark, d).select("plugin", "slug"), "plugin")
    updated = F.coalesce("last_activity", F.expr("TIMESTAMP '1990-01-01 00:00:00'"))
    due = O.refresh_due(F.col("status"), F.col("waiting_since"), F.col("resolved"), updated, F.col("slug"), F.expr(AT))
    return t.where(due).orderBy("waiting_since", "id").limit(20).select("id")


_CONVS = """convs AS (SELECT o_orderkey AS conv, o_orderkey % 8 = 0 AS junk, CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'pending' END AS state, o_custkey % 9 AS brand FROM orders),
held AS (SELECT DISTINCT l_orderkey AS conv FROM lineitem WHERE l_linenumber = 2), fit AS (SELECT DISTINCT l_orderkey AS conv FROM lineitem WHERE l_returnflag = 'R')"""


def convs(spark, d):
    o = read(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "O", "pending")
    c = o.select(F.col("o_orderkey").alias("conv"), (F.col("o_orderkey") % 8 == 0).alias("junk"), state.alias("state"), (F.col("o_custkey") % 9).alias("brand"))
    lines = read(spark, d, "lineitem")
    return c, lines.where("l_linenumber = 2").select(F.col("l_orderkey").alias("conv")), lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("conv"))


@query(f"""WITH {_CONVS}, w AS (SELECT conv, CASE WHEN junk AND conv IN (FROM held) THEN 'purge_junk' WHEN NOT junk AND state IS NOT DISTINCT FROM 'resolved' THEN 'rebuild'
WHEN NOT junk AND conv IN (FROM held) AND state IS DISTINCT FROM 'resolved' AND conv NOT IN (FROM fit) THEN 'purge_stale' END AS work FROM convs) SELECT * FROM w WHERE work IS NOT NULL""")
def rebuild_lists(spark, d):
    return O.work_lists(*convs(spark, d), "conv")


@query(f"""WITH {_CONVS}, w AS (SELECT conv, CASE WHEN junk AND conv IN (FROM held) THEN 'purge_junk' WHEN NOT junk AND state IS NOT DISTINCT FROM 'resolved' THEN 'rebuild'
WHEN NOT junk AND conv IN (FROM held) AND state IS DISTINCT FROM 'resolved' AND conv NOT IN (FROM fit) THEN 'purge_stale' END AS work FROM convs) SELECT work, count(*) AS n FROM w WHERE work IS NOT NULL GROUP BY work""")
def rebuild_summary(spark, d):
    return O.work_lists(*convs(spark, d), "conv").groupBy("work").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH h AS (SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), 'clown'))
SELECT doc_id FROM documents WHERE contains(lower(source), 'clown') OR contains(lower(lang), 'clown') OR doc_id IN (FROM h) OR (NOT EXISTS (FROM h) AND contains(lower(text), 'clown'))""")
def search_any_field(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text", "source", "lang")
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit("clown")), F.lit(False))
    return O.found_or_like(docs, S.match_all(docs.select("doc_id", "text"), "text", ["clown"]).select("doc_id"), "doc_id", has("text"), has("source") | has("lang")).select("doc_id")


@query("SELECT event_id, CASE WHEN event_type IN ('needs-reply', 'needs-resolved', 'drafted', 'dismissed', 'all') THEN event_type ELSE 'needs-reply' END AS tab FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'drafted' WHEN 1 THEN event_type END AS event_type FROM events)")
def tab_of_request(spark, d):
    asked = F.when(F.col("event_id") % 3 == 0, "drafted").when(F.col("event_id") % 3 == 1, F.col("event_type"))
    return read(spark, d, "events").select("event_id", D.one_of(asked, D.TABS, "needs-reply").alias("tab"))


@query("SELECT event_id, coalesce(CASE event_id % 3 WHEN 0 THEN 400 WHEN 1 THEN 429 END = 400 AND CASE event_id % 2 WHEN 0 THEN 'page_number_too_high' ELSE event_type END = 'page_number_too_high', false) AS ended FROM events")
def page_ceilings(spark, d):
    k = F.col("event_id")
    return read(spark, d, "events").select("event_id", D.page_ceiling(F.when(k % 3 == 0, 400).when(k % 3 == 1, 429), F.when(k % 2 == 0, "page_number_too_high").otherwise(F.col("event_type"))).alias("ended"))


# Lists


@query(f"WITH {_THREADS} SELECT id FROM threads ORDER BY last_activity DESC NULLS LAST, waiting_since DESC NULLS LAST, id LIMIT 50")
def thread_list(spark, d):
    return threads(spark, d).orderBy(F.desc_nulls_last("last_activity"), F.desc_nulls_last("waiting_since"), "id").limit(50).select("id")


@query(f"""WITH {_THREADS} (SELECT id, 0 AS half FROM p WHERE flagged ORDER BY last_activity DESC NULLS LAST, id LIMIT 50) UNION ALL (SELECT id, 1 FROM p WHERE backlog ORDER BY last_activity DESC NULLS LAST, id LIMIT 50)""")
def needs_reply_halves(spark, d):
    from .operators import relational as R

    cut = F.expr(AT)
    return O.top_of_each(threads(spark, d), [R.flagged(cut), R.backlog(cut)], [F.desc_nulls_last("last_activity"), F.asc("id")]).select("id", "half")


@query(f"WITH {_PLUGINS} SELECT plugin, name, n_name AS brand_name, row_number() OVER (PARTITION BY n_name ORDER BY name, plugin)::INT AS place FROM plugins JOIN nation ON n_nationkey = brand ORDER BY n_name, place")
def plugins_by_brand(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("brand"), F.col("n_name").alias("brand_name"))
    place = F.row_number().over(Window.partitionBy("brand_name").orderBy("name", "plugin"))
    return plugins(spark, d).join(n, "brand").select("plugin", "name", "brand_name", place.alias("place")).orderBy("brand_name", "place")


@query("SELECT o_orderkey, count(l_linenumber) AS n_files, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS files FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def messages_with_files(spark, d):
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    out = O.gathered(read(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey", ["l_linenumber", "l_partkey"], [], "files")
    names = F.array_join(F.transform("files", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",")
    return out.select("o_orderkey", F.size("files").cast("long").alias("n_files"), names.alias("files"))


@query("SELECT conv_id, count(*) AS n_messages, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def conversation_detail(spark, d):
    turns = read(spark, d, "conversations")
    out = O.gathered(turns.select("conv_id").distinct(), turns, "conv_id", ["turn"], ["role"], "messages")
    return out.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.array_join(F.transform("messages", lambda m: m["role"]), ">").alias("roles"))


@query(f"""WITH {_PLUGINS}, r AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN upper('Customer#' || lpad(o_custkey::VARCHAR, 9, '0')) WHEN 1 THEN 'CUSTOMER-' || lpad(o_custkey::VARCHAR, 9, '0') ELSE '?' END AS hint,
CASE WHEN o_orderkey % 2 = 0 THEN 'customer-' || lpad((o_custkey + 1)::VARCHAR, 9, '0') END AS page FROM orders)
SELECT id, coalesce(least(a.plugin, b.plugin), c.plugin) AS plugin FROM r LEFT JOIN plugins a ON lower(a.name) = lower(hint) LEFT JOIN plugins b ON b.slug = lower(hint) LEFT JOIN plugins c ON c.slug = page""")
def plugin_of_hint(spark, d):
    k, pad = F.col("o_orderkey"), lambda c: F.lpad(c.cast("string"), 9, "0")
    hint = F.when(k % 3 == 0, F.concat(F.lit("CUSTOMER#"), pad(F.col("o_custkey")))).when(k % 3 == 1, F.concat(F.lit("CUSTOMER-"), pad(F.col("o_custkey")))).otherwise("?")
    page = F.when(k % 2 == 0, F.concat(F.lit("customer-"), pad(F.col("o_custkey") + 1)))
    rows = read(spark, d, "orders").select(k.alias("id"), hint.alias("hint"), page.alias("page"))
    return O.hinted(rows, plugins(spark, d), "hint", "page").select("id", "plugin")


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)::DOUBLE[]) AS s FROM embeddings),
t AS (SELECT vec_id, row_number() OVER (ORDER BY s DESC, vec_id)::INT AS place FROM s ORDER BY place LIMIT 20)
SELECT place, vec_id, lang, source, toxic FROM t JOIN documents d ON d.doc_id = vec_id LEFT JOIN labels l ON l.doc_id = vec_id""")
def hydrated_hits(spark, d):
    """The nearest vectors, best first, with their documents, which they must have, and labels."""
    v = read(spark, d, "embeddings")
    ranked = S.vector_search(v, "vec_id", "embedding", v.where("vec_id = 0").select("embedding").first()["embedding"], 20)
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source")
    labels = read(spark, d, "labels").select(F.col("doc_id").alias("vec_id"), "toxic")
    return S.hydrate(ranked, docs.join(labels, "vec_id", "left"), "vec_id", F.desc("similarity")).select("place", "vec_id", "lang", "source", "toxic")


@query("""SELECT user_id, min(event_id) AS "first", max(event_id) AS "last", coalesce(max(event_id) FILTER (event_type = 'click'), max(event_id)) AS latest_customer FROM events GROUP BY user_id""")
def post_ends(spark, d):
    return O.post_ends(read(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "click")


# Summaries


@query(f"WITH {_SOURCES} SELECT count(*) AS n_sources, count(*) FILTER (status = 'ready') AS n_ready, count(*) FILTER (status = 'failed') AS n_failed, coalesce(sum(pages), 0)::BIGINT AS pages, count(DISTINCT plugin) FILTER (chunks > 0) AS holders, count(*) FILTER (status <> 'failed' AND pages >= 300) AS n_capped FROM sources")
def knowledge_coverage(spark, d):
    return O.knowledge(sources(spark, d), F.col("chunks"), 300)


@query("SELECT DISTINCT tag FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) WHERE tag <> '' ORDER BY tag LIMIT 200")
def distinct_tags(spark, d):
    return read(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("tag")).where("tag <> ''").distinct().orderBy("tag").limit(200)


@query("SELECT count(*) FILTER (o_custkey % 9 = 4) AS conversations, count(*) FILTER (o_custkey % 9 = 4 AND o_orderstatus = 'F') AS resolved, count(DISTINCT o_custkey % 9) AS brands, max(o_orderdate) AS last_sync FROM orders")
def dashboard_stats(spark, d):
    """Counts of one brand, and what stays global."""
    mine = F.col("o_custkey") % 9 == 4
    return read(spark, d, "orders").agg(F.count_if(mine).alias("conversations"), F.count_if(mine & (F.col("o_orderstatus") == "F")).alias("resolved"), F.count_distinct(F.col("o_custkey") % 9).alias("brands"), F.max("o_orderdate").alias("last_sync"))


@query("SELECT o_custkey, round(count(*) FILTER (o_orderstatus = 'F') * 100 / count(*))::INT AS percent FROM orders GROUP BY 1")
def resolved_share(spark, d):
    g = read(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count(F.lit(1)).alias("b"))
    return g.select("o_custkey", D.share_percent(F.col("a"), F.col("b")).alias("percent"))


@query("SELECT greatest(coalesce(max(b) FILTER (kind <> 'range' AND (synced > 0 OR b > a)), 1), 1) AS page FROM (SELECT event_type AS kind, 1 + event_id % 5 AS a, 1 + event_id % 11 AS b, event_id % 3 AS synced FROM events)")
def resume_page_global(spark, d):
    k = F.col("event_id")
    return O.resume_page(read(spark, d, "events").select(F.col("event_type").alias("kind"), (1 + k % 5).alias("page_from"), (1 + k % 11).alias("page_to"), (k % 3).alias("synced")))


@query("SELECT least((SELECT coalesce(max(o_custkey), 0) + 1 FROM orders WHERE o_orderpriority = '5-LOW'), (SELECT greatest(count(*), 1) FROM customer)) AS index")
def resume_index(spark, d):
    return O.resume_index(read(spark, d, "orders").where("o_orderpriority = '5-LOW'"), "o_custkey", read(spark, d, "customer"))


_JUNK_SCAN = """s AS (SELECT conv_id, any_value(conv_id % 4 = 0) AS junk, CASE WHEN conv_id % 8 = 0 THEN 'automated sender' WHEN conv_id % 4 = 0 THEN 'bracketed' END AS reason FROM conversations GROUP BY conv_id)"""


@query(f"""WITH {_JUNK_SCAN} SELECT reason, count(*) AS scanned, count(*) AS junk, count(*) FILTER (conv_id % 12 = 0) AS cleaned FROM s WHERE junk GROUP BY reason
UNION ALL SELECT NULL, count(*), count(*) FILTER (junk), count(*) FILTER (junk AND conv_id % 12 = 0) FROM s""")
def junk_scan_summary(spark, d):
    k = F.col("conv_id")
    s = read(spark, d, "conversations").select(k).distinct().select(k, (k % 4 == 0).alias("junk"), F.when(k % 8 == 0, "automated sender").when(k % 4 == 0, "bracketed").alias("reason"))
    return O.junk_summary(s, s.where(k % 12 == 0), "conv_id")


@query("SELECT n_nationkey AS brand, min(year(o_orderdate) * 12 + month(o_orderdate) - 1)::INT AS first_month FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_nationkey % 5 <> 0 LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def archive_starts(spark, d):
    rows = read(spark, d, "orders").join(read(spark, d, "customer").where("c_nationkey % 5 <> 0"), F.col("o_custkey") == F.col("c_custkey"))
    return O.archive_starts(read(spark, d, "nation").select(F.col("n_nationkey").alias("brand")), rows.withColumn("brand", F.col("c_nationkey")), "brand", "o_orderdate")


@query("SELECT user_id, min(m) AS earliest FROM (SELECT user_id, CASE WHEN event_id % 4 <> 0 THEN 24000 + event_id % 100 END AS m FROM events) GROUP BY user_id")
def earliest_detected(spark, d):
    """The earliest month of a map; null and unreadable values count for nothing."""
    k = F.col("event_id")
    label = F.when(k % 4 != 0, D.month_label(24000 + k % 100)).otherwise("unknown")
    m = read(spark, d, "events").groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(k, label))).alias("months"))
    return m.select("user_id", F.array_min(F.transform(F.map_values("months"), D.parse_month)).cast("long").alias("earliest"))


# Products and tags

_WORDS = r"""defs AS (SELECT * FROM (VALUES (1, 'Small Ring', 1, false), (2, 'red', 2, false), (3, 'wid-get', 3, false), (4, 'widget', 4, true)) t(plugin, name, ord, platform)),
hits AS (SELECT p_partkey, d.*, len(regexp_extract_all(p_name || ', ' || p_type, '(?i)\b' || replace(name, ' ', '\s?') || '\b')) AS hits FROM part, defs d)"""


def product_table(spark):
    none = spark.createDataFrame([], "plugin int, name string, slug string, keywords array<string>, ord int, platform boolean")
    rows = [(1, "Small Ring", None, [" "], 1, False), (2, "red", None, None, 2, False), (3, "wid-get", None, ["x"], 3, False), (4, "widget", None, [], 4, True)]
    return P.definitions(none, spark.createDataFrame(rows, none.schema))


@query(f"WITH {_WORDS} SELECT p_partkey, name, hits::BIGINT AS hits FROM hits WHERE hits > 0")
def product_counts(spark, d):
    part = read(spark, d, "part").select("p_partkey", F.concat_ws(", ", "p_name", "p_type").alias("text"))
    return P.hits(part, "p_partkey", "text", product_table(spark)).select("p_partkey", "name", F.col("hits").cast("long").alias("hits"))


@query(f"""WITH {_WORDS}, tags AS (SELECT p_partkey, unnest(string_split(p_brand || ' ' || CASE WHEN p_partkey % 3 = 0 THEN 'widget' ELSE '' END, ' ')) AS tag FROM part),
t AS (SELECT DISTINCT p_partkey FROM tags WHERE tag = 'widget'),
h AS (SELECT p_partkey, arg_min(name, (platform, -hits, ord)) AS name, arg_min(plugin, (platform, -hits, ord)) AS plugin FROM hits WHERE hits > 0 GROUP BY 1)
SELECT part.p_partkey, CASE WHEN t.p_partkey IS NOT NULL THEN 'widget' ELSE h.name END AS product, CASE WHEN t.p_partkey IS NOT NULL THEN 4 ELSE h.plugin END AS plugin FROM part LEFT JOIN t USING (p_partkey) LEFT JOIN h USING (p_partkey)""")
def primary_product(spark, d):
    tags = F.array("p_brand", F.when(F.col("p_partkey") % 3 == 0, "widget").otherwise(""))
    part = read(spark, d, "part").select("p_partkey", F.concat_ws(", ", "p_name", "p_type").alias("text"), tags.alias("tags"))
    return P.primary(part, "p_partkey", "text", "tags", product_table(spark))


@query("""SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) WHERE tag NOT IN ('red', 'widget') GROUP BY tag ORDER BY n DESC, tag LIMIT 20""")
def orphan_tags(spark, d):
    from .operators import relational as R

    return P.unnamed_tags(R.explode_counts(read(spark, d, "part"), F.split("p_name", " ")), "tag", "n", product_table(spark))


# Scalars


@query(r"""SELECT p_partkey, trim(left(CASE WHEN p_partkey % 4 < 3 THEN p_name ELSE p_name || '-x' END, 100)) AS short FROM part""")
def short_names(spark, d):
    k = F.col("p_partkey")
    full = F.when(k % 4 == 0, F.concat("p_name", F.lit(" – for shops: all"))).when(k % 4 == 1, F.concat("p_name", F.lit(": the plugin"))).when(k % 4 == 2, F.concat("p_name", F.lit(" - free"))).otherwise(F.concat("p_name", F.lit("-x")))
    return read(spark, d, "part").select("p_partkey", D.short_name(full).alias("short"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(left(split_part(p_name, ' ', 1), 1) || left(split_part(p_name, ' ', 2), 1)) ELSE upper(left(split_part(p_name, ' ', 1), 2)) END AS initials FROM part")
def initials_of(spark, d):
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), "p_name")).otherwise(F.split_part("p_name", F.lit(" "), F.lit(1)))
    return read(spark, d, "part").select("p_partkey", D.initials(name).alias("initials"))


@query("SELECT p_partkey, CASE WHEN lower(p_brand) = lower(split_part(p_name, ' ', 1)) THEN p_brand ELSE p_brand || '|' || split_part(p_name, ' ', 1) || CASE WHEN split_part(p_name, ' ', 1) = split_part(p_name, ' ', 2) THEN '' ELSE '|' || split_part(p_name, ' ', 2) END END AS words FROM part")
def keywords_clean(spark, d):
    one, two = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    words = F.array("p_brand", F.concat(F.lit(" "), one), F.upper("p_brand"), F.lit("  "), two, F.upper(one))
    return read(spark, d, "part").select("p_partkey", F.array_join(D.clean_keywords(words), "|").alias("words"))


@query("SELECT p_partkey, (CASE WHEN p_partkey % 2 = 1 THEN 1 ELSE 0 END) + 1 AS n_new FROM part")
def keywords_new(spark, d):
    current = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("Fast Shop"))).otherwise(F.array().cast("array<string>"))
    words = F.array(F.lit("fastshop"), F.lit("x"), F.upper("p_name"), F.lit("brand new"), F.lit("BrandNew"), F.replace("p_name", F.lit(" "), F.lit("-")))
    return read(spark, d, "part").select("p_partkey", F.size(D.new_keywords(words, current, F.col("p_name"), F.replace("p_name", F.lit(" "), F.lit("-")))).alias("n_new"))


@query(r"SELECT conv_id, turn, coalesce(regexp_matches(CASE WHEN turn % 2 = 0 THEN ' Yes, ' ELSE '' END || text, '(?i)^\s*yes\b'), false) AS promise FROM conversations")
def promise_answers(spark, d):
    said = F.concat(F.when(F.col("turn") % 2 == 0, " Yes, ").otherwise(""), "text")
    return read(spark, d, "conversations").select("conv_id", "turn", D.promise_answer(said).alias("promise"))


@query(r"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props END AS body FROM events")
def json_in_text(spark, d):
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Sure:\n"), "props", F.lit("\nDone."))).otherwise("no } json {")
    return read(spark, d, "events").select("event_id", D.json_slice(text).alias("body"))


@query("""WITH RECURSIVE h AS (SELECT c_custkey, c_name AS s, 0 AS i, 5381::BIGINT AS h FROM customer UNION ALL SELECT c_custkey, s, i + 1, (h * 33 + ascii(substring(s, i + 1, 1))) % 4294967296 FROM h WHERE i < length(s))
SELECT c_custkey, (h % 1000000)::BIGINT AS hash FROM h WHERE i = length(s)""")
def session_hashes(spark, d):
    return read(spark, d, "customer").select("c_custkey", D.session_hash(F.col("c_name")).alias("hash"))


@query(r"""WITH m AS (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations)
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN nullif(t, '') WHEN 1 THEN '[attachment: a' || turn || '.png]' WHEN 2 THEN nullif(t, '') END AS line, CASE WHEN turn % 4 = 1 THEN 'https://x/' || conv_id END AS url FROM m""")
def message_lines(spark, d):
    k = F.col("turn")
    kind = F.element_at(F.array(*map(F.lit, ("text", "file", "picker", "event"))), (k % 4 + 1).cast("int"))
    quoted = F.substring_index(F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r'(?s)\A\{"t":(.*)\}\z', 1), "\0", 1)
    content = F.when(k % 4 == 0, quoted).when(k % 4 == 1, F.concat(F.lit('{"name":"a'), k, F.lit('.png","url":"https://x/'), "conv_id", F.lit('"}'))).when(k % 4 == 2, F.concat(F.lit('{"text":" ","value":'), quoted, F.lit("}"))).otherwise("{}")
    return read(spark, d, "conversations").select("conv_id", "turn", D.message_line(kind, content).alias("line"), D.attached_file(kind, content)["url"].alias("url"))


@query("""SELECT o_orderkey, (year(o_orderdate) * 12 + month(o_orderdate) - 1)::INT AS index, strftime(o_orderdate, '%Y-%m') AS label, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::TIMESTAMP - INTERVAL 1 MILLISECOND AS month_end FROM orders""")
def month_arithmetic(spark, d):
    index = D.parse_month(F.date_format("o_orderdate", "yyyy-MM"))
    return read(spark, d, "orders").select("o_orderkey", index.alias("index"), D.month_label(index).alias("label"), D.end_of_month(F.col("o_orderdate")).alias("month_end"))


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '1997-02-30' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS a, CASE WHEN o_orderkey % 7 <> 0 THEN '1997-06-15' END AS b FROM orders)
SELECT o_orderkey, CASE WHEN a IS NULL AND b IS NULL THEN NULL WHEN a IS NULL OR b IS NULL THEN 'one end is missing' WHEN o_orderkey % 5 IN (1, 2) THEN 'not a day' WHEN a > b THEN 'ends before it starts' END AS problem FROM r""")
def range_checks(spark, d):
    k = F.col("o_orderkey")
    a = F.when(k % 5 == 1, "").when(k % 5 == 2, "1997-02-30").when(k % 5 > 2, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return read(spark, d, "orders").select("o_orderkey", D.range_problem(a, F.when(k % 7 != 0, "1997-06-15")).alias("problem"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE 64 END::INT AS width FROM embeddings")
def vectors_checked(spark, d):
    v = F.when(F.col("vec_id") % 6 == 0, F.slice("embedding", 1, 10)).when(F.col("vec_id") % 3 == 0, F.transform("embedding", lambda x, i: F.when(i == 5, F.lit(float("nan"))).otherwise(x))).otherwise(F.col("embedding"))
    return read(spark, d, "embeddings").select("vec_id", F.size(D.valid_vector(v, 64)).alias("n")).select("vec_id", F.when(F.col("n") > 0, F.col("n")).alias("width"))


@query("SELECT l_shipdate, count(*) FILTER (l_returnflag = 'R') = 0 AND count(*) FILTER (l_returnflag = 'N') > 0 AS stop FROM lineitem GROUP BY 1")
def range_stops(spark, d):
    g = read(spark, d, "lineitem").groupBy("l_shipdate").agg(F.count_if(F.col("l_returnflag") == "R").alias("a"), F.count_if(F.col("l_returnflag") == "N").alias("b"))
    return g.select("l_shipdate", D.stops_walk(F.col("a"), F.col("b")).alias("stop"))


@query(r"SELECT conv_id, coalesce(nullif(regexp_replace(CASE WHEN conv_id % 2 = 0 THEN ' ' ELSE ' T' || conv_id END, '^\s+|\s+$', '', 'g'), ''), left(text, 80)) AS title, 'T' || conv_id || chr(10) || left(text, 400) AS query FROM conversations WHERE turn = 0")
def titles_and_queries(spark, d):
    k = F.col("conv_id")
    title = F.when(k % 2 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" T"), k))
    return read(spark, d, "conversations").where("turn = 0").select("conv_id", D.title_or_start(title, F.col("text")).alias("title"), D.followup_query(F.concat(F.lit("T"), k), F.col("text")).alias("query"))


@query("SELECT page_id, '[' || CASE WHEN page_id % 2 = 0 THEN 'Forum Q&A: ' ELSE 'Docs: ' END || 'P' || page_id || CASE WHEN page_id % 3 = 0 THEN '' ELSE ' | title' END || ' | ' || url || ']' AS header FROM pages")
def docs_headers(spark, d):
    k = F.col("page_id")
    return read(spark, d, "pages").select("page_id", D.docs_header(k % 2 == 0, F.concat(F.lit("P"), k), F.when(k % 3 != 0, " title"), F.col("url")).alias("header"))


@query("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS body FROM pages")
def chat_escapes(spark, d):
    return read(spark, d, "pages").select("page_id", D.escaped(F.col("html")).alias("body"))


# State rules


@query(f"""WITH {_THREADS}, x AS (SELECT *, CASE id % 6 WHEN 0 THEN 'support_last' WHEN 1 THEN 'gentle_close' WHEN 2 THEN 'fetch_failed' WHEN 3 THEN 'no_replies' ELSE 'draft' END AS outcome,
CASE WHEN id % 5 <> 0 THEN waiting_since + INTERVAL 30 MINUTE * (id % 5)::INT END AS page FROM threads)
SELECT id, CASE WHEN id % 6 < 2 THEN CASE WHEN waiting_since IS NULL THEN coalesce(page, last_activity, TIMESTAMP '1998-08-02') WHEN abs(epoch_ms(page) - epoch_ms(waiting_since)) > 3600000 THEN page ELSE waiting_since END WHEN id % 6 < 4 THEN waiting_since END AS waiting_since FROM x""")
def waiting_clock(spark, d):
    k = F.col("id")
    outcome = F.when(k % 6 == 0, "support_last").when(k % 6 == 1, "gentle_close").when(k % 6 == 2, "fetch_failed").when(k % 6 == 3, "no_replies").otherwise("draft")
    page = F.when(k % 5 != 0, F.col("waiting_since") + F.expr("make_dt_interval(0, 0, cast(30 * (id % 5) as int), 0)"))
    none = F.lit(None).cast("timestamp")
    return threads(spark, d).select("id", O.waiting_after_draft(F.col("waiting_since"), outcome, page, F.col("last_activity"), none, F.expr(AT)).alias("waiting_since"))


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'fetch_failed' WHEN event_id % 4 < 2 THEN 'no_replies' WHEN event_id % 2 = 0 AND event_id % 3 <> 0 AND event_id % 5 = 0 AND event_id % 7 <> 0 THEN 'gentle_close' WHEN event_id % 2 = 0 AND event_id % 3 <> 0 THEN 'support_last' ELSE 'draft' END AS outcome FROM events""")
def followup_outcomes(spark, d):
    k = F.col("event_id")
    return read(spark, d, "events").select("event_id", O.followup_outcome(k % 11 != 0, k % 4, k % 2 == 0, k % 3 == 0, k % 5 == 0, k % 7 == 0).alias("outcome"))


@query(f"WITH {_THREADS} SELECT plugin, count(*) > 3 AND (max(last_activity) IS NULL OR TIMESTAMP '1998-08-02' - max(last_activity) >= INTERVAL 22 HOUR) AS due FROM threads GROUP BY plugin")
def digests_due(spark, d):
    g = threads(spark, d).groupBy("plugin").agg(F.count(F.lit(1)).alias("n"), F.max("last_activity").alias("sent"))
    return g.select("plugin", O.digest_due(F.when(F.col("n") > 3, F.col("n")).otherwise(0), F.col("sent"), F.expr(AT)).alias("due"))


@query(f"""WITH {_THREADS}, r AS (SELECT * FROM p WHERE needs_resolved), f AS (SELECT * FROM r ORDER BY waiting_since, id LIMIT 15)
SELECT (SELECT string_agg('#' || id, chr(10) ORDER BY waiting_since, id) FROM f) AS lines, (SELECT CASE WHEN count(*) > 15 THEN '+' || (count(*) - 15) || ' more' END FROM r) AS more""")
def digest_payload(spark, d):
    from .operators import relational as R

    rows = threads(spark, d).where(R.needs_resolved(F.expr(AT)))
    return O.digest_lines(rows, [F.col("waiting_since"), F.col("id")], F.concat(F.lit("#"), "id"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'drafted' WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 'failed' ELSE 'new' END ELSE 'drafted' END AS status, CASE event_id % 3 WHEN 0 THEN 'b' WHEN 2 THEN 'a' END AS answer FROM events")
def draft_statuses(spark, d):
    k, one = F.col("event_id"), lambda t: F.struct(F.lit(t).alias("text"))
    drafts = F.when(k % 3 == 0, F.array(one(""), one("b"))).when(k % 3 == 1, F.array(one(""))).otherwise(F.array(one("a"), one("b")))
    return read(spark, d, "events").select("event_id", O.draft_status(drafts, F.when(k % 2 == 0, 2).otherwise(0)).alias("s")).select("event_id", "s.status", "s.answer")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 1 ELSE coalesce(CASE WHEN event_id % 3 <> 0 THEN event_id % 7 END, 1) END::BIGINT AS page FROM events")
def first_pages(spark, d):
    k = F.col("event_id")
    pages = F.when(k % 3 != 0, F.create_map(F.lit("a"), k % 7, F.lit("b"), k)).otherwise(F.create_map(F.lit("b"), k))
    return read(spark, d, "events").select("event_id", O.page_from(F.when(k % 5 == 0, "range").otherwise("full"), pages, F.array(F.lit("a"), F.lit("b"))).cast("long").alias("page"))


@query("SELECT c_custkey, nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END || ' ' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END), '') AS name FROM customer")
def roster_names(spark, d):
    k = F.col("c_custkey")
    return read(spark, d, "customer").select("c_custkey", O.roster_name(F.when(k % 3 == 0, " ").otherwise(F.col("c_name")), F.when(k % 2 != 0, F.col("c_mktsegment"))).alias("name"))


@query("""SELECT coalesce(a.page_id, b.page_id) AS page_id, CASE WHEN a.page_id IS NULL THEN 'add' WHEN b.page_id IS NULL THEN 'drop' WHEN a.h = b.h THEN 'keep' ELSE 'rechunk' END AS plan
FROM (SELECT page_id, CASE WHEN page_id % 6 <> 0 THEN sha256(html) END AS h FROM pages WHERE page_id % 5 <> 0) a FULL JOIN (SELECT page_id, sha256(CASE WHEN page_id % 4 = 0 THEN html || '!' ELSE html END) AS h FROM pages WHERE page_id % 7 <> 0) b USING (page_id)""")
def ingest_plans(spark, d):
    p, k = read(spark, d, "pages"), F.col("page_id")
    old = p.where(k % 5 != 0).select(k, F.when(k % 6 != 0, F.sha2("html", 256)).alias("hash"))
    new = p.where(k % 7 != 0).select(k, F.sha2(F.when(k % 4 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html")), 256).alias("hash"))
    return O.ingest_plan(old, new, "page_id", "hash", False)


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN -1 END, c_nationkey) AS brand FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 4 <> 0")
def brands_adopted(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("site"), F.when(F.col("o_orderkey") % 2 == 0, -1).cast("int").alias("brand"))
    return O.adopted(rows, read(spark, d, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("site"), F.col("c_nationkey").alias("brand")), "site", "brand").select("o_orderkey", "brand")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE 10 END AS chunks, CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 'never_recorded' WHEN o_orderstatus <> 'F' THEN 'defs_changed' WHEN o_orderkey % 5 <> 0 THEN 'rules_updated' END AS advice FROM orders")
def rebuild_advice(spark, d):
    k = F.col("o_orderkey")
    chunks = F.when(k % 6 == 0, 0).otherwise(10)
    return read(spark, d, "orders").select("o_orderkey", chunks.alias("chunks"), O.rebuild_advice(chunks, F.when(k % 4 != 0, F.col("o_orderstatus")), F.lit("F"), k % 5, F.lit(0)).alias("advice"))


@query("SELECT p_partkey FROM part WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_size < 3) AND p_partkey IN (SELECT min(p_partkey) FROM part GROUP BY lower(p_name))")
def import_new(spark, d):
    part = read(spark, d, "part")
    return J.first_free(part, part.where("p_size < 3"), ["p_name"], "p_partkey").select("p_partkey")


# Upserts and repairs of tables


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 1 THEN 'new ' || c_name ELSE c_name END AS c_name FROM customer")
def partial_upsert(spark, d):
    """Only values that say something overwrite."""
    c, k = read(spark, d, "customer").select("c_custkey", "c_name"), F.col("c_custkey")
    new = c.where(k % 2 == 0).select(k, F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("new "), "c_name")).alias("c_name"))
    return I.merge_truthy(c, new, "c_custkey", ["c_name"]).select("c_custkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey % 4 <> 0 UNION ALL SELECT DISTINCT l_orderkey, 1, 0 FROM lineitem WHERE l_orderkey % 4 = 0")
def children_replaced(spark, d):
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    new = lines.where("l_orderkey % 4 = 0").select("l_orderkey", F.lit(1).cast(lines.schema["l_linenumber"].dataType).alias("l_linenumber"), F.lit(0).cast(lines.schema["l_partkey"].dataType).alias("l_partkey")).distinct()
    return I.replace_children(lines, new, "l_orderkey")


@query("SELECT event_id, CASE WHEN event_type = 'click' AND ts < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE THEN 'failed' WHEN event_type = 'click' THEN 'running' ELSE event_type END AS status FROM events")
def stale_runs(spark, d):
    e = read(spark, d, "events")
    now = e.agg(F.max("ts")).first()[0]
    runs = e.select("event_id", F.col("ts").alias("started_at"), F.when(F.col("event_type") == "click", "running").otherwise(F.col("event_type")).alias("status"))
    return I.stale_runs(runs, F.lit(now)).select("event_id", "status")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 2 = 0 ELSE event_type = 'error' END AS junk FROM events")
def junk_overrides(spark, d):
    k = F.col("event_id")
    return read(spark, d, "events").select("event_id", I.junk_override(k % 2 == 0, k % 3 == 0, F.col("event_type") == "error").alias("junk"))


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def last_value_wins(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("SELECT doc_id, e.embedding IS NOT NULL AS has_vector, false AS has_json FROM documents LEFT JOIN embeddings e ON vec_id = doc_id")
def vectors_stored(spark, d):
    """A stored vector takes the place of the copy in JSON."""
    docs = read(spark, d, "documents").select("doc_id", F.lit("[]").alias("json"))
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), D.valid_vector(F.col("embedding"), 64).alias("v"))
    j = docs.join(v, "doc_id", "left").withColumn("json", F.when(F.col("v").isNull(), F.col("json")))
    return j.select("doc_id", F.col("v").isNotNull().alias("has_vector"), (F.col("json").isNotNull() & F.col("v").isNotNull()).alias("has_json"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a=1,c=' WHEN 1 THEN 'a=1,b=3' ELSE 'a=1,b=2' END AS merged FROM events""")
def maps_merged(spark, d):
    """The right map wins, and so does a null in it."""
    k = F.col("event_id")
    left = F.when(k % 3 == 0, F.create_map(F.lit("a"), F.lit(1), F.lit("c"), F.lit(9))).otherwise(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)))
    right = F.when(k % 3 == 0, F.create_map(F.lit("c"), F.lit(None).cast("int"))).when(k % 3 == 1, F.create_map(F.lit("b"), F.lit(3))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")))
    pairs = F.transform(F.array_sort(F.map_entries(I.map_merge(left, right))), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"].cast("string"), F.lit(""))))
    return read(spark, d, "events").select("event_id", F.array_join(pairs, ",").alias("merged"))
