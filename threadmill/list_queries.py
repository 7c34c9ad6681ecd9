"""Registered queries of lists with all their filters, nested site maps, excerpts and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query, read
from .functions import text as T
from .operators import desk as O
from .operators import incremental as I
from .operators import messages as M
from .operators import relational as R
from .reader_queries import _gathered, _xml
from .sources import documents as S


def _listed(spark, d):
    """Orders as conversations, their lines as files and as chunks with products."""
    orders = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    rows = orders.select(k.alias("conv"), F.col("o_orderstatus").alias("state"), F.col("c_nationkey").alias("brand"), F.split("o_orderpriority", "-").alias("tags"), F.col("c_name").alias("email"), F.col("c_mktsegment").alias("operator"), (F.col("o_totalprice") < 60000).alias("junk"), F.concat(F.lit("Order "), k, F.lit(" "), F.col("o_orderpriority")).alias("preview"), F.col("o_orderdate").cast("timestamp_ntz").alias("last_message_at"))
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("conv"), "l_linenumber", "l_returnflag")
    files = lines.where("l_linenumber = 3").select("conv")
    return rows, files, lines.select("conv", F.col("l_returnflag").alias("product"))


_ROWS = "r AS (SELECT o_orderkey AS conv, o_orderstatus AS state, c_nationkey AS brand, string_split(o_orderpriority, '-') AS tags, c_name AS email, c_mktsegment AS operator, o_totalprice < 60000 AS junk, 'Order ' || o_orderkey || ' ' || o_orderpriority AS preview, o_orderdate::TIMESTAMP AS moment FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(f"""WITH {_ROWS} SELECT conv FROM r WHERE state = 'F' AND moment BETWEEN TIMESTAMP '1993-01-01' AND TIMESTAMP '1997-06-30' AND NOT junk AND contains(lower(email), 'customer') AND contains(lower(preview), '1')
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = conv AND l_linenumber = 3) AND (EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = conv AND l_returnflag = 'R') OR list_contains(tags, 'R'))""")
def list_by_product(spark, d):
    rows, files, chunks = _listed(spark, d)
    at = lambda day: F.expr(f"TIMESTAMP_NTZ '{day} 00:00:00'")
    return R.listed(rows, "conv", files, chunks, state="F", email="CUSTOMER", junk="hide", preview=" 1 ", attachment=True, since=at("1993-01-01"), until=at("1997-06-30"), product="R", tag="").select("conv")


@query(f"WITH {_ROWS} SELECT conv, preview FROM r WHERE operator = 'BUILDING' AND list_contains(tags, '1') AND junk AND brand = 7")
def list_by_owner(spark, d):
    rows, files, chunks = _listed(spark, d)
    return R.listed(rows, "conv", files, chunks, brand=7, operator="BUILDING", tag="1", junk="only", preview="  ").select("conv", "preview")


@query("""WITH l AS (SELECT page_id % 5 AS root, page_id % 60 // 5 AS child, url, row_number() OVER (PARTITION BY page_id % 60 ORDER BY page_id) AS i FROM pages),
p AS (SELECT root, url, row_number() OVER (PARTITION BY root ORDER BY child, i) AS place FROM l WHERE child < 10)
SELECT 'https://m' || root || '.example/sitemap.xml' AS root, place::INT AS place, url AS page FROM p WHERE place <= 300""")
def sitemap_nested(spark, d):
    """Five site maps that name twelve maps each; only ten of them are read."""
    p = read(spark, d, "pages").withColumn("root", F.col("page_id") % 5).withColumn("child", F.floor(F.col("page_id") % 60 / 5))
    name = lambda child: F.concat(F.lit("https://m"), "root", F.lit(".example/sitemap-"), child, F.lit(".xml"))
    loc = lambda c: F.concat(F.lit("<url><loc>"), _xml(c), F.lit("</loc></url>"))
    leaf = _gathered(p.withColumn("url_", name(F.col("child"))), "url_", "page_id", loc(F.col("url"))).select(F.col("url_").alias("url"), F.col("body").alias("xml"))
    index = p.select("root", "child").distinct().withColumn("url_", F.concat(F.lit("https://m"), "root", F.lit(".example/sitemap.xml")))
    index = _gathered(index, "url_", "child", loc(name(F.col("child")))).select(F.col("url_").alias("url"), F.col("body").alias("xml"))
    return S.site_pages(index.unionByName(leaf), index.select("url"))


@query(r"""WITH l AS (SELECT conv_id, turn, array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), chr(10)) AS body FROM conversations),
t AS (SELECT conv_id, turn, 'Turn ' || turn || chr(10) || body AS body FROM l)
SELECT 'https://x.example/' || conv_id || '/' || turn AS guid, substring(regexp_replace(regexp_replace(body, '\n{2,}', chr(10) || chr(10), 'g'), '\s+$', ''), 1, 4000) AS excerpt FROM t""")
def feed_excerpts(spark, d):
    """A topic for each message, with its text as content or, of odd turns, as description."""
    c, turn = read(spark, d, "conversations"), F.col("turn")
    body = F.concat(F.lit("<![CDATA[<p class='a'>Turn  "), turn, F.lit("</p>"), _xml(F.col("text")), F.lit("<b></b>]]>"))
    part = F.when(turn % 2 == 0, F.concat(F.lit("<description>no</description><content:encoded>"), body, F.lit("</content:encoded>"))).otherwise(F.concat(F.lit("<description>"), body, F.lit("</description>")))
    link = F.concat(F.lit("https://x.example/"), "conv_id", F.lit("/"), turn)
    item = F.concat(F.lit("<item><title>T</title><link>"), link, F.lit("</link><guid>"), link, F.lit("#a</guid>"), part, F.lit("</item>"))
    feeds = _gathered(c, "conv_id", "turn", item).select(F.col("body").alias("xml"))
    return S.feed_items(feeds, "xml", T.FORUM_HOST).select(F.substring_index("guid", "#", 1).alias("guid"), "excerpt")


@query(r"""WITH m AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 5 = 0 THEN ' **[WordPress Plugin][' || turn || '] ' || text ELSE text END AS text FROM conversations)
SELECT conv_id AS conv FROM m GROUP BY 1 HAVING bool_or(role = 'user') AND bool_or(role = 'assistant') AND NOT regexp_matches(arg_min(text, turn) FILTER (role = 'user'), '^\s*[*_]*\s*\[WordPress Plugin\]')""")
def chunkable_without_notices(spark, d):
    """Every fifth conversation stands for forwarded commit notices."""
    m = M.messages(read(spark, d, "conversations"))
    notice = F.concat(F.lit(" **[WordPress Plugin]["), "pos", F.lit("] "), "text")
    return M.chunkable(m.withColumn("text", F.when(F.col("conv") % 5 == 0, notice).otherwise(F.col("text"))))


@query("""SELECT o_orderkey AS id FROM orders WHERE o_orderdate IS NOT NULL AND o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW'
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N') ORDER BY o_orderdate, o_orderkey LIMIT 20""")
def announced_verified(spark, d):
    """Topics about to be announced (with an open line), the longest waiting first."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("waiting_since"), (F.col("o_orderstatus") == "F").alias("resolved"), F.when(F.col("o_orderpriority") == "5-LOW", "dismissed").otherwise("reviewed").alias("status"))
    ids = read(spark, d, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("id"))
    due = O.verify_due(F.col("status"), F.col("waiting_since"), F.col("resolved"))
    return O.refreshed_first(o, due, "id", ids).select("id")


@query("""WITH o AS (SELECT page_id, md5(html) AS hash, 'docs' AS kind FROM pages WHERE page_id % 5 <> 0),
n AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN md5(html || 'x') ELSE md5(html) END AS hash, CASE WHEN contains(url, '?') THEN 'forum' ELSE 'docs' END AS kind FROM pages WHERE page_id % 7 <> 0),
j AS (SELECT coalesce(o.page_id, n.page_id) AS page_id, o.hash AS h0, n.hash AS h1, o.kind AS k0, n.kind AS k1, n.page_id IS NULL AS gone, length(coalesce(p.html, '')) % 4 = 0 AS failed FROM o FULL JOIN n ON o.page_id = n.page_id JOIN pages p ON p.page_id = coalesce(o.page_id, n.page_id))
SELECT page_id, CASE WHEN failed AND NOT coalesce(h0 = h1 AND k0 = k1, false) THEN NULL ELSE h1 END AS hash, k1 AS kind, CASE WHEN coalesce(h0 = h1 AND k0 = k1, false) THEN 'keep' WHEN failed THEN 'none' ELSE 'rebuild' END AS chunks FROM j WHERE NOT gone""")
def ingest_states(spark, d):
    """Pages before and after a crawl, with some gone, some of another kind, some failed."""
    p, k = read(spark, d, "pages"), F.col("page_id")
    old = p.where(k % 5 != 0).select(k, F.md5("html").alias("hash"), F.lit("docs").alias("kind"))
    new = p.where(k % 7 != 0).select(k, F.when(k % 3 == 0, F.md5(F.concat("html", F.lit("x")))).otherwise(F.md5("html")).alias("hash"), F.when(F.contains("url", F.lit("?")), "forum").otherwise("docs").alias("kind"))
    failed = p.where(F.length(F.coalesce("html", F.lit(""))) % 4 == 0).select(k)
    return O.ingest_done(old, new, failed, "page_id", "hash", "kind", False)


@query("""WITH b AS (SELECT o_orderkey, o_orderstatus = 'F' AS junk FROM orders), a AS (SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '5-LOW') AS junk FROM orders)
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT a.o_orderkey FROM a JOIN b USING (o_orderkey) WHERE a.junk AND NOT b.junk)""")
def junk_purged(spark, d):
    o = read(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    before = o.select("l_orderkey", (F.col("o_orderstatus") == "F").alias("junk"))
    after = o.select("l_orderkey", F.col("o_orderpriority").isin("1-URGENT", "5-LOW").alias("junk"))
    return I.without_junk(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), before, after, "l_orderkey")
