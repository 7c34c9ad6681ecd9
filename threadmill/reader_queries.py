"""Registered queries of the readers: feeds, sitemaps, forum pages, mails, chat records.

The tables hold no such payloads, so each query first writes them as text from the
rows of a table and then reads them back; the SQL states what must come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query, read
from .functions import desk as D
from .functions import text as T
from .operators import forum as W
from .operators import incremental as I
from .sources import documents as R


def _xml(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _gathered(df, by, order, part):
    return df.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p")))), lambda x: x["p"]), "\n").alias("body"))


@query("SELECT c_custkey, '+•• •• •••••' || right(lpad(c_custkey::VARCHAR, 7, '0'), 2) AS phone, CASE c_custkey % 3 WHEN 0 THEN '10.' || c_custkey % 256 || '.•.•' WHEN 1 THEN '2001:' || c_custkey || ':••' ELSE '•••' END AS ip FROM customer")
def masked_contacts(spark, d):
    k = F.col("c_custkey")
    ip = F.when(k % 3 == 0, F.concat(F.lit("10."), k % 256, F.lit(".7.9"))).when(k % 3 == 1, F.concat(F.lit("2001:"), k, F.lit("::1"))).otherwise(F.col("c_name"))
    phone = F.concat(F.lit("+49 30 "), F.lpad(k.cast("string"), 7, "0"))
    return read(spark, d, "customer").select(k, T.mask_phone(phone).alias("phone"), T.mask_ip(ip).alias("ip"))


@query("SELECT page_id % 20 AS map, url FROM pages")
def sitemap_pages(spark, d):
    p = read(spark, d, "pages").withColumn("map", F.col("page_id") % 20)
    xml = _gathered(p, "map", "page_id", F.concat(F.lit("<url><loc>\n "), _xml(F.col("url")), F.lit(" </loc><priority>1</priority></url>")))
    return xml.select("map", F.explode(R.sitemap_urls(F.col("body"))).alias("url"))


@query(r"""WITH t AS (SELECT conv_id, turn, turn % 2 = 1 AS is_reply FROM conversations)
SELECT 'https://wordpress.org/support/topic/c' || conv_id || '/' AS topic, is_reply, CASE WHEN is_reply THEN turn ELSE min(turn) OVER (PARTITION BY conv_id, is_reply) END::INT AS pos, TIMESTAMP '2026-01-05 10:00:00' + INTERVAL 1 MINUTE * turn::INT AS published
FROM t QUALIFY is_reply OR turn = min(turn) OVER (PARTITION BY conv_id, is_reply)""")
def feed_entries(spark, d):
    """A feed for each conversation; later items of a topic's own guid are copies."""
    link = F.concat(F.lit("https://wordpress.org/support/topic/c"), "conv_id", F.lit("/"), F.when(F.col("turn") % 2 == 1, F.concat(F.lit("#post-"), "turn")).otherwise(""))
    date = F.concat(F.lit("Mon, 05 Jan 2026 "), F.date_format(F.expr("timestamp '2026-01-05 10:00:00' + make_dt_interval(0, 0, cast(turn as int), 0)"), "HH:mm:ss"), F.lit(" +0000"))
    item = F.concat(F.lit("<item><title><![CDATA[Q & A]]></title><link>"), link, F.lit("</link><pubDate>"), date, F.lit("</pubDate></item>"))
    feeds = _gathered(read(spark, d, "conversations"), "conv_id", "turn", item).select(F.concat(F.lit("<rss><channel>"), "body", F.lit("</channel></rss>")).alias("xml"))
    return R.feed_items(feeds, "xml", T.FORUM_HOST).select("topic", "is_reply", "pos", "published")


@query("""WITH r AS (SELECT o_custkey AS page, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, o_orderkey % 3 = 0 AS resolved, o_orderkey % 10 = 0 AS sticky, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 5000 END AS replies FROM orders)
SELECT page, place::INT AS place, 'https://wordpress.org/support/topic/t-' || k || '/' AS url, 'Topic & ' || k AS title, replies::INT AS replies, resolved, sticky FROM r""")
def forum_topics(spark, d):
    k = F.col("o_orderkey")
    count = F.when(k % 4 != 0, F.concat(F.lit('<li class="x bbp-topic-reply-count">'), F.format_number(k % 5000, 0), F.lit("</li>"))).otherwise("")
    row = F.concat(F.lit('<ul id="bbp-topic-'), k, F.when(k % 10 == 0, '" class="topic super-sticky">').otherwise('" class="topic">'), F.lit('<a href="https://wordpress.org/support/topic/t-'), k, F.lit('/#post-1">date</a><a class="t" href="http://wordpress.org/support/topic/t-'), k, F.lit('/?a">'), F.when(k % 3 == 0, "[Resolved] ").otherwise(""), F.lit("<b>Topic</b> &amp; "), k, F.lit("</a>"), count, F.lit("</ul>"))
    pages = _gathered(read(spark, d, "orders").withColumnRenamed("o_custkey", "page"), "page", "o_orderkey", row).select("page", F.concat(F.lit("<main>"), "body").alias("html"))
    return W.listing_rows(pages, "page", "html")


_POSTS = r"""p AS (SELECT conv_id, turn, 100 * conv_id + turn AS post, CASE WHEN turn % 5 = 4 THEN 'anonymous' ELSE role || ' ' || turn END AS author, CASE WHEN role = 'assistant' THEN 'Plugin Support' END AS role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS body FROM conversations)"""


def _topic_pages(spark, d):
    c = read(spark, d, "conversations")
    author = F.when(F.col("turn") % 5 == 4, "").otherwise(F.concat(F.lit('<a href="/users/x"><img></a><a href="https://wordpress.org/users/x/">'), "role", F.lit(" "), "turn", F.lit("</a>")))
    role = F.when(F.col("role") == "assistant", '<div class="bbp-author-role">Plugin Support</div>').otherwise("")
    post = F.concat(F.lit('<div id="post-'), 100 * F.col("conv_id") + F.col("turn"), F.lit('" class="reply">'), author, role, F.lit('<div class="bbp-reply-content"><p>'), _xml(F.col("text")), F.lit("</p></div></div>"))
    return _gathered(c, "conv_id", "turn", post).withColumnRenamed("body", "html")


@query(f"WITH {_POSTS} SELECT conv_id, post::BIGINT AS post, author, role, body FROM p")
def forum_posts(spark, d):
    return W.topic_posts(_topic_pages(spark, d), "conv_id", "html").select("conv_id", "post", "author", "role", "body")


@query(f"""WITH {_POSTS}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM p)
SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN '[Resolved] ' ELSE '' END || 'Topic ' || conv_id || chr(10) || chr(10) || string_agg(CASE WHEN i = 1 THEN 'Question from ' || author ELSE 'Reply from ' || author || coalesce(' (' || role || ')', '') END || ':' || chr(10) || body, chr(10) || chr(10) ORDER BY turn) AS transcript FROM n GROUP BY conv_id""")
def forum_transcripts(spark, d):
    posts = W.topic_posts(_topic_pages(spark, d), "conv_id", "html").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("post", "author", "role", "body"))).alias("posts"))
    k = F.col("conv_id")
    return posts.select(k, D.transcript(F.concat(F.lit("Topic "), k), k % 2 == 0, F.col("posts")).alias("transcript"))


@query(f"""WITH {_POSTS}, s AS (SELECT conv_id, count(*) AS n_posts, sum(length(body)) AS n_chars FROM p GROUP BY conv_id)
SELECT conv_id FROM s WHERE n_posts >= 2 AND n_chars >= 80 AND conv_id % 7 <> 0 AND (conv_id % 3 = 0 OR conv_id % 5 > 0) ORDER BY conv_id LIMIT 200""")
def forum_worth(spark, d):
    pages = _topic_pages(spark, d)
    k = F.col("conv_id")
    topics = pages.select(k, k.alias("place"), (k % 7 == 0).alias("sticky"), F.when(k % 3 != 0, k % 5).alias("replies"))
    return W.worth_a_thread(topics, W.topic_posts(pages, "conv_id", "html"), "conv_id").select("conv_id")


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS more FROM orders")
def topic_has_page(spark, d):
    k = F.col("o_orderkey")
    href = F.when(k % 3 == 0, F.concat(F.lit("/support/topic/t."), k, F.lit("/page/2/"))).when(k % 3 == 1, F.concat(F.lit("/support/topic/t."), k, F.lit("/page/3/"))).otherwise(F.concat(F.lit("/support/topic/tx"), k, F.lit("/page/2/")))
    html = F.concat(F.lit('<a href="https://wordpress.org'), href, F.lit('">next</a>'))
    return read(spark, d, "orders").select(k, W.has_page(html, F.concat(F.lit("https://wordpress.org/support/topic/t."), k, F.lit("/?x")), F.lit(2)).alias("more"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'https://wordpress.org/support/topic/a' || c_custkey || '/' WHEN 1 THEN 'https://wordpress.org/support/topic/b' || c_custkey || '/' END AS topic, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS hint FROM customer")
def mail_topics(spark, d):
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("See https://example.com/x and (http://www.wordpress.org/support/topic/a"), k, F.lit("/#post-3)."))).otherwise("nothing")
    html = F.when(k % 3 < 2, F.concat(F.lit('<a href="https://wordpress.org/support/topic/b'), k, F.lit('/page/2/">open</a>')))
    subject = F.when(k % 2 == 0, F.concat(F.lit("Re: [ "), "c_mktsegment", F.lit(" ] new [reply]"))).otherwise("no brackets")
    return read(spark, d, "customer").select(k, W.mail_topic(text, html).alias("topic"), W.subject_hint(subject).alias("hint"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 <> 3 THEN lower(replace(c_name, '#', '-')) END AS slug, c_custkey % 4 < 2 AS resolved FROM customer")
def page_marks(spark, d):
    k = F.col("c_custkey")
    link = F.when(k % 4 != 3, F.concat(F.lit('<a href="/support/plugin/'), F.replace("c_name", F.lit("#"), F.lit("-")), F.lit('/">x</a>'))).otherwise("")
    mark = F.when(k % 4 == 0, '<span class="icon resolved" title="">').when(k % 4 == 1, '<i title="This topic is resolved">').when(k % 4 == 2, '<i title="not resolved" class="not-resolved">').otherwise("resolved?")
    return read(spark, d, "customer").select(k, D.plugin_slug(F.concat(link, mark)).alias("slug"), D.unnamed_posts_resolved(F.concat(link, mark)).alias("resolved"))


@query(r"""WITH h AS (SELECT conv_id, turn, replace(text, chr(10), '</p>' || chr(10) || '<p class=''x''>') || '<br/>' AS html FROM conversations),
t AS (SELECT conv_id, turn, regexp_replace(regexp_replace(html, '(?i)<(?:/(?:p|div|li|h[1-6]|blockquote)|br\s*/?)>', chr(10), 'g'), '<[^>]*>', ' ', 'g') AS text FROM h)
SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS body FROM t""")
def feed_texts(spark, d):
    c = read(spark, d, "conversations")
    html = F.concat(F.lit("<![CDATA["), F.replace("text", F.lit("\n"), F.lit("</p>\n<p class='x'>")), F.lit("<br/>]]>"))
    return c.select("conv_id", "turn", D.feed_text(html).alias("body"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'f' || event_id ELSE 'gen-' || (epoch_us(ts) // 1000) || '-' || left(sha256('["' || (epoch_us(ts) // 1000) || '","text","user","' || event_type || '"]'), 16) END AS key FROM events""")
def message_keys(spark, d):
    k = F.col("event_id")
    e = read(spark, d, "events")
    return e.select(k, R.message_key(F.when(k % 3 == 0, F.concat(F.lit("f"), k)), F.unix_millis(F.col("ts").cast("timestamp")), F.lit("text"), F.lit("user"), F.col("event_type")).alias("key"))


@query("""SELECT event_id::VARCHAR AS session_id, event_type AS state, CASE WHEN event_id % 4 <> 0 THEN date_trunc('millisecond', ts) END AS created_at, CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2026-01-01' ELSE TIMESTAMP '2025-01-01' END AS last_message_at, CASE WHEN event_id % 3 = 0 THEN 'de' END AS language, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 2 END AS n_tags FROM events""")
def chat_records(spark, d):
    k = F.col("event_id")
    part = lambda cond, text: F.when(cond, text).otherwise("")
    json = F.concat(F.lit('{"session_id":"'), k, F.lit('","state":"'), "event_type", F.lit('","created_at":'), F.when(k % 4 == 0, F.lit(0)).otherwise(F.unix_millis(F.col("ts").cast("timestamp"))), F.lit(',"updated_at":1735689600000'), part(k % 2 == 0, ',"active":{"last":1767225600000}'), F.lit(',"meta":{"email":"a@b.c"'), part(k % 5 != 0, ',"segments":["x",null,"y"]'), part(k % 3 == 0, ',"device":{"locales":["DE-de","en"]}'), F.lit("}}"))
    out = R.parse_conversations(read(spark, d, "events").select(json.alias("json")), "json")
    return out.select("session_id", "state", "created_at", "last_message_at", "language", F.size("tags").alias("n_tags"))


@query("""WITH RECURSIVE k AS (SELECT page_id, length(html) >= 300 AS long FROM pages), m AS (SELECT count(*) AS n FROM pages),
r AS (SELECT 0::BIGINT AS page_id, 0 AS depth UNION SELECT c.page_id, depth + 1 FROM r, m, LATERAL (SELECT unnest([2 * r.page_id + 1, 2 * r.page_id + 2]) AS page_id) c WHERE c.page_id < n AND c.page_id % 9 <> 5)
SELECT page_id, depth FROM r JOIN k USING (page_id) WHERE long ORDER BY depth, 'https://a.example/docs/' || page_id LIMIT 300""")
def crawled_pages(spark, d):
    """Pages as a tree in which page i links to 2i + 1 and 2i + 2; some are of another path."""
    k, at = F.col("page_id"), lambda c: F.concat(F.when(c % 9 == 5, "https://a.example/blog/").otherwise("https://a.example/docs/"), c)
    pages = read(spark, d, "pages").select(k, at(k).alias("url"), F.array(at(2 * k + 1), at(2 * k + 2)).alias("links"), "html")
    out = I.crawl(pages, "https://a.example/docs/0", "url", "links", "html", 300, 300)
    return out.select(F.substring_index("u", "/", -1).cast("long").alias("page_id"), "depth")


@query("SELECT p_partkey, lower(replace(p_name, ' ', '-')) || CASE WHEN p_partkey % 2 = 0 THEN '-cafe' ELSE '' END AS slug FROM part")
def slugs(spark, d):
    name = F.concat(F.lit(" "), "p_name", F.when(F.col("p_partkey") % 2 == 0, " – Café!").otherwise("?!"))
    return read(spark, d, "part").select("p_partkey", D.slugify(name).alias("slug"))
