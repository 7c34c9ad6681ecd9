"""Registered queries of large catalogues, topic lookup, imports and paragraphs, with
their SQL.  Orders stand in for stored threads, customers for what feeds and mails
name, parts for listed products, suppliers for known ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query, read
from .functions.text import FORUM_HOST
from .operators import imports as J
from .operators import lookups as L
from .operators import messages as M
from .operators import products as P


@query(r"""WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+ [a-z]+')) AS word FROM benchmark),
h AS (SELECT doc_id, word, len(regexp_extract_all(text, '(?i)\b' || replace(word, ' ', '\s?') || '\b')) AS hits FROM documents, k
  WHERE contains(lower(text), split_part(word, ' ', 1)) AND contains(lower(text), split_part(word, ' ', 2)))
SELECT doc_id, word, hits::BIGINT AS hits FROM h WHERE hits > 0""")
def catalogue_hits(spark, d):
    """Which of the benchmark's word pairs stand in which document, and how often, the
    space between the words being optional: a catalogue that no plan could hold."""
    pairs = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+ [a-z]+"), F.lit(0))
    words = read(spark, d, "benchmark").select(F.explode(pairs).alias("name")).distinct()
    defs = words.select(F.lit(None).cast("long").alias("plugin"), "name", F.xxhash64("name").alias("ord"), F.lit(False).alias("platform"), F.array("name").alias("words"))
    found = P.hits(read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", defs)
    return found.select("doc_id", F.col("name").alias("word"), F.col("hits").cast("long").alias("hits"))


_TOPIC = f"https://{FORUM_HOST}/support/topic/"


@query(f"""WITH t AS (SELECT o_orderkey AS thread, CASE o_orderkey % 7 WHEN 0 THEN '{_TOPIC}topic-' || o_custkey || '/' WHEN 1 THEN 'http://www.{FORUM_HOST}/support/topic/topic-' || o_custkey WHEN 2 THEN '{_TOPIC}topic-' || o_custkey || '/page/2/'
  WHEN 3 THEN '{_TOPIC}topic-' || o_custkey || '#post-1' WHEN 4 THEN 'item-' || o_custkey WHEN 5 THEN 'https://mirror.example/support/topic/topic-' || (o_custkey + 1) || '/support/topic/topic-' || o_custkey || '/' END AS guid,
  CASE o_orderkey % 3 WHEN 0 THEN '{_TOPIC}Topic-' || o_custkey || '/' WHEN 1 THEN '{_TOPIC}topic-' || o_custkey || '/?view=all' END AS url FROM orders),
r AS (SELECT c_custkey AS ref, '{_TOPIC}topic-' || c_custkey || '/' AS canonical, 'topic-' || c_custkey AS slug, CASE WHEN c_custkey % 2 = 0 THEN 'item-' || c_custkey ELSE '{_TOPIC}topic-' || c_custkey || '#post-1' END AS raw FROM customer)
SELECT ref, thread FROM r JOIN t ON guid = canonical OR url = canonical OR guid = raw OR url = raw OR contains(guid, '/support/topic/' || slug || '/') OR ends_with(guid, '/support/topic/' || slug) OR contains(url, '/support/topic/' || slug || '/') OR ends_with(url, '/support/topic/' || slug)""")
def topic_matches(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    topic = lambda *after: F.concat(F.lit(_TOPIC + "topic-"), c, *map(F.lit, after))
    guid = F.when(k % 7 == 0, topic("/")).when(k % 7 == 1, F.concat(F.lit(f"http://www.{FORUM_HOST}/support/topic/topic-"), c)).when(k % 7 == 2, topic("/page/2/")).when(k % 7 == 3, topic("#post-1"))
    guid = guid.when(k % 7 == 4, F.concat(F.lit("item-"), c)).when(k % 7 == 5, F.concat(F.lit("https://mirror.example/support/topic/topic-"), (F.col("o_custkey") + 1).cast("string"), F.lit("/support/topic/topic-"), c, F.lit("/")))
    url = F.when(k % 3 == 0, F.concat(F.lit(_TOPIC + "Topic-"), c, F.lit("/"))).when(k % 3 == 1, topic("/?view=all"))
    threads = read(spark, d, "orders").select(k.alias("thread"), guid.alias("guid"), url.alias("url"))
    r = F.col("c_custkey").cast("string")
    canonical = F.concat(F.lit(_TOPIC + "topic-"), r, F.lit("/"))
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("item-"), r)).otherwise(F.concat(F.lit(_TOPIC + "topic-"), r, F.lit("#post-1")))
    refs = read(spark, d, "customer").select(F.col("c_custkey").alias("ref"), canonical.alias("canonical"), F.array(raw, canonical).alias("raws"))
    return L.topic_threads(refs, threads, "ref", "thread")


@query("""WITH RECURSIVE l AS (SELECT row_number() OVER (ORDER BY p_partkey) AS i, p_partkey AS id, replace(p_name, ' ', '-') || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '-' || (p_partkey % 97) END AS page,
  CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name ELSE p_name || ' ' || (p_partkey * 7 % 131) END AS name FROM part),
e AS (SELECT list(lower(s_name)) AS names, list('red-widget-' || s_suppkey) AS pages, list('small-ring-' || s_suppkey) AS slugs FROM supplier),
r(i, id, name, page, slug, keywords, names, pages, slugs) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR[], names, pages, slugs FROM e
  UNION ALL SELECT l.i, CASE WHEN new THEN l.id END, CASE WHEN new THEN l.name END, CASE WHEN new THEN l.page END, CASE WHEN new THEN s END, CASE WHEN new THEN CASE WHEN lower(l.page) <> replace(lower(l.name), ' ', '') THEN [l.page] ELSE [] END END,
    CASE WHEN new THEN list_append(r.names, lower(l.name)) ELSE r.names END, CASE WHEN new THEN list_append(r.pages, lower(l.page)) ELSE r.pages END, CASE WHEN new THEN list_append(r.slugs, s) ELSE r.slugs END
  FROM r JOIN l ON l.i = r.i + 1, LATERAL (SELECT NOT list_contains(r.names, lower(l.name)) AND NOT list_contains(r.pages, lower(l.page)) AS new,
    CASE WHEN list_contains(r.slugs, replace(lower(l.name), ' ', '-')) THEN replace(lower(l.name), ' ', '-') || '-' || l.page ELSE replace(lower(l.name), ' ', '-') END AS s) x)
SELECT id, name, page, slug, keywords FROM r WHERE id IS NOT NULL""")
def products_imported(spark, d):
    """What a list of products adds to the known ones, row after row."""
    k, name = F.col("p_partkey"), F.col("p_name")
    page = F.concat(F.replace(name, F.lit(" "), F.lit("-")), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("-"), k % 97)))
    title = F.when(k % 5 == 0, F.upper(name)).when(k % 5 == 1, name).otherwise(F.concat(name, F.lit(" "), k * 7 % 131))
    listed = read(spark, d, "part").select(k.alias("id"), page.alias("page"), title.alias("name"))
    s = F.col("s_suppkey")
    known = read(spark, d, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("red-widget-"), s).alias("page"), F.concat(F.lit("small-ring-"), s).alias("slug"))
    return J.import_products(listed, known, "id")


@query(r"""WITH RECURSIVE p AS (SELECT doc_id, unnest(ps) AS body, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n{2,}') AS ps FROM documents WHERE text IS NOT NULL)),
r(doc_id, i, chunk, held, body) AS (SELECT doc_id, 0::BIGINT, 0::BIGINT, ''::VARCHAR, NULL::VARCHAR FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT r.doc_id, p.i, r.chunk + CASE WHEN length(p.body) > 1800 THEN 2 WHEN length(r.held) + length(p.body) + 2 > 1800 THEN 1 ELSE 0 END,
    CASE WHEN length(p.body) > 1800 THEN '' WHEN length(r.held) + length(p.body) + 2 > 1800 OR r.held = '' THEN p.body ELSE r.held || chr(10) || chr(10) || p.body END, p.body FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1),
whole AS (SELECT doc_id, chunk, 0 AS cut, trim(arg_max(held, i), E' \t\n\r\x0b\x0c') AS body FROM r WHERE body IS NOT NULL AND length(body) <= 1800 GROUP BY doc_id, chunk),
cuts AS (SELECT doc_id, chunk - 1 AS chunk, cut, trim(substr(body, cut * 1800 + 1, 1800), E' \t\n\r\x0b\x0c') AS body FROM (SELECT *, unnest(range(0, (length(body) - 1) // 1800 + 1)) AS cut FROM r WHERE length(body) > 1800)),
every AS (SELECT * FROM whole WHERE body <> '' UNION ALL SELECT * FROM cuts)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk, cut) - 1)::INT AS chunk, length(body)::INT AS n_chars, md5(body) AS body_md5 FROM every""")
def paragraph_chunks(spark, d):
    """Documents in chunks of paragraphs, each line being one."""
    docs = read(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    out = M.split_paragraphs(docs, "doc_id", "text")
    return out.select("doc_id", "chunk", F.length("body").alias("n_chars"), F.md5("body").alias("body_md5"))
