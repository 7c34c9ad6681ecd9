"""Registered queries of the engine and, where SQL can say the same, their SQL.

The tables of the test data stand in for the engine's own (conversations are
messages, orders are support threads, customers are plugins, nations brands, line
items children, documents and pages the corpus).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import incremental as I
from .operators import messages as M
from .operators import relational as R
from .operators import search as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = "TIMESTAMP '1998-08-02 00:00:00'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Coverage and counts


@query("SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, count(*)::INT AS count FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2")
def coverage_monthly(spark, d):
    """Rows per calendar month (UTC) of the order date; undated rows are left out."""
    c = R.coverage(read(spark, d, "orders"), "o_orderdate")
    return c.select("year", "month", F.col("n").cast("int").alias("count"))


@query("""WITH m AS (SELECT year(l_shipdate)::INT AS year, month(l_shipdate)::INT AS month, count(*) AS n FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, 2),
s AS (SELECT greatest(min(year), max(year) - 14) AS a, max(year) AS b, max(n) AS most FROM m),
g AS (SELECT y.y::INT AS year, k.k::INT AS month, most FROM s, unnest(range(a, b + 1)) AS y(y), unnest(range(1, 13)) AS k(k))
SELECT year, month, coalesce(n, 0)::BIGINT AS n, (CASE WHEN coalesce(n, 0) <= 0 THEN 0 WHEN sqrt(n / most) <= 0.25 THEN 1 WHEN sqrt(n / most) <= 0.5 THEN 2 WHEN sqrt(n / most) <= 0.75 THEN 3 ELSE 4 END)::INT AS level
FROM g LEFT JOIN m USING (year, month)""")
def coverage_grid(spark, d):
    return R.coverage_grid(R.coverage(read(spark, d, "lineitem"), "l_shipdate"))


@query("SELECT least((SELECT min(o_orderdate) FROM orders), (SELECT min(l_shipdate) FROM lineitem)) AS earliest")
def min_activity(spark, d):
    a = read(spark, d, "orders").agg(F.min("o_orderdate").alias("a"))
    b = read(spark, d, "lineitem").agg(F.min("l_shipdate").alias("b"))
    return a.crossJoin(b).select(F.least("a", "b").alias("earliest"))


@query("""SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS tag FROM part) WHERE trim(tag) <> '' GROUP BY tag""")
def tag_counts(spark, d):
    return R.explode_counts(read(spark, d, "part"), F.split("p_type", " "))


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM events")
def status_counts(spark, d):
    """Counts by status, and their total with a null status."""
    return read(spark, d, "events").rollup(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT label, count(*) FILTER (embedding IS NOT NULL) AS n_embedded, count(*) AS n FROM embeddings GROUP BY label")
def embedded_counts(spark, d):
    return read(spark, d, "embeddings").groupBy("label").agg(F.count_if(F.col("embedding").isNotNull()).alias("n_embedded"), F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) AS seen, count(*) FILTER (l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31 23:59:59.999') AS basis_in,
count(*) FILTER (NOT l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31 23:59:59.999') AS basis_out,
count(*) FILTER (l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31 23:59:59.999') AS in_by_updated,
count(*) FILTER (o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31 23:59:59.999') AS in_by_created
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def range_classify(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_shipdate").join(read(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return R.range_stats(rows, "l_shipdate", "o_orderdate", F.expr("TIMESTAMP '1996-01-01 00:00:00'"), F.expr("TIMESTAMP '1996-12-31 23:59:59.999'"))


@query("""WITH r AS (SELECT event_id AS run, ts AS started_at, user_id % 7 AS brand, 1 + event_id % 5 AS a, 1 + event_id % 11 AS b, event_id % 3 AS synced, event_id % 13 = 0 AS ceiling FROM events)
SELECT brand, CASE WHEN NOT arg_max(ceiling, (started_at, run)) THEN greatest(coalesce(max(b) FILTER (synced > 0 OR b > a), 1), 1) END AS page FROM r GROUP BY brand""")
def resume_pages(spark, d):
    e = read(spark, d, "events")
    p = F.struct((1 + F.col("event_id") % 5).alias("from"), (1 + F.col("event_id") % 11).alias("to"), (F.col("event_id") % 3).alias("synced"), (F.col("event_id") % 13 == 0).alias("ceiling"))
    runs = e.select(F.col("event_id").alias("run"), F.col("ts").alias("started_at"), F.create_map(F.col("user_id") % 7, p).alias("pages"))
    return R.resume_pages(runs)


# Lists and queues

_THREADS = """threads AS (SELECT o_orderkey AS id, o_custkey AS plugin, CASE o_orderstatus WHEN 'F' THEN 'dismissed' WHEN 'O' THEN 'new' ELSE 'drafted' END AS status,
  o_orderkey % 3 = 0 AS has_reply, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate END AS promised_at, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL 1 DAY END AS waiting_since,
  o_orderkey % 7 = 0 AS resolved, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS last_activity FROM orders),
q AS (SELECT *, status <> 'dismissed' AND (has_reply OR coalesce(promised_at <= TIMESTAMP '1998-08-02', false)) AS flagged FROM threads),
p AS (SELECT *, status = 'new' AND NOT flagged AS backlog, status <> 'dismissed' AND coalesce(waiting_since <= TIMESTAMP '1998-08-02', false) AND NOT resolved AS needs_resolved FROM q)"""


def threads(spark, d):
    key, at = F.col("o_orderkey"), F.col("o_orderdate")
    return read(spark, d, "orders").select(
        key.alias("id"),
        F.col("o_custkey").alias("plugin"),
        F.when(F.col("o_orderstatus") == "F", "dismissed").when(F.col("o_orderstatus") == "O", "new").otherwise("drafted").alias("status"),
        (key % 3 == 0).alias("has_reply"),
        F.when(key % 5 == 0, at).alias("promised_at"),
        F.when(key % 4 == 0, at + F.expr("INTERVAL 1 DAY")).alias("waiting_since"),
        (key % 7 == 0).alias("resolved"),
        F.when(key % 11 != 0, at).alias("last_activity"),
    )


@query(f"WITH {_THREADS} SELECT id, status FROM p WHERE flagged")
def needs_reply_flagged(spark, d):
    return threads(spark, d).where(R.flagged(F.expr(NOW))).select("id", "status")


@query(f"WITH {_THREADS} SELECT id, status FROM p WHERE backlog")
def needs_reply_backlog(spark, d):
    return threads(spark, d).where(R.backlog(F.expr(NOW))).select("id", "status")


@query(f"WITH {_THREADS} SELECT id, flagged FROM p WHERE flagged OR backlog ORDER BY flagged DESC, last_activity DESC NULLS LAST, id DESC LIMIT 50")
def needs_reply(spark, d):
    cut = F.expr(NOW)
    rows = threads(spark, d).where(R.needs_reply(cut)).withColumn("flagged", R.flagged(cut))
    return rows.orderBy(F.desc("flagged"), F.desc_nulls_last("last_activity"), F.desc("id")).limit(50).select("id", "flagged")


@query(f"WITH {_THREADS} SELECT id FROM p WHERE needs_resolved ORDER BY waiting_since, id LIMIT 50")
def needs_resolved(spark, d):
    return threads(spark, d).where(R.needs_resolved(F.expr(NOW))).orderBy(F.asc_nulls_last("waiting_since"), "id").limit(50).select("id")


@query(f"""WITH {_THREADS} SELECT count(*) FILTER (flagged OR backlog) AS needs_reply, count(*) FILTER (flagged) AS flagged, count(*) FILTER (backlog) AS backlog,
count(*) FILTER (needs_resolved) AS needs_resolved, count(*) FILTER (status = 'dismissed') AS dismissed, count(*) FILTER (status = 'drafted') AS drafted, count(*) AS every FROM p""")
def tab_counts(spark, d):
    return R.tab_counts(threads(spark, d), F.expr(NOW))


@query(f"WITH {_THREADS} SELECT id, floor((epoch_ms(TIMESTAMP '1998-08-02') - epoch_ms(waiting_since)) / 86400000)::BIGINT AS days FROM p WHERE waiting_since IS NOT NULL")
def waiting_days(spark, d):
    return threads(spark, d).where("waiting_since is not null").select("id", R.whole_days(F.col("waiting_since"), F.expr(NOW)).cast("long").alias("days"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 20 OFFSET 20")
def list_page_2(spark, d):
    return R.page(read(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")], 2, 20).select("o_orderkey")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND contains(lower(o_orderpriority), 'urg') AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N')""")
def list_filtered(spark, d):
    p = R.all_of([F.col("o_orderstatus") == "O", R.contains_ci(F.col("o_orderpriority"), "URG"), None, F.col("o_orderdate").between(F.expr("TIMESTAMP '1996-01-01 00:00:00'"), F.expr("TIMESTAMP '1997-12-31 00:00:00'"))])
    files = read(spark, d, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, d, "orders").where(p).join(files, "o_orderkey", "left_semi").select("o_orderkey")


# Joins


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 5) OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def brand_membership_or(spark, d):
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    part = read(spark, d, "part").where("p_size < 5").select(F.col("p_partkey").alias("l_partkey"))
    supplier = read(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return R.either_parent(lines, part, supplier, "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, count(o_orderkey) AS n_children FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def child_counts(spark, d):
    return R.child_counts(read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders"), "c_custkey", "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)")
def semi_attachment(spark, d):
    big = read(spark, d, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, d, "orders").join(big, "o_orderkey", "left_semi").select("o_orderkey")


@query("SELECT page_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def anti_removed_pages(spark, d):
    p = read(spark, d, "pages").select("page_id", "url")
    return p.join(p.where("page_id % 3 = 0").select("url"), "url", "left_anti").select("page_id")


@query("SELECT doc_id, CASE WHEN source = 'src0' THEN NULL ELSE source END AS source FROM documents")
def delete_set_null(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source")
    return R.set_null_on_delete(docs, docs.where("source = 'src0'"), "source")


@query("SELECT doc_id FROM documents WHERE source <> 'src0' OR source IS NULL")
def delete_cascade(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source")
    return R.cascade_on_delete(docs, docs.where("source = 'src0'"), "source").select("doc_id")


# Windows and sequences


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) AS rn FROM events) WHERE rn = 1")
def latest_reply_per_topic(spark, d):
    return R.newest_per_key(read(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id")


_LINES = r"""msgs AS (SELECT conv_id AS conv, turn AS pos, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'operator' ELSE 'note' END AS sender, regexp_replace(text, '^\s+|\s+$', '', 'g') AS line FROM conversations),
l AS (SELECT * FROM msgs WHERE sender <> 'note' AND line <> ''),
b AS (SELECT *, CASE WHEN sender = 'user' AND lag(sender) OVER (PARTITION BY conv ORDER BY pos) = 'operator' THEN 1 ELSE 0 END AS o FROM l),
x AS (SELECT *, sum(o) OVER (PARTITION BY conv ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS exchange FROM b),
e AS (SELECT conv, exchange, count(*) FILTER (sender = 'user') AS n_user, count(*) FILTER (sender = 'operator') AS n_operator, min(pos) AS first_pos, max(pos) AS last_pos,
  string_agg(CASE sender WHEN 'user' THEN 'Customer: ' ELSE 'Support: ' END || line, chr(10) ORDER BY pos) AS body FROM x GROUP BY conv, exchange)"""


@query(f"WITH {_LINES} SELECT * FROM e")
def exchange_groups(spark, d):
    return M.exchanges(M.messages(read(spark, d, "conversations")))


@query(f"""WITH RECURSIVE {_LINES},
i AS (SELECT conv, exchange, row_number() OVER (PARTITION BY conv, exchange ORDER BY k, c) AS i, substring(line, c * 2400 + 1, 2400) AS item, CASE WHEN length(line) > 2400 THEN 2400 ELSE length(line) END AS n
  FROM (SELECT conv, exchange, k, line, unnest(range(0, greatest((length(line) - 1) // 2400, 0) + 1)) AS c FROM (SELECT conv, exchange, unnest(string_split(body, chr(10))) AS line, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS k FROM e WHERE length(body) > 2400))),
s AS (SELECT conv, exchange, i, item, 0 AS piece, CASE WHEN n = 0 THEN 0 ELSE n + 1 END AS size FROM i WHERE i = 1
  UNION ALL SELECT i.conv, i.exchange, i.i, i.item, CASE WHEN size > 0 AND size + n > 2400 THEN piece + 1 ELSE piece END, CASE WHEN size > 0 AND size + n > 2400 THEN n + 1 WHEN size = 0 AND n = 0 THEN 0 ELSE size + n + 1 END
  FROM s JOIN i ON s.conv = i.conv AND s.exchange = i.exchange AND i.i = s.i + 1),
pc AS (SELECT conv, exchange, 0 AS piece, body FROM e WHERE length(body) <= 2400 UNION ALL
  SELECT * FROM (SELECT conv, exchange, piece, regexp_replace(string_agg(item, chr(10) ORDER BY i), '^\n+', '') AS body FROM s GROUP BY conv, exchange, piece) WHERE body <> ''),
r AS (SELECT conv, body, length(body) AS n, row_number() OVER (PARTITION BY conv ORDER BY exchange, piece) AS i FROM pc),
f AS (SELECT conv, body, i, 0 AS chunk, n + 2 AS size FROM r WHERE i = 1
  UNION ALL SELECT r.conv, r.body, r.i, CASE WHEN f.size > 0 AND f.size + r.n > 1600 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.size > 0 AND f.size + r.n > 1600 THEN 0 ELSE f.size END + r.n + 2
  FROM f JOIN r ON r.conv = f.conv AND r.i = f.i + 1)
SELECT conv, chunk::BIGINT AS chunk, count(*) AS n_exchanges, string_agg(body, chr(10) || chr(10) ORDER BY i) AS body, length(string_agg(body, chr(10) || chr(10) ORDER BY i))::INT AS n_chars FROM f GROUP BY conv, chunk""")
def chunk_pack(spark, d):
    return M.chunks(M.messages(read(spark, d, "conversations")))


@query(r"""SELECT conv_id AS conv FROM conversations GROUP BY 1 HAVING bool_or(role = 'user') AND bool_or(role = 'assistant') AND NOT regexp_matches(arg_min(text, turn) FILTER (role = 'user'), '(?i)^\s*(hi|hello|test)?\s*$')""")
def chunkable_conversations(spark, d):
    return M.chunkable(M.messages(read(spark, d, "conversations")), r"(?i)\A\s*(hi|hello|test)?\s*\z")


@query(rf"WITH {_LINES} SELECT conv, substring(arg_min(line, pos), 1, 120) AS topic FROM msgs WHERE sender = 'user' AND line <> '' AND NOT starts_with(line, '[attachment') GROUP BY conv")
def first_customer_line(spark, d):
    return M.first_customer_line(M.messages(read(spark, d, "conversations")))


# Text


@query(r"SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g') AS text FROM documents")
def redact_email(spark, d):
    return read(spark, d, "documents").select("doc_id", F.regexp_replace("text", T.EMAIL, "[EMAIL]").alias("text"))


@query()
def redact_all(spark, d):
    return read(spark, d, "documents").select("doc_id", T.redacted(F.col("text")).alias("text"))


@query(r"""WITH m AS (SELECT c_custkey, lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.example.com' AS e FROM customer)
SELECT c_custkey, left(split_part(e, '@', 1), 2) || '***@' || left(split_part(e, '@', 2), 2) || '***.com' AS masked FROM m""")
def mask_email(spark, d):
    e = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example.com"))
    return read(spark, d, "customer").select("c_custkey", T.mask_email(e).alias("masked"))


_JUNK = r"""c AS (SELECT conv_id, arg_max(text, turn) AS preview, count(*) FILTER (role = 'assistant') AS ops,
  CASE conv_id % 4 WHEN 0 THEN 'noreply@x.com' WHEN 1 THEN 'bob.no-reply@x.com' WHEN 2 THEN 'alexnoreply@gmail.com' END AS email FROM conversations GROUP BY conv_id),
j AS (SELECT conv_id, CASE WHEN regexp_matches(coalesce(email, ''), '(?i)(^|[._-])(no-?reply|donotreply|mailer-daemon|notifications?)@') THEN 'automated sender'
  WHEN regexp_matches(CASE WHEN conv_id % 5 = 0 THEN '[Ticket 1] ' ELSE '' END || preview, '^\s*\[[^\]]{2,40}\]') AND ops = 0 THEN 'bracketed notification subject, never answered' END AS reason FROM c)"""


def _junk(spark, d):
    email = F.when(F.col("conv_id") % 4 == 0, "noreply@x.com").when(F.col("conv_id") % 4 == 1, "bob.no-reply@x.com").when(F.col("conv_id") % 4 == 2, "alexnoreply@gmail.com")
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("preview"), F.count_if(F.col("role") == "assistant").alias("ops"))
    preview = F.concat(F.when(F.col("conv_id") % 5 == 0, "[Ticket 1] ").otherwise(""), "preview")
    return c.select("conv_id", T.classify_junk(email, preview, F.col("ops")).alias("j")).select("conv_id", "j.junk", "j.reason")


@query(f"WITH {_JUNK} SELECT conv_id, reason IS NOT NULL AS junk, reason FROM j")
def junk_classify(spark, d):
    return _junk(spark, d)


@query(f"WITH {_JUNK} SELECT reason, count(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY reason")
def junk_by_reason(spark, d):
    return _junk(spark, d).where("junk").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT doc_id, coalesce(len(regexp_extract_all(text, '(?i)\bthe\s?and\b')) + len(regexp_extract_all(text, '(?i)\bmoron\b')), 0) AS hits FROM documents")
def product_hits(spark, d):
    return read(spark, d, "documents").select("doc_id", T.keyword_hits(F.col("text"), ["the and", "moron"]).cast("long").alias("hits"))


def _decoded(source: str, columns: str, text: str) -> str:
    """SQL tables d0 to d2: text of source with named, decimal and hexadecimal entities decoded."""
    named = text
    for name, by in T.NAMED_ENTITIES:
        named = f"regexp_replace({named}, '(?i){name}', '{by.replace(chr(39), chr(39) * 2)}', 'g')"
    sql, last = f"d0 AS (SELECT {columns}, {named} AS t FROM {source})", "d0"
    for k, (mark, digits, prefix) in enumerate((("&#", "[0-9]", ""), ("&#[xX]", "[0-9a-fA-F]", "0x")), 1):
        figures = f"regexp_extract(x, '^{mark}0*({digits}*);', 1)"
        number = f"(CASE WHEN length({figures}) BETWEEN 1 AND 7 THEN '{prefix}' || {figures} ELSE '{prefix}0' END)::BIGINT"
        each = f"CASE WHEN regexp_matches(x, '^{mark}{digits}+;') THEN CASE WHEN {number} BETWEEN 1 AND 55295 OR {number} BETWEEN 57344 AND 1114111 THEN chr({number}::INT) ELSE '' END || regexp_replace(x, '^{mark}{digits}+;', '') ELSE x END"
        parts = "list_transform(string_split(t, '&#'), lambda y, i: CASE WHEN i > 1 THEN '&#' || y ELSE y END)"
        sql += f", d{k} AS (SELECT {columns}, array_to_string(list_transform({parts}, lambda x: {each}), '') AS t FROM {last})"
        last = f"d{k}"
    return sql


_SQUEEZED = r"trim(regexp_replace(x, '[\s\x{00A0}]+', ' ', 'g'))"


@query("WITH " + _decoded("(SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS raw FROM pages)", "page_id", "raw") + f" SELECT page_id, nullif(left({_SQUEEZED.replace('(x,', '(t,')}, 300), '') AS title FROM d2")
def html_title(spark, d):
    return read(spark, d, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


@query("""SELECT page_id, len(list_distinct(regexp_extract_all(html, '(?i)<a[^>]+href=["'']([^"'']+)["'']', 1)))::INT AS n_links FROM pages""")
def html_links(spark, d):
    return read(spark, d, "pages").select("page_id", F.size(T.html_links(F.col("html"))).alias("n_links"))


def _text_sql() -> str:
    body = "CASE WHEN length(part) > 500 THEN part ELSE html END"
    for tag in T.DROPPED_BLOCKS:
        body = rf"regexp_replace({body}, '(?is)<{tag}[\s>].*?</{tag}>', ' ', 'g')"
    body = rf"regexp_replace({body}, '(?i)</({'|'.join(T.LINE_BLOCKS)})>|<[bh]r\s*/?>', chr(10), 'g')"
    body = rf"regexp_replace(regexp_replace({body}, '(?i)<li(\s[^>]*)?>', chr(10) || '- ', 'g'), '<[^>]+>', ' ', 'g')"
    part = r"coalesce(nullif(regexp_extract(html, '(?is)<main[\s>].*?</main>'), ''), regexp_extract(html, '(?is)<article[\s>].*?</article>'))"
    return f"""WITH p AS (SELECT page_id, html, {part} AS part FROM pages), {_decoded('p', 'page_id', body)},
l AS (SELECT page_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: {_SQUEEZED}), chr(10)) AS t FROM d2)
SELECT page_id, regexp_replace(regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') AS text FROM l"""


@query(_text_sql())
def html_text(spark, d):
    return read(spark, d, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query("""WITH p AS (SELECT page_id, url, list_filter(string_split(string_split(string_split(url, '?')[1], '#')[1], '/')[4:], lambda x: x <> '') AS parts FROM pages)
SELECT page_id, CASE WHEN len(parts) > 0 THEN 'https://wordpress.org/support/topic/' || parts[-1] || '/' END AS topic FROM p""")
def topic_canonical(spark, d):
    """The last step of every page's path as a topic, in three spellings of its address."""
    slug = F.regexp_extract(F.regexp_replace("url", r"[?#].*\z", ""), r"://[^/]+/(?:.*/)?([^/]+)/*\z", 1)
    before = F.element_at(F.array(*map(F.lit, ("http://www.wordpress.org", "HTTPS://wordpress.org:443", " https://de.wordpress.org"))), (F.col("page_id") % 3 + 1).cast("int"))
    after = F.element_at(F.array(*map(F.lit, ("/page/2/?view=all#post-9", "", "/?x"))), (F.col("page_id") % 3 + 1).cast("int"))
    return read(spark, d, "pages").select("page_id", T.canonical_topic(F.concat(before, F.lit("/support/topic/"), slug, after)).alias("topic"))


@query("""WITH p AS (SELECT page_id, string_split(string_split(url, '?')[1], '#')[1] AS base FROM pages), k AS (SELECT page_id, lower(coalesce(list_filter(string_split(base, '/')[4:], lambda x: x <> '')[-1], '')) AS last FROM p)
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'sitemap' WHEN 1 THEN 'forum' ELSE CASE WHEN last LIKE '%.xml' OR contains(last, 'sitemap') THEN 'sitemap' ELSE 'url' END END AS kind FROM k""")
def source_type(spark, d):
    """Every page's address, as it is, with a sitemap below it, or with its path below a forum."""
    base = F.regexp_replace("url", r"[?#].*\z", "")
    u = F.when(F.col("page_id") % 3 == 0, F.concat(base, F.lit("/Sitemap-1.XML?x=1"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://de.wordpress.org/support/plugin"), F.regexp_extract(base, "://[^/]+(.*)", 1))).otherwise(F.col("url"))
    return read(spark, d, "pages").select("page_id", T.source_type(u).alias("kind"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 2 THEN 60 * (1 + event_id % 50) ELSE 3600 * (event_id % 9) + 86400 * (1 + event_id % 3) END AS secs FROM events")
def relative_time(spark, d):
    k = F.col("event_id")
    two = F.concat(F.lit("posted "), 1 + k % 3, F.lit(" days, "), k % 9, F.lit(" Hours ago by x"))
    text = F.when(k % 4 == 3, F.concat("event_type", F.lit(" 5 days before"))).when(k % 4 == 2, F.concat(F.lit("3 hours, then "), 1 + k % 50, F.lit(" minute ago"))).otherwise(two)
    return read(spark, d, "events").select("event_id", T.relative_seconds(text).alias("secs"))


@query("""SELECT c_custkey, list_sum(list_transform(string_split(reverse(c_custkey::VARCHAR), ''), lambda x, i: CASE WHEN i % 2 = 1 THEN x::INT WHEN 2 * x::INT > 9 THEN 2 * x::INT - 9 ELSE 2 * x::INT END)) % 10 = 0 AS luhn_digit FROM customer""")
def luhn_cards(spark, d):
    return read(spark, d, "customer").select("c_custkey", F.expr("luhn_check(cast(c_custkey as string))").alias("luhn_digit"))


# Search


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)::DOUBLE[]) AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 10""")
def cosine_topk(spark, d):
    v = read(spark, d, "embeddings")
    q = v.where("vec_id = 0").select("embedding").first()["embedding"]
    return S.vector_search(v, "vec_id", "embedding", q, 10)


@query(r"SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), 'the') AND list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), 'clown')")
def fts_and_match(spark, d):
    return S.match_all(read(spark, d, "documents"), "text", ["the", "clown"]).select("doc_id")


@query(r"SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), 'idiot') OR list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), 'clown')")
def fts_or_fallback(spark, d):
    return S.match_any(read(spark, d, "documents"), "text", ["idiot", "clown", "x"]).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'worthl') ORDER BY doc_id LIMIT 20")
def ilike_fallback(spark, d):
    return S.keyword_search(read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", "worthl", 20).select("doc_id")


@query("""SELECT doc_id, tier::INT AS tier FROM (SELECT doc_id, 0 AS tier FROM (SELECT doc_id FROM documents WHERE source = 'src1' ORDER BY doc_id LIMIT 2)
UNION ALL SELECT doc_id, 1 FROM documents WHERE lang = 'de' AND doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src1' ORDER BY doc_id LIMIT 2)) ORDER BY tier, doc_id LIMIT 6""")
def context_widening(spark, d):
    docs = read(spark, d, "documents")
    scoped = docs.where("source = 'src1'").orderBy("doc_id").limit(2).select("doc_id")
    return S.widened(scoped, docs.where("lang = 'de'").select("doc_id"), "doc_id", F.col("doc_id"))


# Incremental


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.text = b.text THEN 'same' ELSE 'changed' END AS state
FROM (SELECT doc_id, text FROM documents WHERE doc_id % 5 <> 0) a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0) b ON a.doc_id = b.doc_id""")
def hash_diff(spark, d):
    """The table against a later crawl of it (both derived from the ids)."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    later = docs.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return I.hash_diff(docs.where("doc_id % 5 <> 0"), later, "doc_id", "text")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey % 2 DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def upsert_latest(spark, d):
    """Orders with odd keys arrive later and are merged in by customer."""
    o = R.first_per_key(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate").withColumn("odd", F.col("o_orderkey") % 2), ["o_custkey", "o_orderdate", "odd"], "o_orderkey")
    return I.upsert(o.where("odd = 0").drop("odd"), o.where("odd = 1").drop("odd"), ["o_custkey"], "o_orderdate")


@query("""SELECT d.doc_id, e.embedding IS NOT NULL AS reused FROM documents d LEFT JOIN (SELECT text, max(embedding) AS embedding FROM documents p JOIN embeddings ON vec_id = p.doc_id GROUP BY text) e ON d.text = e.text""")
def embedding_reuse(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    prior = docs.join(read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    return I.reuse_embeddings(docs, prior.select("doc_id", "text", "embedding"), "text", "embedding", "doc_id").select("doc_id", F.col("embedding").isNotNull().alias("reused"))


@query("SELECT e.event_id FROM events e WHERE ts >= (SELECT max(ts) FROM events WHERE event_id % 1000 = 0) - INTERVAL 1 HOUR")
def incremental_rows(spark, d):
    e = read(spark, d, "events")
    runs = e.where("event_id % 1000 = 0").select(F.lit("completed").alias("status"), F.col("ts").alias("started_at"))
    return I.since_checkpoint(e, runs, "ts").select("event_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) AND doc_id % 10 <> 0")
def unembedded_chunks(spark, d):
    docs = read(spark, d, "documents").select("doc_id").join(read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    return I.unembedded(docs, ["embedding"], docs.where("doc_id % 10 = 0"), "doc_id").select("doc_id")


@query("""WITH RECURSIVE e AS (SELECT user_id AS thread, ts AS day, CASE event_id % 5 WHEN 0 THEN 'customer' WHEN 1 THEN 'support' WHEN 2 THEN 'drafted' WHEN 3 THEN 'status' ELSE 'topic' END AS kind, event_id % 3 = 0 AS promise, event_id % 4 <> 1 AS exact,
  CASE WHEN event_id % 6 < 2 THEN event_id % 6 = 0 END AS page, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT DISTINCT thread, 0::BIGINT AS i, false AS tracked, NULL::BOOLEAN AS has_reply, NULL::TIMESTAMP AS promised_at, NULL::TIMESTAMP AS waiting_since, NULL::TIMESTAMP AS last_activity, NULL::TIMESTAMP AS last_reply, false AS resolved FROM e
UNION ALL SELECT thread, i, tracked OR begins,
  CASE WHEN same OR kind = 'drafted' THEN has_reply ELSE kind = 'customer' END,
  CASE WHEN same THEN promised_at WHEN kind = 'support' AND promise THEN day END,
  CASE WHEN same THEN waiting_since WHEN kind = 'support' AND NOT promise THEN day END,
  CASE WHEN same THEN last_activity WHEN kind = 'customer' OR NOT tracked THEN day ELSE last_activity END,
  CASE WHEN NOT same AND kind IN ('customer', 'support') AND exact THEN day ELSE last_reply END,
  CASE WHEN same OR kind = 'topic' THEN resolved ELSE coalesce(page, resolved) END
FROM (SELECT *, CASE WHEN NOT tracked THEN NOT begins WHEN kind = 'topic' THEN true ELSE kind IN ('customer', 'support') AND exact AND coalesce(day <= last_reply, false) END AS same
  FROM (SELECT e.*, s.* EXCLUDE (thread, i), kind IN ('customer', 'topic') OR (kind = 'support' AND NOT exact) AS begins FROM s JOIN e ON e.thread = s.thread AND e.i = s.i + 1)))
SELECT thread, has_reply, promised_at, waiting_since, last_activity, last_reply, resolved FROM s WHERE tracked AND i = (SELECT max(i) FROM e WHERE e.thread = s.thread)""")
def thread_states(spark, d):
    """Event logs folded into thread states (users are threads)."""
    from .streaming.threads import fold

    k = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("customer", "support", "drafted", "status", "topic"))), (k % 5 + 1).cast("int"))
    e = read(spark, d, "events").select(F.col("user_id").alias("thread"), F.col("ts").alias("at"), k.alias("pos"), kind.alias("kind"), (k % 3 == 0).alias("promise"), (k % 4 != 1).alias("exact"), F.when(k % 6 < 2, k % 6 == 0).alias("resolved"))
    return fold(e)
