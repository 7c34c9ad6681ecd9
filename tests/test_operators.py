"""Operators on small tables, and every registered query against its SQL."""

import datetime as dt
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from threadmill import catalog, desk_queries, reader_queries  # noqa: F401
from threadmill.operators import incremental as I
from threadmill.operators import messages as M
from threadmill.operators import relational as R
from threadmill.operators import search as S

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(pdf):
    def plain(v):
        if pd.isna(v):
            return None
        if isinstance(v, float):
            return round(v, 6)
        return v.item() if hasattr(v, "item") else v

    out = pdf[sorted(pdf.columns)].astype(object)
    return sorted((tuple(plain(v) for v in r) for r in out.itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_exchanges_operator_first(spark):
    msgs = spark.createDataFrame([(1, 0, "operator", "hi"), (1, 1, "user", "q1"), (1, 2, "note", "n"), (1, 3, "operator", "a1"), (1, 4, "operator", "a2"), (1, 5, "user", " "), (1, 6, "user", "q2")], "conv int, pos int, sender string, text string")
    got = {(r["exchange"], r["n_user"], r["n_operator"]) for r in M.exchanges(msgs).collect()}
    assert got == {(0, 0, 1), (1, 1, 2), (2, 1, 0)}


def greedy(lengths, limit=1600, gap=2):
    out, chunk, size = [], 0, 0
    for n in lengths:
        if size > 0 and size + n > limit:
            chunk, size = chunk + 1, 0
        out.append(chunk)
        size += n + gap
    return out


def test_pack_is_greedy(spark):
    import random

    r = random.Random(1)
    data = [(g, i, r.choice([0, 5, 700, 1599, 1601, 3000])) for g in range(5) for i in range(40)]
    df = spark.createDataFrame(data, "g int, o int, n int")
    got = {(x["g"], x["o"]): x["chunk"] for x in M.pack(df, "g", "o", F.col("n")).collect()}
    for g in range(5):
        assert [got[g, i] for i in range(40)] == greedy([n for a, _, n in data if a == g])


def test_split_paragraphs(spark):
    df = spark.createDataFrame([(1, "a" * 1000 + "\n\n" + "b" * 700 + "\n\n\n" + "c" * 4000), (2, ""), (3, None)], "k int, t string")
    got = [(r["k"], len(r["body"])) for r in M.split_paragraphs(df, "k", "t").orderBy("k", "chunk").collect()]
    assert got == [(1, 1702), (1, 1800), (1, 1800), (1, 400)]


def test_header_leaves_out_what_is_missing(spark):
    h = M.chunk_header(F.lit("s1"), F.lit("2024-01-01"), F.lit(None).cast("string"), F.lit(""), F.lit("en"))
    assert spark.range(1).select(h.alias("h")).first()["h"] == "[Session: s1 | Date: 2024-01-01 | Language: en]"


@pytest.mark.parametrize("n,level", [(0, 0), (6, 1), (7, 2), (25, 2), (56, 3), (57, 4), (100, 4)])
def test_intensity(spark, n, level):
    assert spark.range(1).select(R.intensity(F.lit(n), F.lit(100)).alias("x")).first()["x"] == level


def test_tabs_are_disjoint_and_complete(spark):
    t = catalog.threads(spark, DATA)
    cut = F.expr(catalog.NOW)
    f, b, n = R.flagged(cut), R.backlog(cut), R.needs_reply(cut)
    assert t.where(f & b).isEmpty()
    assert t.where(f).count() + t.where(b).count() == t.where(n).count()


def test_upsert_prefers_new_on_ties(spark):
    old = spark.createDataFrame([(1, 5, "old"), (2, 9, "old")], "k int, v int, x string")
    new = spark.createDataFrame([(1, 5, "new"), (2, 3, "new"), (3, None, "new")], "k int, v int, x string")
    assert sorted((r["k"], r["x"]) for r in I.upsert(old, new, ["k"], "v").collect()) == [(1, "new"), (2, "old"), (3, "new")]


def test_merge_truthy_keeps_old_values(spark):
    old = spark.createDataFrame([(1, "a", "m"), (2, "b", "n")], "k int, name string, mail string")
    new = spark.createDataFrame([(1, "", "z"), (3, "c", None)], "k int, name string, mail string")
    assert sorted(tuple(r) for r in I.merge_truthy(old, new, "k", ["name", "mail"]).collect()) == [(1, "a", "z"), (2, "b", "n"), (3, "c", None)]


def test_map_merge_null_wins(spark):
    got = spark.sql("select map('a', 1, 'b', 2) as l, map('b', cast(null as int), 'c', 3) as r").select(I.map_merge(F.col("l"), F.col("r")).alias("m")).first()["m"]
    assert got == {"a": 1, "b": None, "c": 3}


def test_incremental_without_a_completed_run_takes_all(spark):
    e = spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "ts timestamp")
    runs = spark.createDataFrame([("failed", dt.datetime(2025, 1, 1))], "status string, started_at timestamp")
    assert I.since_checkpoint(e, runs, "ts").count() == 1


def test_crawl(spark):
    at, words = "https://a.example/docs/", "word " * 40
    pages = [("", ["b", "c"], words), ("b", ["d", ""], "short"), ("c", [], words), ("d", ["missing", "../blog"], words), ("z", [""], words)]
    rows = [(at + u, [at + x for x in to], t) for u, to, t in pages] + [("https://a.example/blog", [at], words), ("https://b.example/docs/", [at], words)]
    df = spark.createDataFrame(rows, "url string, links array<string>, text string")
    got = [(r["u"], r["depth"]) for r in I.crawl(df, at, "url", "links", "text").collect()]
    assert got == [(at, 0), (at + "c", 1), (at + "d", 2)]
    assert [r["u"] for r in I.crawl(df, at, "url", "links", "text", most=1).collect()] == [at]
    assert I.crawl(df, "https://nowhere.example/", "url", "links", "text").count() == 0


def test_reuse_takes_the_highest_version(spark):
    prior = spark.createDataFrame([("a", [1.0], 1), ("a", [2.0], 3), ("a", [3.0], 2), ("b", None, 9)], "t string, v array<double>, n int").repartition(3)
    docs = spark.createDataFrame([("a",), ("b",), (None,)], "t string")
    assert {r["t"]: r["v"] for r in I.reuse_embeddings(docs, prior, "t", "v", "n").collect()} == {"a": [2.0], "b": None, None: None}


def test_long_texts_are_split_between_lines(spark):
    body = "\n".join(["a" * 1000, "b" * 1500, "", "c" * 5000, "", "d"])
    df = spark.createDataFrame([(1, body), (2, "short"), (3, "")], "k int, t string")
    got = {(r["k"], r["piece"]): r["t"] for r in M.split_long(df, ["k"], "t").collect()}
    assert got == {(1, 0): "a" * 1000, (1, 1): "b" * 1500 + "\n", (1, 2): "c" * 2400, (1, 3): "c" * 2400, (1, 4): "c" * 200, (1, 5): "d", (2, 0): "short", (3, 0): ""}


def test_hybrid_search(spark):
    docs = spark.createDataFrame([(i, "apple" if i % 2 else "pear", 100 - i) for i in range(20)], "id int, t string, day int")
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "id int, v array<double>")
    ids = lambda q, limit, most: [r["id"] for r in S.hybrid_search(docs, vectors, "id", "t", "v", "day", q, [0.0, 1.0], limit, candidates=most).collect()]
    assert ids("apple", 3, 1000) == [19, 17, 15]
    assert ids("apple", 3, 5) == [9, 7, 5]
    assert ids("plum", 3, 1000) == [19, 18, 17]


def test_substring_hits_come_newest_first(spark):
    docs = spark.createDataFrame([(1, "crabapples", 3), (2, "x crabapple", 9), (3, "scrabappl", None)], "id int, t string, day int")
    assert [r["id"] for r in S.keyword_search(docs, "id", "t", "crabappl", 5, "day").collect()] == [2, 1, 3]


def test_keyword_tiers(spark):
    docs = spark.createDataFrame([(1, "red apple"), (2, "green apple pie"), (3, "crabapples")], "id int, t string")
    ids = lambda q: [r["id"] for r in S.keyword_search(docs, "id", "t", q, 5).collect()]
    assert ids("apple pie") == [2]
    assert sorted(ids("red pie")) == [1, 2]
    assert ids("bappl") == [3]


def test_widening(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    b = spark.createDataFrame([(2,), (7,)], "id int")
    assert [r["id"] for r in S.widened(a, b, "id", F.col("id")).collect()] == [1, 2, 3]
    assert [r["id"] for r in S.widened(a.limit(2), b, "id", F.col("id")).collect()] == [1, 2, 7]


def test_sources(spark):
    from threadmill.sources import documents as D

    xml = "<rss><item><title>T</title><link>https://wordpress.org/support/topic/x/</link><pubDate>Mon, 05 Feb 2024 10:00:00 +0000</pubDate></item><item><title></title><link>https://wordpress.org/support/topic/x/#post-2</link><guid>g2</guid></item><item><title>again</title><link>y</link><guid>g2</guid></item></rss>"
    got = [(r["guid"], r["is_reply"], r["title"], r["published"]) for r in D.feed_items(spark.createDataFrame([(xml,)], "x string"), "x", "wordpress.org").orderBy("pos").collect()]
    assert got == [("https://wordpress.org/support/topic/x/", False, "T", dt.datetime(2024, 2, 5, 10)), ("g2", True, None, None), ("g2", False, "again", None)]
    mail = "Subject: x\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary=B\n\n--B\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\nh=C3=A9\n--B\nContent-Type: text/html; charset=utf-8\n\n<p>x</p>\n--B--\n"
    assert spark.createDataFrame([(mail,)], "m string").select(D.mail_body(F.col("m")).alias("b")).first()["b"] == "hé\n<p>x</p>"
    raw = '{"session_id":"s","created_at":0,"updated_at":1700000000000,"meta":{"email":"a@b.c","segments":["x",null],"device":{"locales":["EN-us"]}}}'
    r = D.parse_conversations(spark.createDataFrame([(raw,), ("broken",)], "j string"), "j").collect()
    assert (r[0]["session_id"], r[0]["created_at"], r[0]["tags"], r[0]["language"]) == ("s", None, ["x"], "en")
    assert r[1]["session_id"] is None and r[1]["raw"] == "broken"


def test_every_customer_has_a_card_check(spark):
    ids = [x["c_custkey"] for x in spark.read.parquet(f"{DATA}/customer.parquet").collect()]
    got = {x["c_custkey"]: x["luhn_digit"] for x in catalog.QUERIES["luhn_cards"](spark, DATA).collect()}
    folded = lambda c, place: sum(map(int, str(int(c) << place % 2)))
    assert got == {i: sum(folded(c, k) for k, c in enumerate(reversed(str(i)))) % 10 == 0 for i in ids}


def test_every_document_has_a_hit_count(spark, tmp_path):
    texts = [("a moron, the and Moron morons", "en"), ("el moron", "es"), ("theand", None), (None, "en"), (None, "de")]
    docs = [(i, t, lang) for i, (t, lang) in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x["hits"] for x in catalog.QUERIES["product_hits"](spark, str(tmp_path)).collect()}
    assert got == {0: 3, 1: 1, 2: 1, 3: 0, 4: 0}
