"""Filters, nested site maps, feeds, gates and ingest states on small cases."""

import datetime as dt

from pyspark.sql import functions as F

from threadmill.operators import desk as O
from threadmill.operators import incremental as I
from threadmill.operators import messages as M
from threadmill.operators import relational as R
from threadmill.sources import documents as S

DAY = lambda n: dt.datetime(2026, 1, n)


def test_every_filter_and_none(spark):
    schema = "k int, state string, brand int, tags array<string>, email string, operator string, junk boolean, preview string, last_message_at timestamp_ntz"
    rows = [
        (1, "open", 1, ["a"], "Ann@x.org", "o1", False, "50% off_now", DAY(1)),
        (2, "open", 2, ["b"], "bob@x.org", "o2", True, "fifty", DAY(2)),
        (3, None, None, None, None, None, None, None, None),
        (4, "done", 1, ["p"], "ann@y.org", None, False, "OFF_NOW", DAY(3)),
    ]
    c = spark.createDataFrame(rows, schema)
    files = spark.createDataFrame([(1,), (1,), (3,)], "k int")
    chunks = spark.createDataFrame([(2, "p"), (2, "p"), (3, "q"), (1, None)], "k int, product string")
    at = lambda n: F.expr(f"TIMESTAMP_NTZ '2026-01-0{n} 00:00:00'")

    def got(**f):
        return sorted(r["k"] for r in R.listed(c, "k", files, chunks, **f).select("k").collect())

    assert got() == got(state="", email="", preview="  ", tag="", product="", junk=None, attachment=False) == [1, 2, 3, 4]
    assert got(state="open") == [1, 2]
    assert got(brand=1) == [1, 4]
    assert got(tag="b") == [2]
    assert got(email="ANN") == [1, 4]
    assert got(operator="o1") == [1]
    assert got(attachment=True) == [1, 3]
    assert (got(junk="hide"), got(junk="only")) == ([1, 4], [2])
    assert got(preview=" off_n ") == [1, 4] and got(preview="0% o") == [1] and got(preview="o%f") == []
    assert got(since=at(2)) == [2, 4] and got(until=at(2)) == [1, 2] and got(since=at(2), until=at(2)) == [2]
    assert got(product="p") == [2, 4]
    assert got(product="p", brand=1, junk="hide") == [4]


def test_site_maps_one_level_deep(spark):
    def xml(*locs):
        return "".join(f"<url><loc> {x} </loc></url>" for x in locs)

    many = [f"https://c/sitemap-{i}.xml" for i in range(12)]
    maps = [
        ("flat", xml("https://a/1", "https://a/sitemap.xml", "https://a/3")),
        ("index", xml("https://b/sitemap1.xml", "https://b/gone-sitemap.xml", "https://b/sitemap2.xml")),
        ("https://b/sitemap1.xml", xml("https://b/1", "https://b/2")),
        ("https://b/sitemap2.xml", xml("https://b/sitemap3.xml", "https://b/4")),
        ("https://b/sitemap3.xml", xml("https://b/never")),
        ("many", xml(*many)),
        *[(u, xml(f"{u}/p")) for u in many],
        ("empty", ""),
        ("null", None),
    ]
    m = spark.createDataFrame(maps, "url string, xml string")
    roots = spark.createDataFrame([("flat",), ("index",), ("many",), ("empty",), ("null",), ("missing",), (None,), ("flat",)], "url string")

    def got(**k):
        out = {}
        for r in S.site_pages(m, roots, **k).orderBy("root", "place").collect():
            out.setdefault(r["root"], []).append(r["page"])
        return out

    all_ = got()
    assert all_["flat"] == ["https://a/1", "https://a/sitemap.xml", "https://a/3"]
    assert all_["index"] == ["https://b/1", "https://b/2", "https://b/sitemap3.xml", "https://b/4"]
    assert all_["many"] == [f"{u}/p" for u in many[:10]]
    assert set(all_) == {"flat", "index", "many"}
    assert [len(x) for x in got(most=2).values()] == [2, 2, 2]


def test_feed_excerpts_and_what_counts_as_a_copy(spark):
    def item(link, guid, more, title="T"):
        return f"<item><title>{title}</title><link>{link}</link><guid>{guid}</guid>{more}</item>"

    xml = "".join(
        [
            item("https://x/a", "https://x/a#one", "<description>never</description><content:encoded><![CDATA[<p>A &amp;  b</p>\n\n\n<p>c<br>d</p>]]></content:encoded>"),
            item("https://x/a", "https://x/a#two", "<description>a copy</description>"),
            item("https://x/b", "https://x/b", "<content:encoded></content:encoded><description>unused</description>"),
            item("https://x/c", "https://x/c", f"<description>{'y' * 5000}</description>"),
            item("https://x/a#post-1", "https://x/a#post-1", "<description>r</description>"),
            item("https://x/a#post-2", "https://x/a#post-2", "", title=""),
            item("https://x/a#post-2", "https://x/a#post-2", ""),
            item("https://x/d", "https://x/d", ""),
        ]
    )
    got = S.feed_items(spark.createDataFrame([(xml,), (None,)], "xml string"), "xml", "x").orderBy("pos").collect()
    assert [r["pos"] for r in got] == [0, 2, 3, 4, 5, 7]
    assert [r["excerpt"] for r in got] == ["A & b\n\nc d", "", "y" * 4000, None, None, ""]


def test_notices_are_not_chunkable(spark):
    rows = [(1, 0, "user", "  **[WordPress Plugin][1] x"), (1, 1, "operator", "a"), (2, 1, "user", "[WordPress Plugin]"), (2, 0, "user", "hi"), (2, 2, "operator", "a"), (3, 0, "user", "q"), (3, 1, "note", "n"), (4, 0, "user", None), (4, 1, "operator", "a")]
    got = M.chunkable(spark.createDataFrame(rows, "conv int, pos int, sender string, text string")).collect()
    assert sorted(r["conv"] for r in got) == [2, 4]


def test_announced_topics_are_verified_whatever_their_age(spark):
    rows = [(1, "reviewed", DAY(2), False), (2, "dismissed", DAY(1), False), (3, "new", None, False), (4, "new", DAY(1), False), (5, "new", DAY(1), True), (6, "new", DAY(1), False)]
    t = spark.createDataFrame(rows, "id int, status string, waiting_since timestamp, resolved boolean")
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 4)], "id int")
    due = O.verify_due(F.col("status"), F.col("waiting_since"), F.col("resolved"))
    assert [r["id"] for r in O.refreshed_first(t, due, "id", ids).collect()] == [4, 1]
    assert [r["id"] for r in O.refreshed_first(t, due, "id", None, 2).collect()] == [4, 6]


def test_failed_pages_are_taken_up_again(spark):
    pages = "u string, h string, kind string"
    old = spark.createDataFrame([("same", "1", "docs"), ("changed", "1", "docs"), ("gone", "1", "docs"), ("failed", "1", "docs"), ("flip", "1", "docs"), ("again", None, "docs")], pages)
    new = spark.createDataFrame([("same", "1", "docs"), ("changed", "2", "docs"), ("failed", "2", "docs"), ("flip", "1", "forum"), ("again", "1", "docs"), ("new", "1", "docs")], pages)
    failed = spark.createDataFrame([("failed",), ("failed",), ("same",)], "u string")

    def got(forum):
        return {r["u"]: (r["h"], r["kind"], r["chunks"]) for r in O.ingest_done(old, new, failed, "u", "h", "kind", forum).collect()}

    want = {"same": ("1", "docs", "keep"), "changed": ("2", "docs", "rebuild"), "failed": (None, "docs", "none"), "flip": ("1", "forum", "rebuild"), "again": ("1", "docs", "rebuild"), "new": ("1", "docs", "rebuild")}
    assert got(False) == want
    assert got(True) == want | {"gone": ("1", "docs", "keep")}


def test_only_what_becomes_junk_loses_its_chunks(spark):
    before = spark.createDataFrame([(1, False), (2, True), (3, None), (4, True)], "k int, junk boolean")
    after = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False), (5, True)], "k int, junk boolean")
    chunks = spark.createDataFrame([(k, i) for k in range(1, 7) for i in range(2)], "k int, i int")
    assert sorted({r["k"] for r in I.without_junk(chunks, before, after, "k").collect()}) == [2, 4, 6]
