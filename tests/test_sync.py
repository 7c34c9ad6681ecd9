"""Walks, rules, vectors and change logs against loops in plain Python."""

import datetime as dt
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmill.functions.text import FORUM_HOST
from threadmill.operators import embedding as B
from threadmill.operators import rules as U
from threadmill.operators import walk as W
from threadmill.streaming import mergelog as G


@pytest.mark.parametrize("ranged", [False, True])
def test_walk_as_a_loop_would(spark, ranged):
    r = random.Random(3)
    rows = []
    for brand in range(25):
        for page in range(1, r.randrange(2, 9)):
            if brand % 6 == 5 and page == 3:
                continue
            for _ in range(3):
                rows.append((brand, page, r.choice([None, f"s{len(rows)}", f"s{len(rows)}"]), r.choice([None, *range(page, 12)]) if r.random() < 0.9 else 0))
    resume = [(b, None if b % 4 == 0 else 2) for b in range(25) if b % 2 == 0]
    override = [(8, 1), (9, 3), (10, 4)]
    starts = W.first_pages(spark.createDataFrame([(b,) for b in range(25)], "brand int"), spark.createDataFrame(resume, "brand int, page int"), spark.createDataFrame(override, "brand int, page int"))
    fresh = F.col("at").isNull() | (F.col("at") >= 5)
    inside = F.col("at") <= 8 if ranged else None
    df = spark.createDataFrame(rows, "brand int, page int, session string, at int")
    synced, progress = W.walk(df, starts, fresh, inside)
    want_rows, want_pages = [], []
    for brand in range(25):
        start = dict(override).get(brand, dict(resume).get(brand, 1) if brand in dict(resume) else 1)
        total, page = 0, start
        while page is not None:
            here = [x for x in rows if x[:2] == (brand, page)]
            if not here or ranged and not any(x[3] is not None and x[3] <= 8 for x in here):
                if want_pages and want_pages[-1][0] == brand:
                    want_pages[-1][4] = "range" if here else "end"
                break
            taken = [x for x in here if x[2] and (x[3] is None or x[3] >= 5)]
            total += len(taken)
            want_rows += taken
            want_pages.append([brand, page, len(taken), total, None])
            page += 1
            if not taken:
                want_pages[-1][4] = "stale"
                break
    assert sorted(str(tuple(x)) for x in synced.select("brand", "page", "session", "at").collect()) == sorted(map(str, want_rows))
    assert sorted(map(tuple, progress.collect())) == sorted(map(tuple, want_pages))


def test_one_forum_source_for_each_plugin(spark):
    r = random.Random(5)
    base = f"https://{FORUM_HOST}/support/plugin/"
    urls = [base + "a/", f"http://www.{FORUM_HOST}/support/plugin/a?x#y", "https://other.example/f", "https://other.example/f/", base + "b"]
    wanted = [(i, r.randrange(12), r.choice(urls), r.choice(["url", "forum", "sitemap"])) for i in range(80)]
    existing = [(3, base + "a/", "url"), (4, "https://x.example/", "forum"), (5, "https://other.example/f/", "sitemap")]
    have, want = list(existing), []
    for at, plugin, url, kind in wanted:
        if FORUM_HOST in url or kind == "forum":
            kind = "forum"
            url = {urls[1]: base + "a/", urls[2]: urls[3], urls[4]: base + "b/"}.get(url, url)
            if any(p == plugin and (k == "forum" or u == url) for p, u, k in have):
                continue
        have.append((plugin, url, kind))
        want.append((at, plugin, url, kind))
    got = U.sources_to_add(spark.createDataFrame(wanted, "at int, plugin int, url string, type string"), spark.createDataFrame(existing, "plugin int, url string, type string"), "at")
    assert sorted(map(tuple, got.collect())) == want


def test_targets_fall_back(spark):
    none = spark.createDataFrame([], "brand int, site string, name string, created int")
    assert [tuple(x) for x in U.sync_targets(none, "site").collect()] == [(None, "site", "default", 1)]
    assert U.sync_targets(none, None).count() == 0
    two = spark.createDataFrame([(1, "a", "A", 5), (2, "b", "B", 3)], none.schema)
    assert [x["brand"] for x in U.sync_targets(two, "site").orderBy("place").collect()] == [2, 1]


def test_author_pages_end(spark):
    rows = [("a", p, {1: 5, 2: 5, 3: None, 4: 5}[p], i, f" s{p * 10 + i % 2} ", "" if i == 1 else "N") for p in (1, 2, 3, 4) for i in range(3)]
    rows += [("b", 1, None, 0, "x", None), ("b", 2, 2, 0, "y", "Y"), ("c", 1, 1, 0, " ", "Z"), ("d", 1, 9, 0, "x", "X"), ("d", 3, 9, 0, "z", "Z")]
    got = U.author_products(spark.createDataFrame(rows, "author string, page int, pages int, pos int, slug string, name string")).orderBy("author", "place").collect()
    assert [tuple(x) for x in got] == [("a", "s10", "N", 1), ("a", "s11", "s11", 2), ("a", "s20", "N", 3), ("a", "s21", "s21", 4), ("a", "s30", "N", 5), ("a", "s31", "s31", 6), ("b", "x", "x", 1), ("d", "x", "X", 1)]


def test_hashing_model_by_hand():
    v = B.hashing_model(8)(["One two", " "])
    want = np.zeros(8)
    for f in ("one", "two", "one two"):
        h = zlib.crc32(f.encode())
        want[(h >> 1) % 8] += 1 if h & 1 else -1
    assert np.allclose(v[0], want / np.linalg.norm(want)) and v[1] == [1.0] + [0.0] * 7


def test_vectors_end_to_end(spark):
    def model(texts):
        assert len(texts) <= 64 and all(t.strip() or t == " " for t in texts)
        if any("boom" in t for t in texts):
            raise RuntimeError("no")
        return [[1.0] * (3 if "narrow" in t else 4) if "nan" not in t else [float("nan")] * 4 for t in texts]

    texts = ["a", None, "", "boom", "narrow", "nan", "known", "known", "a", "  "] + [f"t{i}" for i in range(150)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    prior = spark.createDataFrame([("known", [1.0, 2.0, 3.0, 4.0], 1), ("known", [5.0] * 4, 2), ("a", [1.0], 3), ("t1", None, 1)], "text string, vector array<float>, at int")
    got = {x["id"]: (x["how"], x["vector"], x["error"]) for x in B.refreshed(chunks, prior, "id", "text", "at", model, 4).collect()}
    assert got[3][0] == "failed" and "no" in got[3][2] and got[4][2] == "width 3, not 4" and got[5][0] == "failed"
    assert got[6] == got[7] == ("reused", [5.0] * 4, None)
    assert all(got[i] == ("embedded", [1.0] * 4, None) for i in (0, 1, 2, 8, 9, *range(10, 160)))
    table = chunks.select("id", F.lit(None).cast("array<float>").alias("embedding"), F.lit("[]").alias("json"))
    new = spark.createDataFrame([(k, v) for k, (_, v, _) in got.items()], "id long, vector array<float>")
    kept = {x["id"]: (x["embedding"], x["json"]) for x in B.stored(table, new, "id", 4).collect()}
    assert kept[3] == (None, "[]") and kept[6] == ([5.0] * 4, None) and len(kept) == len(texts)


DAY = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
COLUMNS = "k int, a string, b int, at timestamp"


def test_change_log(spark, tmp_path):
    path = f"{tmp_path}/log"
    G.create(spark, path, COLUMNS)
    good = F.coalesce(F.col("a") != "bad", F.lit(True))
    write = G.commit_batches(path, ["k"], "at", good, lambda x: x.withColumn("a", F.when(F.col("b") == 1, "healed").otherwise(F.col("a"))))
    rows = lambda *x: spark.createDataFrame(list(x), COLUMNS)
    now = lambda: {r["k"]: tuple(r)[1:] for r in G.read(spark, path, ["k"], "at").select("k", "a", "b", "at").collect()}
    dead = lambda: sorted(r["k"] for r in G.dead_letters(spark, path, ["k"], "at").collect())
    assert now() == {} and G.checkpoint(spark, path, ["k"], "at") is None
    write(rows(*[(k, "x", k, DAY(0)) for k in range(200)], (300, "bad", 1, DAY(1)), (301, "bad", 2, DAY(2)), (5, "y", None, DAY(3))), 0)
    assert now()[300] == ("healed", 1, DAY(1)) and now()[5] == ("y", 5, DAY(3)) and 301 not in now()
    assert dead() == [301] and G.checkpoint(spark, path, ["k"], "at") == DAY(2)
    # A batch that was broken off before its commit is not there; run again it counts once.
    rows((7, "lost", 7, DAY(9))).write.parquet(f"{path}/changes/e=1")
    rows((8, "lost", 7, DAY(9))).write.parquet(f"{path}/dead/e=1")
    assert now()[7] == ("x", 7, DAY(0)) and dead() == [301]
    for _ in range(2):
        write(rows((7, None, 70, DAY(4)), (6, "old", 60, DAY(-1)), (301, "fine", 3, DAY(2))), 1)
    assert now()[7] == ("x", 70, DAY(4)) and now()[6] == ("x", 6, DAY(0)) and now()[301] == ("fine", 3, DAY(2))
    assert dead() == [] and G.checkpoint(spark, path, ["k"], "at") == DAY(4)
    size = lambda where: sum(os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(where) for f in fs)
    before = now()
    G.compact(spark, path, ["k"], "at")
    assert now() == before and dead() == []
    write(rows((7, "last", None, DAY(5))), 2)
    assert now() == before | {7: ("last", 70, DAY(5))}
    G.compact(spark, path, ["k"], "at")
    assert now() == before | {7: ("last", 70, DAY(5))} and size(f"{path}/changes/e=2") < size(f"{path}/bases/e=1")


def test_change_log_as_a_sink(spark, tmp_path):
    path = f"{tmp_path}/log"
    G.create(spark, path, COLUMNS)
    for i in range(3):
        spark.createDataFrame([(k, f"v{i}", i, DAY(i)) for k in range(i, 10)], COLUMNS).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    write = G.commit_batches(path, ["k"], "at", F.col("k") != 4)
    q = source.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = {r["k"]: r["a"] for r in G.read(spark, path, ["k"], "at").collect()}
    assert got == {k: f"v{min(k, 2)}" for k in range(10) if k != 4}
    assert G.checkpoint(spark, path, ["k"], "at") == DAY(0)


def test_one_answer_of_a_session_travels(spark, tmp_path):
    """Answers are not rows: the plan makes none of them, and repeated sessions are one."""
    answers = "array<struct<brand:int,site:string,place:int,status:int>>"
    rows = [
        (1, 2, [(1, "a", 1, 200), (2, "b", 2, 500)]),  # its own brand first
        (2, None, [(1, "a", 1, 404), (3, "c", 3, 200), (2, "b", 2, 404)]),
        (3, 1, [(1, "a", 1, 404)]),
        (4, 9, [(2, "b", 2, 200)]),
        (4, 9, [(1, "a", 1, 200), (9, "z", 9, 404)]),
        (5, 1, []),
    ]
    got = U.found_at(spark.createDataFrame(rows, f"session int, known int, answers {answers}"))
    assert {tuple(x) for x in got.collect()} == {(1, None, "error"), (2, "c", "found"), (3, None, "missing"), (4, "a", "found"), (5, None, "missing")}
    spark.range(90).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(25).selectExpr("cast(id AS int) AS n_nationkey", "concat('n', id) AS n_name").write.parquet(f"{tmp_path}/nation.parquet")
    from threadmill import sync_queries

    out = sync_queries.resync_found(spark, str(tmp_path))
    assert out.count() == 90 and "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
