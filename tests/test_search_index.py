"""The positional index, its language and rank, and the inverted file, against brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmill import search_queries
from threadmill.operators import fulltext as X
from threadmill.operators import ivf as V


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def has(ws, unit):
    n = len(unit.terms)
    return any(tuple(ws[i : i + n]) == unit.terms for i in range(len(ws) - n + 1)) != unit.negated


def brute_rank(ws, alternatives):
    terms = sorted({t for units in alternatives for u in units for t in u.terms})
    at = {t: [i for i, w in enumerate(ws) if w == t] for t in terms}
    first = alternatives[0]
    joined = len(alternatives) == 1 and (len(first) > 1 or len(first[0].terms) > 1 and not first[0].negated)
    if not joined or len(terms) < 2:
        return sum(0.1 * sum(1 / (j + 1) ** 2 for j in range(len(at[t]))) / 1.64493406685 for t in terms) / len(terms)
    rank = -1.0
    for i, a in enumerate(terms):
        for b in terms[:i]:
            for x in at[a]:
                for y in at[b]:
                    d = abs(x - y)
                    w = math.sqrt(0.01 * (1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))))
                    rank = w if rank < 0 else 1 - (1 - rank) * (1 - w)
    return rank if rank >= 0 else 1e-20


def brute(texts, query):
    alternatives = X.websearch(query)
    return {k: brute_rank(words(t), alternatives) for k, t in texts.items() if any(all(has(words(t), u) for u in units) for units in alternatives)}


@pytest.mark.parametrize(
    "query,want",
    [
        ("a b", [[("a",), ("b",)]]),
        ('"a b" c', [[("a", "b"), ("c",)]]),
        ("a OR b c or d", [[("a",)], [("b",), ("c",)], [("d",)]]),
        ('-a -"b c"', [[("-", "a"), ("-", "b", "c")]]),
        ("or a or or -- ! OR", [[("a",)]]),
        ("foo-bar Ünïcode_x", [[("foo", "bar"), ("ünïcode", "x")]]),
        ('"open quote', [[("open", "quote")]]),
        ("", []),
        ('"" - ...', []),
    ],
)
def test_query_language(query, want):
    assert [[(("-",) if u.negated else ()) + u.terms for u in units] for units in X.websearch(query)] == want


@pytest.fixture(scope="module")
def texts():
    r = random.Random(2)
    out = {i: " ".join(r.choice("alpha beta gamma delta eps Zeta, eta. É-clair".split()) for _ in range(r.randrange(0, 25))) for i in range(80)}
    out |= {100: None, 101: "", 102: "alpha " + "x " * 300 + "beta", 103: "alpha beta " * 3000, 104: "... ,,"}
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id long, text string")


QUERIES = ["alpha", "alpha beta", '"beta gamma delta"', '"alpha beta" -gamma', '-alpha -"beta eps"', "É-clair", 'eps "eta é" OR zeta -alpha OR "gamma gamma"', "--", '"x x" alpha']


@pytest.mark.parametrize("query", QUERIES)
def test_search_against_brute_force(spark, texts, index, query):
    got = {r["doc"]: r["rank"] for r in X.search(spark, index, query).collect()}
    want = brute(texts, query)
    assert set(got) == set(want)
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in want)


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("fts") / "index")
    X.build(frame(spark, texts).repartition(3), "id", "text", path)
    return path


def test_a_query_reads_the_buckets_of_its_terms(spark, index):
    plan = X.postings(spark, index, ["alpha", "beta"])._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ (IN|INSET)", plan) and "PushedFilters: [In(term" in plan


def test_changed_and_deleted_documents(spark, texts, tmp_path):
    path = f"{tmp_path}/index"
    X.build(frame(spark, texts), "id", "text", path)
    now = dict(texts)
    new = {3: "alpha alpha omega", 500: "omega beta", 7: None}
    X.upsert(spark, path, frame(spark, new), None, "id", "text")
    now |= new
    gone = frame(spark, {5: "", 500: "", 999: "", 3: ""}).select("id")
    X.upsert(spark, path, frame(spark, {3: "beta"}), gone, "id", "text")
    for k in (5, 500, 3):
        now.pop(k)
    X.upsert(spark, path, frame(spark, {5: "alpha again", 6: "omega"}), None, "id", "text")
    now |= {5: "alpha again", 6: "omega"}
    # A generation without its list of documents, as a broken run leaves it, is not there.
    X._put(frame(spark, {8: "alpha broken", 9: "omega"}), "id", "text", path, 4)
    X.compact(spark, path, f"{tmp_path}/packed")
    for query in ("omega", '"alpha again" OR -alpha'):
        for place in (path, f"{tmp_path}/packed"):
            got = {r["doc"]: r["rank"] for r in X.search(spark, place, query).collect()}
            want = brute(now, query)
            assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    assert {r["doc"] for r in X.documents(spark, path).collect()} == set(now)
    stale = X.postings(spark, path).where("doc = 3 or (doc = 6 and term <> 'omega')")
    assert stale.count() == 0


def test_tiers_in_order(spark, texts, index):
    docs = frame(spark, texts).withColumn("at", -F.col("id"))
    find = lambda q, n: [r["doc"] for r in X.keyword_search(spark, index, docs, "id", "text", "at", q, n).orderBy("place").collect()]

    def best(q, n):
        ranks = brute(texts, q)
        return sorted(ranks, key=lambda k: (-ranks[k], k))[:n]

    assert find("alpha beta", 5) == best("alpha beta", 5)
    assert find("'alpha' nowhere", 5) == best("alpha OR nowhere", 5)
    assert find("lph", 4) == [k for k, t in texts.items() if "lph" in (t or "").lower()][:4]
    assert find("nowhere", 5) == []


def test_an_index_of_nothing(spark, tmp_path):
    path = f"{tmp_path}/index"
    X.build(frame(spark, {1: ""}).where("id > 1"), "id", "text", path)
    assert X.search(spark, path, "-alpha").count() == 0
    X.upsert(spark, path, frame(spark, {1: "alpha"}), None, "id", "text")
    assert X.search(spark, path, "alpha").count() == 1


# The inverted file


@pytest.fixture(scope="module")
def ivf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ivf") / "index")
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    V.build(rows, "vec_id", "embedding", path)
    return path, rows


def test_recall_over_many_queries(spark, ivf):
    path, rows = ivf
    asked = rows.where("vec_id % 10 = 3")
    exact, near = ({(r["query"], r["key"]) for r in V.topk(spark, path, asked, "vec_id", "embedding", n, 10).collect()} for n in (V.LISTS, search_queries.PROBES))
    x = np.array([r["embedding"] for r in rows.orderBy("vec_id").collect()], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {(q, int(i)) for q in range(3, len(x), 10) for i in np.argsort(-(x @ x[q]), kind="stable")[:10]}
    recall = len(near & want) / len(want)
    print("recall", recall)
    assert len(exact & want) / len(want) > 0.999 and recall >= 0.9


def test_recall_where_vectors_have_themes(spark, tmp_path):
    r = np.random.default_rng(1)
    themes = r.standard_normal((60, 24))
    x = themes[r.integers(0, 60, 3000)] + 0.4 * r.standard_normal((3000, 24))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    V.build(rows, "vec_id", "embedding", f"{tmp_path}/index")
    got = {(g["query"], g["key"]) for g in V.topk(spark, f"{tmp_path}/index", rows.where("vec_id % 10 = 3"), "vec_id", "embedding", 12, 10).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {(q, int(i)) for q in range(3, len(x), 10) for i in np.argsort(-(x @ x[q]), kind="stable")[:10]}
    assert len(got & want) / len(want) >= 0.95


def test_one_query_reads_its_lists(spark, ivf):
    path, rows = ivf
    q = rows.where("vec_id = 5").first()["embedding"]
    few = V.nearest_to(spark, path, list(q), 3, 10)
    assert re.search(r"PartitionFilters: \[.*list#\d+ IN", few._jdf.queryExecution().toString())
    assert few.first()["key"] == 5
    every = [r["key"] for r in V.nearest_to(spark, path, list(q), V.LISTS, 10).collect()]
    assert every == [r["key"] for r in V.topk(spark, path, rows.where("vec_id = 5"), "vec_id", "embedding", V.LISTS, 10).orderBy("place").collect()]


def test_vectors_without_a_direction(spark, tmp_path):
    schema = "id long, v array<float>, list string, key string"
    rows = [(i, [float(i % 5 + 1), 1.0, -float(i)], "x", "y") for i in range(40)]
    rows += [(100, None, "x", "y"), (101, [0.0] * 3, "x", "y"), (102, [None, 1.0, 1.0], "x", "y"), (103, [float("nan")] * 3, "x", "y"), (104, rows[4][1], "x", "y")]
    df = spark.createDataFrame(rows, schema)
    V.build(df, "id", "v", f"{tmp_path}/a", lists=4)
    got = V.topk(spark, f"{tmp_path}/a", df, "id", "v", 4, 2).collect()
    assert {r["query"] for r in got} == {*range(40), 104} and len(got) == 82
    assert [r["key"] for r in sorted(got, key=lambda r: r["place"]) if r["query"] == 104] == [4, 104]
    V.build(df.limit(0), "id", "v", f"{tmp_path}/b")
    assert V.topk(spark, f"{tmp_path}/b", df, "id", "v", 4, 2).count() == 0


def test_words_of_a_slice_are_held_as_numbers():
    """A million words in 200 texts: their strings alone would take 50 MB."""
    import tracemalloc

    import pyarrow as pa

    text = " ".join(f"w{i % 997}" for i in range(5000))
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([text] * 200)], ["doc", "text"])
    tracemalloc.start()
    rows = list(X._invert(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(r.num_rows for r in rows) == 997 and peak < 60e6
