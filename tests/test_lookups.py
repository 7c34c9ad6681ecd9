"""Catalogues, topic lookup, imports and paragraphs against loops in plain Python."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from threadmill.functions.text import FORUM_HOST, keyword_pattern
from threadmill.operators import imports as J
from threadmill.operators import lookups as L
from threadmill.operators import messages as M
from threadmill.operators import products as P


@pytest.mark.parametrize("automaton", [200_000, 10])
def test_a_hundred_thousand_keywords(spark, monkeypatch, automaton):
    monkeypatch.setattr(P, "BLOCK_UNITS", 16)
    monkeypatch.setattr(P, "AUTOMATON_WORDS", automaton)
    monkeypatch.setattr(P, "MOST_GAPS", 1)
    r = random.Random(3)
    words = ["ab", "cd", "e-f", "g_h", "ij9", "k.l", "é", "mn", "op", "q+"]
    texts = {i: r.choice(["", " ", "x"]).join(r.choice(words + ["\t", " ", ", ", "AB", "Cd"]) + r.choice(["", " ", "  ", "\n"]) for _ in range(r.randrange(0, 60))) for i in range(40)}
    texts |= {100: None, 101: "", 102: "ab cd " * 500, 103: "abcd"}
    some = [r.choice(["", " ", "  "]).join(r.choice(words) for _ in range(r.randrange(1, 4))).strip() for _ in range(150)]
    some = sorted({w for w in some if w and re.match(r"[A-Za-z0-9_]", w) and re.search(r"[A-Za-z0-9_]\Z", w)})
    keywords = some + [f"zz{i} yy{i * 7}" for i in range(100_000 - len(some))]
    defs = spark.createDataFrame([(i, w, i, False, [w]) for i, w in enumerate(keywords)], "plugin int, name string, ord int, platform boolean, words array<string>")
    docs = spark.createDataFrame(list(texts.items()), "at long, u string")
    got = {(x["at"], x["name"]): x["hits"] for x in P.hits(docs, "at", "u", defs).collect()}
    want = {}
    for k, t in texts.items():
        for w in some:
            n = len(re.findall(keyword_pattern(w), t or "", re.ASCII))
            if n:
                want[k, w] = n
    assert got == want and len(want) > 100


def test_a_catalogue_of_nothing(spark):
    defs = spark.createDataFrame([], "plugin int, name string, ord int, platform boolean, words array<string>")
    docs = spark.createDataFrame([(1, "a")], "k long, t string")
    assert P.hits(docs, "k", "t", defs).count() == 0


def test_topics_by_any_spelling(spark):
    base = f"https://{FORUM_HOST}/support/topic/"
    threads = [(1, base + "my-topic/", None), (2, base + "my-topic-2/", None), (3, "x", f"http://www.{FORUM_HOST}/support/topic/my-topic"), (4, "raw", "y"), (5, None, None), (6, base + "other/support/topic/my-topic/", base + "my-topic/"), (7, base + "My-topic/", base + "my-topic?x"), (8, "", "")]
    refs = [(10, base + "my-topic/", ["raw", "", None]), (11, base + "my-topic-2/", None), (12, None, ["y"]), (13, base + "other/", [base + "other/"]), (14, None, None)]
    got = {tuple(x) for x in L.topic_threads(spark.createDataFrame(refs, "ref int, canonical string, raws array<string>"), spark.createDataFrame(threads, "thread int, guid string, url string"), "ref", "thread").collect()}
    assert got == {(10, 1), (10, 3), (10, 4), (10, 6), (11, 2), (12, 4), (13, 6)}
    plan = L.topic_threads(spark.createDataFrame(refs, "ref int, canonical string, raws array<string>"), spark.createDataFrame(threads, "thread int, guid string, url string"), "ref", "thread")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def sequential(listed, existing):
    names, pages, slugs = ({x[i].lower() for x in existing if x[i]} for i in range(3))
    out = []
    for at, page, name in sorted(listed):
        if page.lower() in pages or name.lower() in names:
            continue
        slug = re.sub("[^a-z0-9]+", "-", name.lower()).strip("-") or page
        if slug.lower() in slugs:
            slug = f"{slug}-{page}"
        out.append((at, name, page, slug, [page] if page.lower() != re.sub(r"\s+", "", name.lower()) else []))
        names.add(name.lower()), pages.add(page.lower()), slugs.add(slug.lower())
    return out


@pytest.mark.parametrize("seed", range(3))
def test_imports_as_a_loop_would(spark, seed):
    r = random.Random(seed)
    listed = [(i, r.choice(["p", "P", "q"]) + str(r.randrange(25)), r.choice(["Ab", "ab", "a b", "A-B", "a  b", "ab p1", "a-b q2", "!", "ab-p3"]) + r.choice(["", f" {r.randrange(12)}", f" p{r.randrange(5)}"])) for i in range(120)]
    existing = [("Ab 3", "p7", "ab-3"), (None, None, "a-b"), ("zz", None, None)]
    got = J.import_products(spark.createDataFrame(listed, "at long, page string, name string"), spark.createDataFrame(existing, "name string, page string, slug string"), "at").collect()
    assert sorted(map(tuple, got)) == sequential(listed, existing)


def test_a_rejected_row_blocks_nothing(spark):
    rows = spark.createDataFrame([(1, "s1", "n1"), (2, "s2", "n1"), (3, "s2", "n3"), (4, None, None), (5, None, "N3")], "at long, s string, n string")
    none = rows.where("false")
    assert [x["at"] for x in J.first_free(rows, none, ["s", "n"], "at").orderBy("at").collect()] == [1, 3, 4]
    assert J.first_free(none, rows, ["s", "n"], "at").count() == 0


def split(text, limit):
    out, held = [], ""
    for p in re.split(r"\n{2,}", text):
        if len(p) > limit:
            out.append(held.strip())
            held = ""
            out += [("piece", p[i : i + limit].strip()) for i in range(0, len(p), limit)]
            continue
        if len(held) + len(p) + 2 > limit:
            out.append(held.strip())
            held = ""
        held = f"{held}\n\n{p}" if held else p
    out.append(held.strip())
    return [x if isinstance(x, str) else x[1] for x in out if x]


def test_paragraphs_as_a_loop_would(spark):
    r = random.Random(9)
    texts = {i: "".join(r.choice(["a", " ", "b\n", "\n\n", "\n\n\n", "word " * r.randrange(1, 9)]) for _ in range(r.randrange(0, 40))) for i in range(60)}
    texts |= {100: "x" * 21 + "\n\ny" * 3, 101: "x" * 40, 102: "", 103: "\n\n" * 5, 104: "a\n\n" + "b" * 19, 105: "é" * 45 + "\n\n  \n\n" + "c" * 20}
    rows = spark.createDataFrame([*texts.items(), (200, None)], "k long, t string").repartition(3)
    got = collections.defaultdict(list)
    for x in M.split_paragraphs(rows, "k", "t", 20).orderBy("k", "chunk").collect():
        assert x["chunk"] == len(got[x["k"]])
        got[x["k"]].append(x["body"])
    assert dict(got) == {k: split(t, 20) for k, t in texts.items() if split(t, 20)}


def test_hits_are_hydrated_best_first(spark):
    from threadmill.operators import search as S

    ranked = spark.createDataFrame([("a", 0.2), ("b", 0.9), ("c", 0.5), ("d", 0.9)], "k string, similarity double")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("d", 4)], "k string, v int")
    got = S.hydrate(ranked, rows, "k", F.desc("similarity")).select("place", "k", "v").collect()
    assert [tuple(x) for x in got] == [(1, "b", 2), (2, "d", 4), (4, "a", 1)]
