"""Spelling variants, centroid clustering and line dedup against brute force, with every odd kind of row."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmill.llm import lines, lloyd, queries, sharding, spelling, suffix_dedup, transducer

CLASHING = "doc_id long, text string, row string, doc long, mark long, gone string, kept string, n_lines string, h1 long, first long, word string, n long"


def table(spark, rows):
    """Rows (doc_id, text) with columns named like the operators' own."""
    return spark.createDataFrame([(k, t, "r", 7, 8, "g", "k", "l", 9, 10, "w", 11) for k, t in rows], CLASHING)


# 11. Spelling variants


def brute_words(rows):
    n = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    n = brute_words(rows)
    links = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, c in n.items():
        best = min(links[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * c else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(links[w]), n[form[w]] if form[w] else None)
    return out


@pytest.fixture(scope="module")
def misspelt():
    r = random.Random(5)
    stems = ["".join(r.choice("abéd") for _ in range(r.randrange(7, 10))) for _ in range(12)] + ["aaaaaaa", "aaaaaaaa", "abababab", "ÀÉÎõüÿ×÷x"]
    words = []
    for s in stems:
        words += [s] * 120
        for _ in range(12):
            i, c = r.randrange(len(s)), r.choice("abéd")
            words += [r.choice([s[:i] + s[i + 1 :], s[:i] + c + s[i + 1 :], s[:i] + c + s[i:]])] * r.choice([1, 2, 3, 11, 130])
    r.shuffle(words)
    rows = [(i // 2 * 3, " ".join(w.upper() if r.random() < 0.1 else w for w in words[k : k + 40])) for i, k in enumerate(range(0, len(words), 40))]
    return rows + [(None, "Straßenbahn straßenbahn1straßenbahn"), (900, None), (901, ""), (902, "short 1234567 x-y"), (903, "abcdefgh " * 2000), (906, "translators " * 400 + "translator " * 30 + "translatr " * 3)]


@pytest.mark.parametrize("cell_words,shard_rows", [(5_000, 100_000), (3, 40)])
def test_spelling_variants_against_brute_force(spark, misspelt, monkeypatch, cell_words, shard_rows):
    monkeypatch.setattr(spelling, "CELL_WORDS", cell_words)
    monkeypatch.setattr(spelling, "SHARD_ROWS", shard_rows)
    got = spelling.spelling_variants(table(spark, misspelt)).collect()
    want = brute_variants(misspelt)
    assert any(v[0] and v[1] != v[0] for v in want.values())  # chains of two forms
    assert len(got) == len(want) and {x["word"]: tuple(x)[1:] for x in got} == want


def test_one_edit():
    r = random.Random(1)
    words = ["".join(r.choice("ab") for _ in range(n)) for n in (3, 4, 5) for _ in range(12)]
    for w, v in itertools.product(words, words):
        if len(v) - len(w) in (0, 1):
            assert spelling.one_edit(w, v) == near(w, v)


def test_no_words(spark):
    assert spelling.spelling_variants(table(spark, [])).count() == 0
    assert spelling.spelling_variants(table(spark, [(1, None), (2, "a few short words")])).count() == 0


# 12. Centroid clustering


def brute_kmeans(rows, clusters, rounds, dims):
    kept = [(k, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for k, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{k}".encode()).hexdigest(), v.tolist()) for k, v in kept if k is not None)
    c = [np.array(v) for _, v in first[:clusters]]
    nearest = lambda x: min(range(len(c)), key=lambda i: (int(((x - c[i]) ** 2).sum()), i))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[nearest(v)].append(v)
        c = [sum(groups[i]) // len(groups[i]) if i in groups else c[i] for i in range(len(c))]
    out = [(k, nearest(v), int(((v - c[nearest(v)]) ** 2).sum())) for k, v in kept]
    per = collections.Counter()
    for _, i, d in out:
        per[i] += d
    sha = [hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in c]
    return collections.Counter((k, i, d, per[i], sum(per.values()), sha[i]) for k, i, d in out)


@pytest.mark.parametrize("tree_rows", [4096, 50])
def test_clusters_against_brute_force(spark, monkeypatch, tree_rows):
    monkeypatch.setattr(lloyd, "TREE_ROWS", tree_rows)
    r = np.random.default_rng(4)
    base = r.standard_normal((9, 6))
    rows = [(int(i), (base[i % 9] * (1 + i % 3) + r.standard_normal(6) * (0.3 if i % 2 else 0.01)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # one vector in many rows
    rows += [(2000 + i, [float(i % 3), 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(60)]  # ties
    rows += [(3, rows[3][1]), (None, rows[5][1]), (3000, None), (3001, []), (3002, [1.0] * 5), (3003, [None] + [1.0] * 5), (3004, [float("nan")] * 6), (3005, [float("inf")] * 6)]
    df = spark.createDataFrame([(k, v, 1, 2, "x") for k, v in rows], "vec_id long, embedding array<float>, cluster int, key int, v string").repartition(3)
    for clusters in (13, 1):
        got = collections.Counter(map(tuple, lloyd.clustered(df, dims=6, clusters=clusters, rounds=4).collect()))
        assert got == brute_kmeans(rows, clusters, 4, 6)


def test_fewer_vectors_than_clusters_and_none(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, [9.0, -9.0])]
    got = lloyd.clustered(spark.createDataFrame(rows, schema), dims=2, clusters=40).collect()
    assert collections.Counter(map(tuple, got)) == brute_kmeans(rows, 40, 5, 2)
    assert lloyd.clustered(spark.createDataFrame([], schema)).count() == 0
    assert lloyd.clustered(spark.createDataFrame([(1, [1e300, 1.0])], schema), dims=2).count() == 0


def test_trees_cover_and_separate():
    x = np.random.default_rng(6).integers(-900, 900, (700, 5))
    x[100:300] = x[0]
    t = lloyd.CoverTree.build(x, 8)
    assert sorted(t.order) == list(range(700))
    far = lambda a, b: np.sqrt(((x[a] - x[b]) ** 2).sum(axis=-1))
    for (start, end, own, centre, first, kids), radius in zip(t.nodes, t.radius):
        assert far(t.order[start:end], centre).max() <= radius + 1e-6
        centres = t.nodes[first : first + kids, 3]
        assert all(far(a, b) > radius / 2 - 1e-6 for a, b in itertools.combinations(centres, 2))
        assert all(t.radius[first : first + kids] <= radius / 2 + 1e-6)
        assert end - own == sum(t.nodes[k, 1] - t.nodes[k, 0] for k in range(first, first + kids))
    v = lloyd.VectorTree(x[t.order], np.column_stack([t.nodes[:, :3], np.argsort(t.order)[t.nodes[:, 3]], t.nodes[:, 4:]]), t.radius)
    c = x[np.random.default_rng(7).integers(0, 700, 30)]  # some of them equal
    near, total, count = v.assign(lloyd.Centroids(c))
    want = ((v.x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (near == want).all() and (count == np.bincount(want, minlength=30)).all()
    assert all((total[i] == v.x[want == i].sum(axis=0)).all() for i in range(30))


# 13. Line dedup


def brute_lines(rows, min_docs=2):
    norm = lambda x: "".join(c.lower() if c < "\x80" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for k, t in rows:
        if k is not None:
            for x in (t or "").split("\n"):
                if len(norm(x)) >= 10:
                    holders[norm(x)].add(k)
    out = collections.Counter()
    for k, t in rows:
        given = (t or "").split("\n")
        gone = [k is not None and len(holders[norm(x)]) >= min_docs and k > min(holders[norm(x)]) for x in given]
        out[k, len(given), sum(gone), "\n".join(x for x, g in zip(given, gone) if not g)] += 1
    return out


@pytest.fixture(scope="module")
def lined():
    r = random.Random(8)
    pool = ["", "  ", "short", "ten chars.", "Ten CHARS.\r", "\tten chars. ", "nine char", "É is not lowered", "é is not lowered", "the same long line " * 50]
    pool += [f"line number {i} of them" for i in range(30)]
    rows = [(i * 2, "\n".join(r.choice(pool) for _ in range(r.randrange(0, 30)))) for i in range(60)]
    rows += [(4, rows[2][1]), (4, "ten chars.\nother text of four"), (None, "ten chars.\nten chars."), (500, None), (501, ""), (502, "\n\n"), (503, "ten chars."), (504, rows[1][1]), (504, rows[1][1])]
    return rows + [(505, "\n".join(f"line number {i % 40} of them" for i in range(20_000)))]


@pytest.mark.parametrize("min_docs", [2, 5])
def test_lines_against_brute_force(spark, lined, min_docs):
    got = lines.dedup_lines(table(spark, lined).repartition(3), min_docs=min_docs)
    assert set(got.columns) == set(CLASHING.replace(" long", "").replace(" string", "").split(", ")) | {"n_dropped"}
    rows = got.where("row = 'r' and doc = 7 and mark = 8 and gone = 'g' and first = 10").select("doc_id", "n_lines", "n_dropped", "kept").collect()
    assert collections.Counter(map(tuple, rows)) == brute_lines(lined, min_docs)


def test_line_query(spark, lined, tmp_path):
    unique = list({k: (k, t) for k, t in lined}.values())
    table(spark, unique).write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter(map(tuple, queries.op13_line_dedup(spark, str(tmp_path)).collect()))
    assert got == collections.Counter((k, n, d, hashlib.sha256(t.encode()).hexdigest()) for k, n, d, t in brute_lines(unique).elements())


def test_no_lines(spark):
    assert lines.dedup_lines(table(spark, [])).count() == 0


def test_queries_of_this_round_on_the_smallest_tables(spark):
    for name in ("op11_spelling_variants", "op12_centroid_clustering", "op13_line_dedup"):
        out = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert out.agg(F.count(F.lit(1))).first()[0] > 0 and name in queries.ORACLES


# Names of the operators' own in the input


def test_columns_of_any_name_stay(spark):
    names = ["_part", "_rank", "_key", "_piece", "_at", "_place", "_ends", "_before", "_row", "_n", "_t1", "_t2", "_spans", "_first", "_copy", "_done", "_text", "_digest", "row", "digest", "Kept", "SLOT", "N_pieces"]
    same = "a passage of more than fifty bytes that both of the documents have in common"
    rows = [(k, t, *[f"{c}{k}" for c in names]) for k, t in ((1, same + " one"), (2, "two " + same), (3, None))]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))

    def others(out, replaced):
        stay = [c for c in names if c not in replaced]
        got = {r["doc_id"]: r for r in out.collect()}
        assert all(got[k][c] == f"{c}{k}" for k in (1, 2, 3) for c in stay) and len(got) == 3
        return got

    assert sorted(r["slot"] for r in others(sharding.shard(df, 1), ["SLOT"]).values()) == [0, 1, 2]
    assert sharding.shard(df, 1).columns[:3] == ["doc_id", "text", "_part"]
    cut = others(suffix_dedup.remove_repeats(df), ["Kept"])
    assert bytes(cut[1]["kept"]).decode() == same + " one" and bytes(cut[2]["kept"]) == b"two " and bytes(cut[3]["kept"]) == b""
    coded = others(transducer.encode_digest(df, transducer.Transducer.read("/opt/tokenizers/piece_bpe_32k.model")), ["N_pieces"])
    assert coded[3]["n_pieces"] == 0 and all(r["round_trip"] for r in coded.values())
