"""The operators against brute force, on small tables with every odd kind of row."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadmill.llm import components, mixing, neardup_texts, neardup_vectors, quality, queries, sharding, shared, suffix_dedup, toxicity, transducer, warc, wordpieces
from threadmill.llm.textbatch import slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def prose(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Texts with copies, near copies, shared passages, nulls and long ones."""
    r = random.Random(3)
    out = [prose(r, r.randrange(1, 120)) for _ in range(40)]
    base = out[0] = prose(r, 100)
    for i in range(12):
        words = base.split()
        for _ in range(i % 4):
            words[r.randrange(len(words))] = f"n{i}"
        out.append(" ".join(words))
    passage = prose(r, 30)
    out += [prose(r, 20) + " " + passage + " " + prose(r, 15) for _ in range(10)]
    out += [None, "", "   ", "one", "One", "two words", "a b c", "é ü 漢字 😀\n\ttab", "x" * 3000, ("line of text\n" * 40), "ab" * 400, prose(r, 3000), base, base]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", [None, "b", "a", "é", "a"][i % 5], 0, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1. Sharding


def test_hypergeometric_matrix_has_its_margins():
    rows, shards = [0, 7, 100, 3, 1000], [278, 278, 277, 277]
    m = sharding.communication_matrix(rows, shards, 5)
    assert [sum(x) for x in m] == rows and [sum(x) for x in zip(*m)] == shards


def test_hypergeometric_law():
    r = random.Random(1)
    got = collections.Counter(sharding.hypergeometric(r, 5, 7, 4) for _ in range(40_000))
    from math import comb

    for k in range(5):
        assert abs(got[k] / 40_000 - comb(5, k) * comb(7, 4 - k) / comb(12, 4)) < 0.01


@pytest.mark.parametrize("slot_rows", [1_000_000, 3])
def test_shards_are_even_and_gapless(spark, docs, monkeypatch, slot_rows):
    monkeypatch.setattr(sharding, "SLOT_ROWS", slot_rows)
    both = docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long"))).withColumn("shard", F.lit("old"))
    got = sharding.shard(both, 8).select("shard", "slot", "text", "doc_id").collect()
    by = collections.defaultdict(list)
    for g in got:
        by[g["shard"]].append(g["slot"])
    assert len(got) == both.count() and set(by) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = sharding.shard(both, 8).select("shard", "slot", "text", "doc_id").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))


def test_sharding_query(spark, docs, texts, tmp_path):
    """The columns of the contract, and that the law holds."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in queries.op1_sharding(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"], got[i]["law"], got[i]["grown_shard"]) == (len(b) + 1, zlib.crc32(b), "rows", None)
    slots = collections.defaultdict(list)
    for x in got.values():
        slots[x["shard"]].append(x["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(slots) == 8 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_more_shards_than_rows(spark):
    few = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    got = sharding.shard(few, 5).select("shard", "slot").collect()
    assert len({x["shard"] for x in got}) == 2 and all(x["slot"] == 0 for x in got)

def test_whole_documents_are_sharded(spark, docs, tmp_path, monkeypatch):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    seen, real = [], sharding.shard
    monkeypatch.setattr(sharding, "shard", lambda df, *a: seen.append(df.columns) or real(df, *a))
    got = {x["doc_id"]: (x["size"], x["text_crc32"]) for x in queries.op1_sharding(spark, str(tmp_path)).collect()}
    assert seen == [["doc_id", "text"]]
    body = {x["doc_id"]: (x["text"] or "").encode() for x in docs.collect()}
    assert got == {i: (len(b) + 1, zlib.crc32(b)) for i, b in body.items()}


def test_shard_of_nothing(empty):
    assert sharding.shard(empty, 8).count() == 0


# 2. Near-duplicate embeddings


@pytest.mark.parametrize("cell_rows", [20_000, 30])
def test_vectors_against_brute_force(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(neardup_vectors, "CELL_ROWS", cell_rows)
    r = np.random.default_rng(2)
    base = r.standard_normal((6, 16))
    rows = [(int(i), (base[i % 6] + r.standard_normal(16) * (0.02 * (i % 9))).astype(np.float32).tolist()) for i in range(90)]
    rows += [(90, rows[0][1]), (91, rows[0][1]), (92, [2 * x for x in rows[0][1]]), (93, None), (94, [0.0] * 16), (95, [float("nan")] + [1.0] * 15), (96, [1.0, 2.0]), (97, []), (98, [None] + [1.0] * 15), (None, rows[0][1]), (99, [float("inf")] * 16)]
    df = spark.createDataFrame([(k, v, "x") for k, v in rows], "vec_id long, embedding array<float>, label string")
    got = collections.Counter((x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in neardup_vectors.near_duplicates(df).collect())
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n = len(rows)
    link = collections.defaultdict(set)
    for a, b in itertools.combinations(range(n), 2):
        u, v = rows[a][1], rows[b][1]
        if ok(u) and ok(v) and len(u) == len(v):
            x, y = np.array(u, np.float64), np.array(v, np.float64)
            if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                link[a].add(b), link[b].add(a)
    want = collections.Counter()
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in link[todo.pop()] - seen:
                seen.add(b), todo.append(b)
        keys = [rows[i][0] for i in seen if rows[i][0] is not None]
        c = min(keys) if keys else None
        want[rows[a][0], len(link[a]), c, rows[a][0] is not None and rows[a][0] == c] += 1
    assert got == want


def test_rows_that_pass_a_cell_are_not_dealt_into_pieces(spark, monkeypatch):
    """A cell is split by the homes that a task holds, so copies of a vector do not grow
    with the rows that only pass by (about 500 of 2,000 in the middle, 200 at home)."""
    monkeypatch.setattr(neardup_vectors, "CELL_ROWS", 400)
    pieces, real = [], neardup_vectors.written
    monkeypatch.setattr(neardup_vectors, "written", lambda df, name="table": (pieces.extend(x["pieces"] for x in df.collect()) if name == "vec-cells" else None) or real(df, name))
    x = np.random.default_rng(3).standard_normal((2000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert neardup_vectors.near_duplicates(df).count() == 2000
    assert pieces and max(pieces) == 1


def test_no_vectors(spark):
    assert neardup_vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_shuffle_files_go_once_a_table_is_written(spark):
    def left() -> int:
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum("shuffle_" in files.apply(i).getName() for i in range(files.size()))

    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before = left()
    table = shared.written(df.repartition(3, "k"))
    assert left() <= before and table.count() == 7


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 30)]
    df = spark.createDataFrame(path + star + [(500, 500), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(30)}}


# 3. Token counts


def greedy(word, first, later):
    n = i = 0
    while i < len(word):
        table = first if i == 0 else later
        j = next((j for j in range(len(word), i, -1) if word[i:j] in table), None)
        if j is None:
            return 1
        n, i = n + 1, j
    return n


def test_word_pieces_against_greedy(docs, texts, empty):
    r = random.Random(4)
    first = {bytes(r.choice(b"wn0123x") for _ in range(r.randrange(1, 5))) for _ in range(60)}
    later = {bytes(r.choice(b"0123nxab") for _ in range(r.randrange(1, 5))) for _ in range(60)}
    for f, l in [(first, later), wordpieces.read_vocabulary(MODEL)]:
        got = {x["doc_id"]: x["n_tokens"] for x in wordpieces.token_counts(docs, (f, l)).collect()}
        for i, t in enumerate(texts):
            assert got[i] == sum(greedy(w.encode(), f, l) for w in WORD.findall(t or "")), i
    assert wordpieces.token_counts(empty, (first, later)).count() == 0


def test_word_pieces_against_a_library(texts):
    from tokenizers import Tokenizer, models, pre_tokenizers

    first, later = {"w", "w1", "n", "w12", "one", "x"}, {"0", "1", "2", "3", "12", "123", "n", "xx"}
    vocab = {t: i for i, t in enumerate(["[UNK]", *sorted(first), *("##" + x for x in sorted(later))])}
    t = Tokenizer(models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10**6))
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    a = wordpieces.Automaton({x.encode() for x in first}, {x.encode() for x in later})
    plain = [x for x in texts if x and x.isascii()]
    got = np.concatenate(list(wordpieces.count_slices(a, pa.array(plain, pa.large_string()), wordpieces.Cache())))
    assert got.tolist() == [len(t.encode(x).ids) for x in plain]


# 4. Quality rules


def coverage(text, n):
    words = WORD.findall(text or "")
    seen, all_, later = collections.Counter(), set(), set()
    grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    total = collections.Counter(grams)
    for i, g in enumerate(grams):
        if total[g] > 1:
            all_.update(range(i, i + n))
        if seen[g]:
            later.update(range(i, i + n))
        seen[g] += 1
    return len(all_), sum(len(words[i]) for i in later)


def test_repetition_against_brute_force(docs, texts, empty):
    got = {x["doc_id"]: x["repetition"] for x in quality.repetition_coverage(docs.withColumn("repetition", F.lit(1))).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert got[i]["n_words"] == len(WORD.findall(t))
        assert got[i]["word_chars"] == sum(map(len, WORD.findall(t)))
        assert got[i]["n_dup_lines"] == len(lines) - len(set(lines))
        assert got[i]["n_repeat_words"] == coverage(t, 8)[0]
        for n in quality.NGRAM_LIMITS:
            assert got[i][f"dup_{n}gram_chars"] == coverage(t, n)[1]
    assert quality.quality_rules(empty).count() == 0


# 5. Toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        bad = r.random() < 0.3
        words = prose(r, 40, 60).split()
        if bad:
            for _ in range(4):
                words.insert(r.randrange(40), r.choice(["vile", "nasty", "scum"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    extra = [(600, None), (601, ""), (602, "zzz"), (None, "vile")]
    return spark.createDataFrame(rows + extra, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (1000, 1), (5, None)], "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    out = toxicity.held_out(F.col("doc_id"))
    index, prior = toxicity.train(docs, labels, ~out)
    got = toxicity.score(docs.withColumn("score", F.lit("old")), index, prior).withColumn("held_out", out)
    both = got.join(labels.where("toxic is not null"), "doc_id").where("held_out").toPandas()
    assert (both["predicted"] == both["toxic"]).mean() > 0.95
    odd = {x["doc_id"]: x["score"] for x in got.where("doc_id >= 600 or doc_id is null").collect()}
    assert odd[600] == odd[601] == odd[602] and 0 <= odd[600] <= 1


def brute_cosines(texts, queries, frequencies, total):
    """TF-IDF cosines of queries with texts, by dictionaries."""
    known = {w for t in texts for w in words_in(t)}
    idf = {w: np.log((1 + total) / (1 + frequencies[w])) + 1 for w in known}

    def vector(t):
        tf = collections.Counter(w for w in words_in(t) if w in known)
        v = {w: (1 + np.log(n)) * idf[w] for w, n in tf.items()}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    examples = [vector(t) for t in texts]
    return np.array([[sum(x * e.get(w, 0) for w, x in vector(q).items()) for e in examples] for q in queries])


def words_in(text):
    """Words, and their stems after a mark that no word holds."""
    words = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text.lower())
    return words + ["^" + w[:4] for w in words]


@pytest.mark.parametrize("row_share", [0.08, 2.0])
def test_nearest_votes_and_scores_are_exact(labelled, monkeypatch, row_share):
    monkeypatch.setattr(toxicity, "ROW_SHARE", row_share)
    monkeypatch.setattr(toxicity, "_POSTINGS", 3000)
    docs, labels = labelled
    index, prior = toxicity.train(docs, labels, F.lit(True))
    body = {x["doc_id"]: x["text"] for x in docs.where("doc_id is not null").collect()}
    frequencies = collections.Counter(w for x in docs.collect() for w in set(words_in(x["text"] or "")))
    full = brute_cosines([body[k] for k in index.doc_id.tolist()], [body[i] for i in range(50)], frequencies, docs.count())
    best = np.concatenate([index.nearest(s)[0] for s in slices(pa.array([body[i] for i in range(50)], pa.large_string()))])
    want = -np.sort(-full, axis=1)[:, : toxicity.NEIGHBOURS]
    assert np.allclose(best, want, atol=1e-9)
    got = {x["doc_id"]: x for x in toxicity.score(docs.where("doc_id < 50"), index, prior).collect()}
    for i in range(50):
        order = np.lexsort((np.arange(full.shape[1]), -np.round(full[i], 12)))[: toxicity.NEIGHBOURS]
        near = full[i][order]
        w = np.where(near > 0, 1 / (1e-3 + np.sqrt(np.maximum(0, 2 - 2 * near))), 0)
        vote = (w * index.label[order]).sum() / w.sum()
        assert got[i]["score"] == pytest.approx(1 / (1 + np.exp(-(index.slope * vote + index.offset))), abs=1e-6)
        assert [e["example"] for e in got[i]["evidence"]] == [int(index.doc_id[j]) for j in order[:3]]


def test_rare_toxic_words_are_evidence(spark):
    """30 toxic of 630 examples, whose toxic words two of them share."""
    r = random.Random(4)
    rare = [f"{a}{b}xq" for a in "bcdfg" for b in "aei"]
    texts = [prose(r, 40, 60) for _ in range(600)] + [" ".join([rare[i // 2]] * 8) + " " + prose(r, 10, 12) for i in range(30)]
    unseen = [" ".join([w] * 8) + " " + prose(r, 10, 12) for w in rare]
    docs = spark.createDataFrame(list(enumerate(texts + unseen)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 600)) for i in range(630)], "doc_id long, toxic int")
    index, prior = toxicity.train(docs, labels, F.lit(True))
    got = toxicity.score(docs.where("doc_id >= 630"), index, prior).collect()
    assert all([e["label"] for e in x["evidence"][:2]] == [1, 1] for x in got), got


def test_a_toxic_text_copied_to_a_third_of_the_rows_is_toxic(labelled):
    docs, labels = labelled
    copy = docs.sparkSession.range(1000, 1400).select(F.col("id").alias("doc_id"), F.lit("vile nasty scum vile nasty scum").alias("text"))
    index, prior = toxicity.train(docs.unionByName(copy), labels.where("doc_id < 600"), F.lit(True))
    got = toxicity.score(copy, index, prior).collect()
    assert all(x["predicted"] == 1 and x["evidence"] for x in got)


def test_nothing_to_learn_from(labelled):
    docs, labels = labelled
    index, prior = toxicity.train(docs, labels.where("toxic = 0"), F.lit(True))
    assert index is None and prior == 0
    assert toxicity.score(docs, index, prior).where("predicted = 1").count() == 0


# 6. Web archives


def test_warc_round_trip(spark):
    magic = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n"
    rows = [(1, "u1", "a" * 1500), (2, "u2", magic * 20), (3, "u\r\n3", magic), (4, None, None), (5, "u5", "a" * 1500), (6, "u6", ""), (7, "u7", "é" * 700), (8, "u8", "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"), (9, "u9", "a" * 1500), (None, "n", "z" * 1200), (10, "s", "short"), (11, "s", "short"), (9, "u9", "a" * 1500)]
    rows += [(100 + i, "v", f"w{i} " * 500) for i in range(20)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, offset string").coalesce(2)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).where("intact").collect())
        assert warc.round_trip(df.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    want = collections.Counter()
    for k, _, h in rows:
        b = (h or "").encode()
        tops = [x for x, _, g in rows if x is not None and (g or "").encode() == b]
        again = len(b) >= 1000 and tops and k != max(tops)
        want[k, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", max(tops) if again else None] += 1
    assert got == want


# 7. N-gram Jaccard join


def jaccard_components(texts, words, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(lower))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("words,percent,small", [(4, 85, False), (5, 80, False), (3, 60, True)])
def test_jaccard_against_brute_force(docs, texts, monkeypatch, words, percent, small):
    if small:
        for name in ("PACK", "TOGETHER", "BUCKET", "HUB", "BATCH"):
            monkeypatch.setattr(neardup_texts, name, 2)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup_texts.near_duplicates(docs, words=words, percent=percent).collect()}
    assert got == jaccard_components(texts, words, percent)


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_similar_sets_share_a_signature(percent):
    """The pigeonhole argument, on pairs at the very edge."""
    r = np.random.default_rng(percent)
    bands = neardup_texts.Bands(percent)
    for n in [6, 7, 9, 13, 20, 41, 77, 150, 400, 1000]:
        for _ in range(6):
            both = r.integers(1, 1 << 62, n, dtype=np.uint64)
            extra = n * (100 - percent) // percent
            cut = int(r.integers(0, extra + 1))
            a = np.concatenate([both, r.integers(1, 1 << 62, cut, dtype=np.uint64)])
            b = np.concatenate([both, r.integers(1, 1 << 62, extra - cut, dtype=np.uint64)])
            assert 100 * n >= percent * (n + extra)
            if not extra:
                continue
            h, of, size = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), np.array([len(a), len(b)])
            sig, owner = neardup_texts.signatures(h, of, size, bands)
            shared = np.intersect1d(sig[owner == 0], sig[owner == 1])
            assert len(shared)


def test_jaccard_of_nothing_and_null_keys(spark, empty):
    assert neardup_texts.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (7, "x"), (7, "x"), (None, None)], "doc_id long, text string")
    got = sorted(((x["doc_id"], x["component_id"]) for x in neardup_texts.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 4), (None, 4), (4, 4), (7, 7), (7, 7), (None, None)], key=str)


@pytest.mark.parametrize("percent", [70, 85])
def test_jaccard_of_a_crowded_passage_and_a_large_cluster(spark, percent):
    """A passage in otherwise different texts, and near copies whose similarity lies about the limit."""
    r = random.Random(percent)
    passage = prose(r, 40, 5000)
    texts = [f"{prose(r, r.randrange(5, 60), 5000)} {passage} {prose(r, r.randrange(0, 30), 5000)}" for _ in range(120)]
    base = prose(r, 90, 5000).split()
    for i in range(120):
        words = list(base)
        for _ in range(i % 7):
            words[r.randrange(90)] = f"x{i}y{r.randrange(9)}"
        texts.append(" ".join(words))
    r.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup_texts.near_duplicates(docs, words=4, percent=percent).collect()}
    assert got == jaccard_components(texts, 4, percent)


def test_shingles_move_once_to_be_counted(spark, monkeypatch):
    """Also where no side of a join may be broadcast."""
    plans, keep = {}, neardup_texts.written
    monkeypatch.setattr(neardup_texts, "written", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or keep(df, name))
    monkeypatch.setattr(neardup_texts, "BROADCAST_ROWS", -1)
    r = random.Random(4)
    passage = prose(r, 40, 5000)
    texts = [f"{prose(r, r.randrange(5, 60), 5000)} {passage} {prose(r, r.randrange(0, 30), 5000)}" for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup_texts.near_duplicates(docs, words=4, percent=70).collect()}
    assert got == jaccard_components(texts, 4, 70)
    assert "dup-elements" not in plans and plans["dup-early"].count("hashpartitioning(item") == 1


# 8. Piece encoding


@pytest.fixture(scope="module")
def fst():
    return transducer.Transducer.read(MODEL)


def test_pieces_round_trip(docs, texts, fst, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    coded = transducer.decode(transducer.encode(docs, fst), fst)
    for x in coded.collect():
        assert x["decoded"] == (texts[x["doc_id"]] or "")
        assert library.decode(x["ids"]) == (texts[x["doc_id"]] or "")
    digest = transducer.encode_digest(docs, fst)
    assert digest.where("not round_trip").isEmpty()
    assert transducer.encode(empty, fst).count() == 0


def cheapest(fst, text):
    """ids of the cheapest path by plain dynamic programming, and its cost."""
    b = (" " + text).encode() if text else b""
    spell = [fst.spelling[i:j].tobytes() for i, j in zip(fst.spell_at, fst.spell_at[1:])]
    fallback = {int(i): 0 for i in fst.byte_id}
    by = {}
    for i, x in enumerate(spell):
        if x and i not in fallback:
            by[x] = i
    best, via = [0.0] + [np.inf] * len(b), [None] * (len(b) + 1)
    for e in range(1, len(b) + 1):
        options = [(best[e - 1] + fst.byte_cost, e - 1, int(fst.byte_id[b[e - 1]]))]
        options += [(best[s] + fst.cost[by[b[s:e]]], s, by[b[s:e]]) for s in range(max(0, e - 60), e) if b[s:e] in by]
        best[e], s, i = min(options)
        via[e] = (s, i)
    out, at = [], len(b)
    while at:
        at, i = via[at]
        out.append(i)
    return out[::-1], best[-1]


def test_paths_are_the_cheapest(spark, fst):
    r = random.Random(6)
    letters = "aeinrst  ,.-éß漢😀Z9\n"
    short = ["", " ", "  a", "the the", "don't", "Ünïcödé 漢字 😀", "\x01\x02 x", "a" * 70] + ["".join(r.choices(letters, k=r.randrange(1, 30))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(short)), "i int, text string")
    digest = {x["i"]: x for x in transducer.encode_digest(transducer.encode(docs.withColumn("ids", F.lit(0)), fst), fst).collect()}
    fallback = set(fst.byte_id.tolist())
    for i, t in enumerate(short):
        ids, cost = cheapest(fst, t)
        got = list(digest[i]["ids"])
        spent = sum(fst.byte_cost if x in fallback else fst.cost[x] for x in got)
        assert spent == pytest.approx(cost, abs=1e-6) and (got == ids or len(got) > 1), t
        assert digest[i]["n_pieces"] == len(got) and digest[i]["n_fallback"] == sum(x in fallback for x in got)
        assert digest[i]["ids_crc32"] == zlib.crc32(np.array(got, "<i4").tobytes())


# 9. Suffix-array dedup


def cleaned(rows, length):
    first, out = {}, {}
    for k, t in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first.get(b[i : i + length], k) < k:
                gone[i : i + length] = b"\1" * length
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], k)
        runs = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.setdefault(k, []).append((bytes(c for c, g in zip(b, gone) if not g), runs))
    return out


@pytest.mark.parametrize("crowd,length", [(20_000, 50), (1, 50), (20_000, 17)])
def test_passages_against_brute_force(docs, texts, monkeypatch, crowd, length):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    want = cleaned(list(enumerate(texts)), length)
    got = suffix_dedup.remove_repeats(docs.withColumn("kept", F.lit(1)), length=length).collect()
    assert len(got) == len(texts)
    for x in got:
        assert (bytes(x["kept"]), [(a["start"], a["end"]) for a in x["removed"]]) == want[x["doc_id"]][0], x["doc_id"]


@pytest.mark.parametrize("rounds", [2, 3])
def test_contexts_stand_on_disk_one_round_at_a_time(docs, texts, monkeypatch, rounds):
    names, keep = [], suffix_dedup.written
    monkeypatch.setattr(suffix_dedup, "written", lambda df, name: names.append(name) or keep(df, name))
    monkeypatch.setattr(suffix_dedup, "ROUNDS", rounds)
    want = cleaned(list(enumerate(texts)), 50)
    got = suffix_dedup.remove_repeats(docs).collect()
    assert all(bytes(x["kept"]) == want[x["doc_id"]][0][0] for x in got) and len(got) == len(texts)
    assert names.count("rep-round") == rounds


def test_column_sort_against_brute_force():
    r = np.random.default_rng(0)
    symbols = r.integers(0, 2, (200, 14)).astype(np.int16)
    symbols[r.random(200) < 0.2, 11:] = -1
    group, doc = np.sort(r.integers(0, 5, 200)), r.integers(0, 40, 200)
    low, high = suffix_dedup.sort_columns(symbols, group, doc, 6)
    for i in range(200):
        hits = [c for c in range(9) if (symbols[i, c : c + 6] >= 0).all() and any(group[j] == group[i] and doc[j] < doc[i] and (symbols[j, c : c + 6] == symbols[i, c : c + 6]).all() for j in range(200))]
        assert (low[i], high[i]) == ((hits[0], hits[-1]) if hits else (-1, -1))


def test_passages_of_odd_rows(spark, empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    p = "".join(chr(97 + i * 7 % 26) for i in range(60)) + "é" * 30
    df = spark.createDataFrame([(None, p), (5, p), (5, p), (6, "zz" + p), (7, None), (2, "x" + p[:49])], "doc_id long, text string")
    got = sorted((x["doc_id"] or -1, len(x["kept"])) for x in suffix_dedup.remove_repeats(df).collect())
    n = len(p.encode())
    assert got == [(-1, n), (2, 50), (5, n), (5, n), (6, 2), (7, 0)]
    whole = suffix_dedup.remove_repeats(df, whole_characters=True).collect()
    assert all(bytes(x["kept"]).decode() is not None for x in whole)


# 10. Mixing


@pytest.mark.parametrize("seed", range(6))
def test_fit_budget_is_near(seed):
    r = np.random.default_rng(seed)
    length = np.unique(r.integers(0, 4000, 60))
    count = r.integers(1, 40, len(length))
    budget = int((length * count).sum() * r.random())
    take = mixing.fit_budget(length, count, budget)
    assert ((take >= 0) & (take <= count)).all()
    assert 0 <= budget - int((take * length).sum()) <= 1


@pytest.mark.parametrize("budget", [1, 5_000, 300_000, 2_000_000])
def test_fit_budget_of_any_size_keeps_the_profile(budget):
    r = np.random.default_rng(1)
    length = np.unique(r.integers(1, 3000, 500))
    count = r.integers(1, 9, len(length))
    take = mixing.fit_budget(length, count, budget)
    assert ((take >= 0) & (take <= count)).all() and budget - int((take * length).sum()) <= 1
    if budget > 1_000_000:
        short, share = length < 1500, budget / (length * count).sum()
        assert (take * length)[short].sum() / (count * length)[short].sum() == pytest.approx(share, abs=0.02)


def test_targets_share_the_excess_again(spark):
    r = random.Random(2)
    rows = [(f"s{i:02d}", r.choice([0, 1, 10, 1000, 50_000])) for i in range(40)] + [(None, 7)]
    got = {x["source"]: x["target"] for x in mixing.targets(spark.createDataFrame(rows, "source string, words long").repartition(5)).collect()}
    weight = {s: (5, 2, 1)[k % 3] for k, (s, _) in enumerate(rows)}
    goal, left = {}, dict(rows)
    while left:
        level = (1.5 * sum(w for _, w in rows) - sum(goal.values())) / sum(weight[s] for s in left)
        full = {s: 2.0 * w for s, w in left.items() if level * weight[s] > 2 * w}
        if not full:
            break
        goal |= full
        left = {s: w for s, w in left.items() if s not in full}
    goal |= {s: level * weight[s] for s in left}
    assert got == {s: pytest.approx(g, rel=1e-9) for s, g in goal.items()}


def test_fit_budget_without_a_fit():
    assert mixing.fit_budget(np.array([10, 20]), np.array([1, 1]), 15).tolist() == [1, 0]
    assert mixing.fit_budget(np.array([0, 3]), np.array([5, 0]), 15).tolist() == [0, 0]


@pytest.mark.parametrize("rank_rows", [50_000, 2])
def test_mix(docs, texts, empty, monkeypatch, rank_rows):
    monkeypatch.setattr(mixing, "RANK_ROWS", rank_rows)
    plan = mixing.mix_plan(docs.withColumn("size", F.lit("x")), ["doc_id"])
    got = plan.collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_plan(docs, ["doc_id"]).collect()))
    sizes = {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    source = {i: [None, "b", "a", "é", "a"][i % 5] for i in sizes}
    assert {x["doc_id"]: x["size"] for x in got} == sizes
    names = sorted({s for s in source.values() if s is not None}) + [None]
    words = {s: sum(n for i, n in sizes.items() if source[i] == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, rest, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(words.values()), set(names)
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * words[s]}
        if not full:
            goal.update({s: level * weight[s] for s in open_})
            break
        for s in full:
            goal[s] = 2.0 * words[s]
            rest -= goal[s]
        open_ -= full
    for s in names:
        mine = [x for x in got if source[x["doc_id"]] == s]
        assert abs(mine[0]["target"] - goal[s]) < 1e-6
        assert abs(sum(x["times"] * x["size"] for x in mine) - goal[s]) <= 0.01 * goal[s] + 1  # few documents
        assert all(0 <= x["times"] <= 2 for x in mine)
    assert mixing.mix_plan(empty, ["doc_id"]).count() == 0
