"""The pipeline's stages against brute force, each judged on its own input."""

import random

import pytest
import sentencepiece

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """rows, ids of toxic documents, labels."""
    r = random.Random(3)
    clean, rude = ([f"{a}{i:03d}" for i in range(400)] for a in ("calm", "vile"))
    texts, toxic = {}, set()
    for i in range(160):
        bad = i % 4 == 0
        words = r.choices(rude if bad else clean, k=r.randrange(30, 60))
        texts[i] = " ".join(words)
        if bad:
            toxic.add(i)
    texts[200] = texts[1]  # an exact copy
    texts[201] = texts[2] + " calm999"  # a near copy
    passage = " ".join(r.choices(clean, k=20))
    for i in (202, 203):  # a passage of two documents
        texts[i] = f"{' '.join(r.choices(clean, k=40))} {passage} été {' '.join(r.choices(clean, k=40))}"
    texts |= {204: None, 205: "", 206: "calm"}
    rows = [(i, t, "en", (None if i == 206 else f"s{i % 3}"), len(t or "")) for i, t in texts.items()]
    return rows, toxic, [(i, 1, int(i in toxic)) for i in range(160)]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def survivors(rows):
    """Smallest doc_id of every component of near copies."""
    sets = {row[0]: shingles(row[1]) for row in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


def without_repeats(rows):
    first, out = {}, {}
    bodies = {row[0]: (row[1] or "").encode() for row in rows}
    for i, b in bodies.items():
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    for row in rows:
        i, text = row[0], row[1]
        b, gone = bodies[i], set()
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone.update(range(k, k + 50))
        kept, at = [], 0
        for c in text or "":
            n = len(c.encode())
            if not all(x in gone for x in range(at, at + n)):
                kept.append(c)
            at += n
        out[i] = None if text is None else "".join(kept)
    return out


def mix_targets(rows):
    """Words and target of every source: shares by weight, the excess of full ones shared again."""
    words = {}
    for row in rows:
        words[row[3]] = words.get(row[3], 0) + len((row[1] or "").split())
    names = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    goal, open_ = {}, set(names)
    while True:
        budget = 1.5 * sum(words.values()) - sum(goal.values())
        full = {s for s in open_ if budget * weight[s] / sum(weight[x] for x in open_) > 2 * words[s]}
        if not full:
            break
        goal |= {s: 2.0 * words[s] for s in full}
        open_ -= full
    return words, goal | {s: budget * weight[s] / sum(weight[x] for x in open_) for s in open_}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Name -> (input rows, output rows) of every stage."""
    rows, toxic, labels = corpus()
    folder = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out, docs = {"toxic": toxic}, spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        done = spark.read.parquet(f"{folder}/{k}")
        out[name] = ([tuple(x) for x in docs.collect()], [tuple(x) for x in done.collect()])
        docs = done
    return out


def test_toxic_documents_go_and_clean_ones_stay(stages):
    given, kept = stages["toxicity"]
    assert {x[0] for x in given} - {x[0] for x in kept} == stages["toxic"]


def test_one_of_each_group_of_near_copies_stays(stages):
    given, kept = stages["ngram_jaccard_join"]
    assert sorted(x[0] for x in kept) == sorted(survivors(given))
    assert {200, 201}.isdisjoint(x[0] for x in kept)


def test_repeated_passages_go(stages):
    given, kept = stages["suffix_array_dedup"]
    assert {x[0]: x[1] for x in kept} == without_repeats(given)
    assert all(x[4] == len(x[1] or "") for x in kept) and len(kept) == len(given)


def test_sources_come_near_their_targets(stages):
    given, kept = stages["mixing"]
    words, goal = mix_targets(given)
    taken, times = dict.fromkeys(words, 0), {}
    for x in kept:
        assert x in given
        taken[x[3]] += len(x[1].split())
        times[x[0]] = times.get(x[0], 0) + 1
    assert max(times.values()) <= 2
    longest = max(len((x[1] or "").split()) for x in given)
    assert all(abs(taken[s] - goal[s]) <= longest for s in words)


def test_pieces_decode_to_the_text(stages):
    given, coded = stages["sentencepiece"]
    model = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECE_MODEL)
    want = sorted((x[0], model.decode(model.encode(x[1]))) for x in given)
    assert sorted((x[0], model.decode(list(x[3]))) for x in coded) == want
    assert all(x[2] == len(x[3]) for x in coded)


def test_near_copies_without_unique_ids(spark):
    r = random.Random(8)
    a, b, c = (" ".join(r.choices([f"w{i}" for i in range(400)], k=60)) for _ in range(3))
    texts = [(None, a), (None, a + " x"), (None, b), (None, b + " x"), (7, c), (7, c + " x"), (7, c + " x"), (9, c + " y"), (7, None), (None, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], SCHEMA)
    kept = [(x["doc_id"], x["text"]) for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    groups = [x for x in kept if x[1]]
    assert sorted((i, t[:40]) for i, t in groups if i is None) == sorted((None, t[:40]) for t in (a, b))
    assert [(i, t[:40]) for i, t in groups if i is not None] == [(7, c[:40])]
    assert (7, None) in kept and len(kept) == 5


def test_every_stage_takes_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, extra columns with
    names of the stages' own, and empty tables."""
    r = random.Random(12)
    prose = " ".join(r.choices([f"w{i}" for i in range(900)], k=120))
    long = " ".join(r.choices([f"v{i}" for i in range(5000)], k=30_000)) + " " + "y" * 100_000
    texts = [None, "", " ", prose, prose, prose + " tail", long, "é" * 60, "\n\n"]
    rows = [(i % 5 if i < 7 else None, t, None, ["s", None][i % 2], None, 1, "old") for i, t in enumerate(texts)]
    rows += [(3, prose, None, None, None, 1, "old")] * 3
    docs = spark.createDataFrame(rows, f"{SCHEMA}, size int, score string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    labels = [(0, 1, 0), (1, 1, 1), (None, None, 1), (3, 1, None), (2, 0, 0), (2, 0, 0), (4, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/some/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, f"{tmp_path}/none")
    assert kept.count() == len(rows) and kept.columns == corpus_pipeline.COLUMNS
    assert corpus_pipeline.drop_toxic(spark, docs, f"{tmp_path}/some").columns == corpus_pipeline.COLUMNS
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, "")
        assert out.columns == corpus_pipeline.COLUMNS, name
        got = out.collect()
        assert stage(spark, docs.limit(0), "").count() == 0, name
        if name == "ngram_jaccard_join":
            assert len([x for x in got if x["text"] and x["text"].startswith(prose)]) == 1
            assert len([x for x in got if x["text"] == long]) == 1
        if name == "suffix_array_dedup":
            assert len(got) == len(rows) and sorted(x["doc_id"] or -1 for x in got) == sorted(x[0] or -1 for x in rows)
        if name == "mixing":
            assert all((x["text"] or "").split() for x in got)
    coded = corpus_pipeline.encode(spark, docs, "").collect()
    assert len(coded) == len(rows) and corpus_pipeline.encode(spark, docs.limit(0), "").count() == 0
