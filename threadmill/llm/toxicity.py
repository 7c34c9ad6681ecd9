"""Toxicity from the nearest labelled examples.

Examples and texts are TF-IDF vectors over terms: every whole word, and every word's
stem, its first four letters, beside it.  A text's nearest examples
are found exactly, in an inverted index of blocks of examples.  Rare terms keep
posting lists, which are walked for the terms of the text; terms that very many
examples have keep a row of weights each, and their largest weight in every block.
What the lists gave plus the product with those maxima bounds a text's cosine with
any example of a block, and blocks whose bound is below the text's k-th best cosine
are skipped.  The neighbours vote with weights that fall with distance; the votes
are calibrated on the examples themselves, each left out of its own vote.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import written
from .textbatch import IS_LEAD, IS_SPACE, LOWER, Slice, mix, prefix, slices, span_hash, tidy

#: The bounded sample: at most so many labelled examples of each class are indexed.
#: All else covers every document: each term that an example has is a feature,
#: whatever its document frequency, which is counted over all documents.
EXAMPLES = 2000
#: Code points of a stem.
STEM = 4
NEIGHBOURS = 20
BLOCK = 32
#: Terms that more than this share of the examples have keep rows instead of lists.
ROW_SHARE = 0.08
#: Blocks of the largest bounds that every text looks into first.
FIRST = 4
#: Texts, and postings, that are worked on at once.
_TEXTS, _POSTINGS = 128, 1 << 19
_SLICE = 1 << 18
#: Sums of document frequencies: pieces of the vocabulary, and first-level sums of each.
_PIECES, _SUMS = 16, 16

_PART = ~IS_SPACE
_PART[[c for c in range(128) if not (chr(c).isalnum() or IS_SPACE[c])]] = False


def words_of(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each word, ASCII lower case, and of its stem, and the text they
    are in.  Words end at white space and ASCII punctuation."""
    data = LOWER[s.data]
    full = _PART[data]
    starts = full.copy()
    starts[1:] &= ~full[:-1]
    heads = s.offs[:-1][s.offs[:-1] < s.offs[1:]]
    starts[heads] = full[heads]
    start = np.flatnonzero(starts)
    stop = np.flatnonzero(~full)
    end = np.append(stop, len(data))[np.searchsorted(stop, start)]
    text = s.text_of(start)
    end = np.minimum(end, s.offs[text + 1])
    lead = np.append(np.flatnonzero(IS_LEAD[data]), np.full(STEM + 1, len(data)))
    stem = np.minimum(lead[np.minimum(np.searchsorted(lead, start) + STEM, len(lead) - 1)], end)
    pre = prefix(data.astype(np.uint64) + np.uint64(0x51ED27))
    return np.concatenate([span_hash(pre, start, end), mix(span_hash(pre, start, stem))]), np.concatenate([text, text])


def counts(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, term and how often the text has it, for every pair that occurs."""
    key, text = words_of(s)
    order = np.lexsort((key, text))
    key, text = key[order], text[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], key[at], np.diff(np.append(at, len(key)))


def _spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each start on, count of each."""
    return np.arange(int(count.sum())) + np.repeat(start - (np.cumsum(count) - count), count)


@dataclass
class Index:
    """What the scoring tasks need; it holds the terms of 2 * EXAMPLES texts at most.

    Tasks receive counts only, a few bytes for each term of an example; weights, and
    the rows of frequent terms, are made from them on arrival.
    """

    vocabulary: np.ndarray  # sorted term hashes
    idf: np.ndarray
    doc_id: np.ndarray
    label: np.ndarray
    first: np.ndarray  # where each term's postings begin, and the end of the last
    who: np.ndarray  # postings: example and count
    tf: np.ndarray
    norm: np.ndarray  # of each example
    slope: float = 1.0
    offset: float = 0.0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("weight", "row", "rows", "row_max")}

    @cached_property
    def weight(self) -> np.ndarray:
        term = np.repeat(np.arange(len(self.vocabulary)), np.diff(self.first))
        return (1 + np.log(self.tf.astype(float))) * self.idf[term] / self.norm[self.who]

    @cached_property
    def row(self) -> np.ndarray:
        """Of each term, its row, or -1."""
        often = np.flatnonzero(np.diff(self.first) > max(BLOCK, ROW_SHARE * len(self.label)))
        row = np.full(len(self.vocabulary), -1, np.int32)
        row[often] = np.arange(len(often))
        return row

    @cached_property
    def rows(self) -> np.ndarray:
        """Frequent terms x examples."""
        often = np.flatnonzero(self.row >= 0)
        count = (self.first[often + 1] - self.first[often]).astype(np.int64)
        at = _spans(self.first[often], count)
        rows = np.zeros((len(often), len(self.label)))
        rows[np.repeat(np.arange(len(often)), count), self.who[at]] = self.weight[at]
        return rows

    @cached_property
    def row_max(self) -> np.ndarray:
        """Frequent terms x blocks."""
        edges = np.arange(0, len(self.label), BLOCK)
        return np.maximum.reduceat(self.rows, edges, axis=1) if len(self.rows) else np.zeros((0, len(edges)))

    def entries(self, s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """text, word number and weight of the known words of a slice's texts, as unit vectors."""
        text, key, tf = counts(s)
        at = np.minimum(np.searchsorted(self.vocabulary, key), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == key
        text, at = text[known], at[known]
        w = (1 + np.log(tf[known])) * self.idf[at]
        norm = np.sqrt(np.bincount(text, w * w, s.n))
        return text, at, w / norm[text]

    def nearest(self, s: Slice, k: int = NEIGHBOURS, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and numbers of each text's k nearest examples, best first.

        Exact.  Ties go to the smaller number; missing ones have cosine -1.  skip:
        an example for each text that does not count as its neighbour.
        """
        best, who = np.full((s.n, k), -1.0), np.full((s.n, k), len(self.label))
        text, word, w = self.entries(s)
        size = np.where(self.row[word] < 0, self.first[word + 1] - self.first[word], 0)
        done = np.append(0, np.cumsum(size))
        begin = np.searchsorted(text, np.arange(s.n + 1))
        i = 0
        while i < s.n:
            j = min(i + _TEXTS, s.n, int(np.searchsorted(done[begin[1:]], done[begin[i]] + _POSTINGS, side="right")))
            j = max(j, i + 1)
            e = slice(begin[i], begin[j])
            best[i:j], who[i:j] = self._nearest(j - i, text[e] - i, word[e], w[e], size[e], k, None if skip is None else skip[i:j])
            i = j
        return best, who

    def _nearest(self, m, text, word, w, size, k, skip):
        n = len(self.label)
        k_ = min(k, n)
        edges = np.arange(0, n, BLOCK)
        lists = _spans(self.first[word], size)
        cell = np.repeat(text * n, size) + self.who[lists]
        part = np.bincount(cell, np.repeat(w, size) * self.weight[lists], m * n).reshape(m, n)
        q = np.zeros((m, len(self.rows)))
        often = self.row[word] >= 0
        q[text[often], self.row[word[often]]] = w[often]
        bound = np.maximum.reduceat(part, edges, axis=1) + q @ self.row_max
        cosine = np.full((m, n), -1.0)

        def look(live: np.ndarray) -> None:
            for b in np.flatnonzero(live.any(axis=0)):
                t, e = np.flatnonzero(live[:, b]), slice(edges[b], edges[b] + BLOCK)
                cosine[t, e] = np.round(part[t, e] + q[t] @ self.rows[:, e], 12)
            if skip is not None:
                cosine[np.arange(m), skip] = -1.0

        deep = min(len(edges), max(FIRST, -(-k_ // BLOCK)))
        seen = np.zeros(bound.shape, bool)
        np.put_along_axis(seen, np.argpartition(-bound, deep - 1, axis=1)[:, :deep], True, axis=1)
        look(seen)
        worst = np.partition(cosine, n - k_, axis=1)[:, n - k_]
        look(~seen & (bound >= worst[:, None] - 1e-9))
        worst = np.partition(cosine, n - k_, axis=1)[:, n - k_]
        t, e = np.nonzero(cosine >= np.maximum(worst, -0.5)[:, None])
        c = cosine[t, e]
        order = np.lexsort((e, -c, t))
        t, e, c = t[order], e[order], c[order]
        place = np.arange(len(t)) - np.searchsorted(t, t)
        top = place < k_
        best, who = np.full((m, k), -1.0), np.full((m, k), n)
        best[t[top], place[top]], who[t[top], place[top]] = c[top], e[top]
        return best, who

    def votes(self, best: np.ndarray, who: np.ndarray) -> np.ndarray:
        """The share of the toxic among the neighbours, weighted by 1 / distance."""
        there = best > 0
        weight = np.where(there, 1.0 / (1e-3 + np.sqrt(np.maximum(0, 2 - 2 * best))), 0.0)
        toxic = np.append(self.label, 0)[who]
        total = weight.sum(axis=1)
        # Without any neighbour the vote is that of the class shares.
        return np.where(total > 0, (weight * toxic).sum(axis=1) / np.where(total > 0, total, 1), np.nan)

    def score(self, vote: np.ndarray, prior: float) -> np.ndarray:
        z = self.slope * np.nan_to_num(vote) + self.offset
        return np.where(np.isnan(vote), prior, 1 / (1 + np.exp(-np.clip(z, -60, 60))))


def _calibrate(vote: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression of the label on the vote, by Newton steps."""
    x = np.stack([vote, np.ones_like(vote)], axis=1)
    w = np.zeros(2)
    ridge = np.diag([1e-4, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (label - p)) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", toxic: str = "toxic", examples: int = EXAMPLES) -> tuple[Index | None, float]:
    """The index of a bounded sample of labelled rows for which ``learn`` holds, and
    the share of toxic rows among all of those.

    Up to ``examples`` rows of each class are drawn by a seeded hash of the key;
    all of them where there are fewer.  Rows with a null key or label teach
    nothing; a key that several rows have teaches its smallest text, a key with
    both labels is toxic.  Examples without a word are left out.  Document
    frequencies are counted over all docs.  Without a labelled row of both
    classes, or without a word, there is no index.

    Tasks cut the examples into words and count; the driver receives the examples'
    words, packed, and the frequencies of those words.
    """
    known = labels.where(learn & F.col(key).isNotNull() & F.col(toxic).isin(0, 1)).select(F.col(key).alias("k"), F.col(toxic).cast("int").alias("y"))
    known = known.groupBy("k").agg(F.max("y").alias("y"))
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = shares.get(1, 0) / max(1, sum(shares.values()))
    if len(shares) < 2:
        return None, prior
    draw = F.xxhash64(F.lit(5), F.col("k"))
    sample = known.where("y = 0").orderBy(draw, "k").limit(examples).unionByName(known.where("y = 1").orderBy(draw, "k").limit(examples))
    sample = written(sample, "tox-sample")
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(sample), "k")
    texts = written(texts.groupBy("k", "y").agg(F.min("text").alias("text")), "tox-texts")
    kind = texts.schema["k"].dataType.simpleString()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch["text"]):
                at, word, tf = counts(s)
                cut = np.searchsorted(at, np.arange(s.n + 1))
                rows = [[x[i:j].tobytes() for i, j in zip(cut, cut[1:])] for x in (word, tf.astype(np.int32))]
                part = batch.slice(s.first, s.n)
                yield pa.RecordBatch.from_arrays([part["k"], part["y"], *[pa.array(x, pa.binary()) for x in rows]], ["k", "y", "words", "tf"])

    table = texts.mapInArrow(features, f"k {kind}, y int, words binary, tf binary").where("octet_length(words) > 0").toArrow().sort_by("k")
    if not table.num_rows:
        return None, prior
    word = [np.frombuffer(x, np.uint64) for x in table["words"].to_pylist()]
    at = np.repeat(np.arange(len(word)), [len(x) for x in word])
    word = np.concatenate(word)
    tf = np.frombuffer(b"".join(table["tf"].to_pylist()), np.int32)
    vocabulary, term = np.unique(word, return_inverse=True)
    df, total = _frequencies(docs.select(F.col(text).alias("text")), vocabulary)
    idf = np.log((1 + total) / (1 + df)) + 1
    index = _build(table["k"].to_numpy(), table["y"].to_numpy().astype(np.int64), at, term, tf, vocabulary, idf)

    # Calibration: every example's vote without itself, classes weighted to their shares.
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        number = {k: i for i, k in enumerate(ix.doc_id.tolist())}
        for batch in batches:
            ks = batch["k"].to_pylist()
            known = np.array([i for i, k in enumerate(ks) if k in number], np.int64)
            part = batch.take(pa.array(known))
            own = np.array([number[ks[i]] for i in known], np.int64)
            for s in slices(part["text"]):
                v = ix.votes(*ix.nearest(s, skip=own[s.first : s.first + s.n]))
                yield pa.RecordBatch.from_arrays([pa.array(own[s.first : s.first + s.n]), pa.array(np.nan_to_num(v, nan=prior))], ["i", "vote"])

    done = texts.repartition(16, "k").mapInArrow(vote, "i bigint, vote double").toArrow()
    shared.destroy()
    votes = np.full(len(index.label), prior)
    votes[done["i"].to_numpy()] = done["vote"].to_numpy()
    label = index.label
    weight = np.where(label == 1, prior / max(1, label.sum()), (1 - prior) / max(1, (1 - label).sum())) * len(label)
    index.slope, index.offset = _calibrate(votes, label, weight)
    return index, prior


def _frequencies(texts: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """How many of all texts have each word, and how many texts there are.

    A task sends its counts as _PIECES arrays, which are added up in two steps.
    """
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)
    size = -(-(len(vocabulary) + 1) // _PIECES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        df = np.zeros(size * _PIECES, np.int64)
        for batch in batches:
            df[len(v)] += batch.num_rows
            for s in slices(batch["text"]):
                _, word, _ = counts(s)
                at = np.minimum(np.searchsorted(v, word), len(v) - 1)
                df[: len(v)] += np.bincount(at[v[at] == word], minlength=len(v))
        if df[len(v)]:
            turn = TaskContext.get().partitionId() % _SUMS
            rows = [x.tobytes() for x in df.reshape(_PIECES, size)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(_PIECES, dtype=np.int32)), pa.array(np.full(_PIECES, turn, np.int32)), pa.array(rows, pa.binary())], ["piece", "turn", "df"])
        tidy()

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for x in table["df"]:
            total += np.frombuffer(x.as_buffer(), np.int64)
        return pa.table({"piece": table["piece"].slice(0, 1), "turn": table["turn"].slice(0, 1), "df": pa.array([total.tobytes()], pa.binary())})

    kind = "piece int, turn int, df binary"
    sums = texts.mapInArrow(count, kind).groupBy("piece", "turn").applyInArrow(add, kind).groupBy("piece").applyInArrow(add, kind)
    sums = sums.collect()
    shared.destroy()
    df = np.zeros((_PIECES, size), np.int64)
    for piece, _, x in sums:
        df[piece] = np.frombuffer(x, np.int64)
    df = df.ravel()
    return df[: len(vocabulary)], int(df[len(vocabulary)])


def _build(ids: np.ndarray, label: np.ndarray, at: np.ndarray, term: np.ndarray, tf: np.ndarray, vocabulary: np.ndarray, idf: np.ndarray) -> Index:
    """The index of the examples' entries: example, place in the vocabulary, count."""
    n = len(ids)
    value = (1 + np.log(tf)) * idf[term]
    norm = np.sqrt(np.bincount(at, value**2, n))
    value /= norm[at]
    # Like examples share a block, so that its maxima bound them closely: those with
    # the same nearest of a few seeded examples, by their product with it.
    rng = np.random.default_rng(3)
    near = np.zeros((n, min(16, n)))
    for j, pivot in enumerate(rng.choice(n, near.shape[1], replace=False)):
        side = np.zeros(len(vocabulary))
        side[term[at == pivot]] = value[at == pivot]
        near[:, j] = np.bincount(at, value * side[term], n)
    order = np.lexsort((np.arange(n), near.max(axis=1), near.argmax(axis=1)))
    at = np.argsort(order)[at]
    by_term = np.lexsort((at, term))
    first = np.append(0, np.cumsum(np.bincount(term, minlength=len(vocabulary))))
    small = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return Index(vocabulary, idf, ids[order], label[order], first, small(at[by_term]), small(tf[by_term]), norm[order])


def score(docs: DataFrame, index: Index | None, prior: float, text: str = "text", evidence: int = 3) -> DataFrame:
    """docs with ``score`` (0 to 1), ``predicted`` and, unless it is 0, ``evidence``.

    evidence: keys, labels and cosines of so many nearest examples.  Null and empty
    texts, and texts without a known word, score the share of toxic labels.  With
    no index (no label to learn from) every text scores it.  Rows are scored one
    by one; repeated rows score alike, other columns stay.  Columns of the new
    names are replaced.
    """
    found = "array<struct<example:bigint,label:int,cosine:double>>"
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    if index is None:
        more = {"evidence": F.array().cast(found)} if evidence else {}
        return docs.withColumns({"score": F.lit(float(prior)), **more}).withColumn("predicted", predicted)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    docs = docs.drop("score", "predicted", *["evidence"] * bool(evidence))
    plain = docs.columns
    one = pa.struct([("example", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())])
    fields = StructType.fromDDL(f"score double, evidence {found}" if evidence else "score double").fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            for s in slices(batch[text], _SLICE):
                best, who = ix.nearest(s)
                columns = [batch[c].slice(s.first, s.n) for c in plain]
                columns.append(pa.array(np.round(ix.score(ix.votes(best, who), prior), 9)))
                if evidence:
                    there = best[:, :evidence] > 0  # the first of each row, as the best come first
                    which = who[:, :evidence][there]
                    why = [pa.array(ix.doc_id[which].astype(np.int64)), pa.array(ix.label[which].astype(np.int32)), pa.array(best[:, :evidence][there])]
                    cuts = np.append(0, np.cumsum(there.sum(axis=1))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays(why, fields=list(one))))
                yield pa.RecordBatch.from_arrays(columns, [*plain, *[f.name for f in fields]])
        tidy()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *fields])).withColumn("predicted", predicted)


def held_out(key: Column) -> Column:
    """Rows whose CRC-32 of the key as text is divisible by 5; they teach nothing."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))
