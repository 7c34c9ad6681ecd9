"""Full text search by a positional index: its table, its query language, its rank.

The index is a table of postings (a term, its documents and its positions in each) in
buckets of terms, so a query reads the buckets of its terms.  Changed documents are
appended as a generation; what older generations say of them no longer counts.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import small

BUCKETS = 64
#: Tasks that share a bucket when it is written, so that a term of every document is not one task's.
SALTS = 16
#: Characters of text that a task inverts at once, and pairs of words that it weighs at once.
SLICE_CHARS = 1 << 24
PAIRS = 1 << 21

# The rank's constants, as the database documents them: the weight of an unlabelled
# word, the limit of 1 + 1/4 + 1/9 ..., the farthest distance that counts, and the rank
# of a match without any pair of words.
WEIGHT = 0.1
SQUARES = 1.64493406685
FARTHEST = 100
NO_PAIR = 1e-20


@dataclass(frozen=True)
class Unit:
    """Words next to each other in this order; one word is a unit too."""

    terms: tuple[str, ...]
    negated: bool = False


def websearch(query: str) -> list[list[Unit]]:
    """A query as alternatives of units that must all hold.

    Words must all be there; a quoted text, or a word with inner punctuation, is a
    phrase; ``or`` between words starts another alternative and binds weaker than
    standing side by side; a leading ``-`` negates a word or a quoted text.  What
    has neither letter nor digit says nothing, nor does an ``or`` with nothing
    on one side.
    """
    out: list[list[Unit]] = [[]]
    for minus, quoted, word in re.findall(r'(-?)"([^"]*)"?|([^\s"]+)', query):
        if word.lower() == "or":
            out.append([])
            continue
        minus, body = (minus, quoted) if not word else (word[:1] if word[:1] == "-" else "", word)
        terms = tuple(re.findall(r"[^\W_]+", body.lower()))
        if terms:
            out[-1].append(Unit(terms, minus == "-"))
    return [units for units in out if units]


def term_bucket(term: Column) -> Column:
    return (F.crc32(term) % BUCKETS).cast("int")


def terms_of(text: str) -> list[str]:
    """Lower-case runs of letters and digits."""
    return re.findall(r"[^\W_]+", text.lower())


def _planes(x: np.ndarray) -> bytes:
    """The bytes of 32-bit numbers, first all lowest ones: small numbers compress."""
    return np.ascontiguousarray(x, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(x: pa.Scalar) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x.as_buffer(), np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def _packed(terms: pa.Array, start: np.ndarray, docs: pa.Array, first: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Postings as rows: terms begin at start among the documents, documents at first
    among the positions.  Of positions the steps are kept."""
    counts = np.diff(np.append(first, len(at)))
    steps = np.diff(at, prepend=at.dtype.type(0))
    steps[first] = at[first]
    cuts, ends = np.append(start, len(first)), np.append(first, len(at))
    n_docs = pa.array([_planes(counts[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())
    places = pa.array([_planes(steps[ends[a] : ends[b]]) for a, b in zip(cuts, cuts[1:])], pa.binary())
    return pa.RecordBatch.from_arrays([terms, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), docs), n_docs, places], ["term", "docs", "counts", "places"])


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each term of some whole texts: its documents and its positions in each."""

    def row(docs: list, codes: list[np.ndarray], terms: dict[str, int]) -> pa.RecordBatch:
        sizes = np.array([len(c) for c in codes])
        doc = np.repeat(np.arange(len(codes), dtype=np.int32), sizes)
        at = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        code = np.concatenate(codes)
        order = np.argsort(code, kind="stable")  # documents and positions stay in order
        code, doc, at = code[order], doc[order], at[order]
        del order
        first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])))
        start = np.flatnonzero(np.append(True, code[first][1:] != code[first][:-1]))
        return _packed(pa.array(list(terms), pa.string()), start, pa.array(docs).take(pa.array(doc[first])), first, at)

    # Words are numbers from the start: a slice holds each of its terms once.
    docs, codes, terms, chars = [], [], {}, 0
    for batch in batches:
        for doc, text in zip(batch["doc"], batch["text"]):
            found = terms_of(text.as_py() or "")
            if not found:
                continue
            docs.append(doc.as_py())
            codes.append(np.fromiter((terms.setdefault(t, len(terms)) for t in found), np.int32, len(found)))
            chars += sum(map(len, found))
            if chars >= SLICE_CHARS:
                yield row(docs, codes, terms)
                docs, codes, terms, chars = [], [], {}, 0
    if docs:
        yield row(docs, codes, terms)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of term, doc and positions, sorted by term, as rows of postings."""
    for batch in batches:
        if batch.num_rows:
            term, lists = batch["term"], batch["positions"]
            start = np.flatnonzero(np.append(True, np.asarray(pa.compute.not_equal(term.slice(1), term.slice(0, len(term) - 1)))))
            first = np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()
            yield _packed(term.take(pa.array(start)), start, batch["doc"], first, np.asarray(lists.flatten()).astype(np.int64))


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each term and document, with its positions."""
    for batch in batches:
        for i in range(batch.num_rows):
            counts, steps = _numbers(batch["counts"][i]), _numbers(batch["places"][i])
            ends = np.append(0, np.cumsum(counts))
            total = np.cumsum(steps)
            at = total - np.repeat(total[ends[:-1]] - steps[ends[:-1]], counts)
            n = len(counts)
            same = [pa.array([batch[c][i].as_py()] * n, batch.schema.field(c).type) for c in ("term", "gen")]
            yield pa.RecordBatch.from_arrays([*same, batch["docs"][i].values, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32()))], ["term", "gen", "doc", "positions"])


def _put(docs: DataFrame, key: str, text: str, path: str, gen: int) -> None:
    """The postings of docs as generation gen: inverted where they are, then moved once,
    to their terms' buckets."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(_invert, _schema(kind))
    _write(rows.withColumn("bucket", term_bucket(F.col("term"))).repartition("bucket", F.pmod(F.xxhash64(F.get("docs", F.lit(0))), F.lit(SALTS))), f"{path}/postings/gen={gen}")


def _schema(kind: str) -> str:
    return f"term string, docs array<{kind}>, counts binary, places binary"


def _write(rows: DataFrame, path: str) -> None:
    rows.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode("overwrite").parquet(path)


def build(docs: DataFrame, key: str, text: str, path: str) -> None:
    """The index of docs (whose keys are distinct and not null) in a new folder."""
    _put(docs, key, text, path, 0)
    docs.select(F.col(key).alias("doc"), F.lit(True).alias("live")).write.mode("overwrite").parquet(f"{path}/docs/gen=0")


def _last(listed: DataFrame) -> int:
    """The newest generation that has documents; the first may have none."""
    return listed.agg(F.max("gen")).first()[0] or 0


def upsert(spark: SparkSession, path: str, changed: DataFrame, deleted: DataFrame | None, key: str, text: str) -> None:
    """New and changed documents, and keys of deleted ones, as the next generation.

    Only their postings are written.  The generation counts once its list of
    documents is there, which is written last: a run that was broken off leaves
    nothing that a search would see, and the next one replaces what it left.
    A key that is both changed and deleted is deleted.
    """
    gen = _last(spark.read.parquet(f"{path}/docs")) + 1
    if deleted is not None:
        changed = changed.join(deleted.select(key), key, "left_anti")
    _put(changed, key, text, path, gen)
    listed = changed.select(F.col(key).alias("doc"), F.lit(True).alias("live"))
    if deleted is not None:
        listed = listed.unionByName(deleted.select(F.col(key).alias("doc"), F.lit(False).alias("live")).distinct())
    listed.write.mode("overwrite").parquet(f"{path}/docs/gen={gen}")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc and gen of every document that is there, gen being its newest generation."""
    rows = spark.read.parquet(f"{path}/docs").groupBy("doc").agg(F.max(F.struct("gen", "live")).alias("last"))
    return rows.where("last.live").select("doc", F.col("last.gen").alias("gen"))


def postings(spark: SparkSession, path: str, terms: list[str] | None = None) -> DataFrame:
    """term, doc and positions as they are now: of some terms from their buckets only."""
    listed = spark.read.parquet(f"{path}/docs")
    kind = listed.schema["doc"].dataType.simpleString()
    rows = spark.read.schema(f"{_schema(kind)}, gen int, bucket int").parquet(f"{path}/postings")
    if terms is not None:
        buckets = sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})
        rows = rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
    last = _last(listed)
    rows = rows.where(F.col("gen") <= last).select("term", "gen", "docs", "counts", "places")
    rows = rows.mapInArrow(_unpack, f"term string, gen int, doc {kind}, positions array<int>")
    if last:
        newer = listed.where("gen > 0").groupBy("doc").agg(F.max("gen").alias("newest"))
        rows = rows.join(small(newer), "doc", "left").where("newest is null or gen = newest")
    return rows.select("term", "doc", "positions")


def compact(spark: SparkSession, path: str, to: str) -> None:
    """The index as it is now, as the first generation of a new folder."""
    rows = postings(spark, path)
    kind = rows.schema["doc"].dataType.simpleString()
    rows = rows.repartition(term_bucket(F.col("term")), F.pmod(F.xxhash64("doc"), F.lit(SALTS))).sortWithinPartitions("term", "doc")
    _write(rows.mapInArrow(_pack, _schema(kind)).withColumn("bucket", term_bucket(F.col("term"))), f"{to}/postings/gen=0")
    documents(spark, path).select("doc", F.lit(True).alias("live")).write.parquet(f"{to}/docs/gen=0")


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x + by)


def _holds(unit: Unit, at: dict[str, Column]) -> Column:
    """Whether a document has the unit: the places of its words, moved back to the
    first, have one in common."""
    places = at[unit.terms[0]]
    for k, term in enumerate(unit.terms[1:], 1):
        places = F.array_intersect(places, _moved(at[term], -k))
    there = F.coalesce(F.size(places) > 0, F.lit(False)) if len(unit.terms) > 1 else places.isNotNull()
    return ~there if unit.negated else there


def _rank_any(at: list[Column]) -> Column:
    """Each word's occurrences count 1, 1/4, 1/9, ...; the mean over the query's words."""
    sums = [F.coalesce(F.aggregate(F.sequence(F.lit(1), F.size(p)), F.lit(0.0), lambda s, j: s + 1 / (j * j).cast("double")), F.lit(0.0)) for p in at]
    return sum(sums[1:], sums[0]) * WEIGHT / SQUARES / len(at)


def _rank_all(at: list[Column]) -> Column:
    """The nearer two different words stand, the more they weigh; weights add up as
    1 - (1 - a)(1 - b).  Pairs farther apart than FARTHEST weigh as good as nothing
    each and are counted, so the work grows with the near pairs only."""
    distance = np.arange(FARTHEST + 1)
    logs = np.log1p(-WEIGHT * np.sqrt(1 / (1.005 + 0.05 * np.exp(distance / 1.5 - 2))))
    far = np.log1p(-WEIGHT * 1e-15)

    def near(p: np.ndarray, q: np.ndarray, text: np.ndarray, out: np.ndarray) -> None:
        """Adds the weights of pairs to out; p and q ascend, texts far from each other."""
        low, high = np.searchsorted(q, p - FARTHEST), np.searchsorted(q, p + FARTHEST, "right")
        n = high - low
        for a, b in _spans(n, PAIRS):
            each = n[a:b]
            other = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - low[a:b], each)
            gap = np.abs(np.repeat(p[a:b], each) - q[other])
            np.add.at(out, np.repeat(text[a:b], each), np.where(gap > 0, logs[gap], 0) - far)

    def rank(words: pd.DataFrame) -> pd.Series:
        out, pairs = np.zeros(len(words)), np.zeros(len(words))
        flat = []
        for c in words:
            n = np.array([0 if x is None else len(x) for x in words[c]], np.int64)
            places = np.concatenate([np.zeros(0, np.int64), *[x for x in words[c] if x is not None]]).astype(np.int64)
            text = np.repeat(np.arange(len(words)), n)
            flat.append((places + (text << 40), text, n))
        for (p, text, n), (q, _, m) in itertools.combinations(flat, 2):
            near(p, q, text, out)
            out += n * m * far
            pairs += n * m
        return pd.Series(np.where(pairs > 0, -np.expm1(out), NO_PAIR))

    return F.pandas_udf(rank, "double")(F.struct(*at))


def _spans(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cuts of n whose sums are at most ``most``, or single ones."""
    total, a = np.cumsum(n), 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def search(spark: SparkSession, path: str, query: str) -> DataFrame:
    """doc and rank of every document that the query of ``websearch`` describes.

    One aggregation brings the places of the query's words in a document together;
    everything else is an expression on them.  Alternatives of negations only hold
    in documents without any of the words, too.
    """
    alternatives = websearch(query)
    terms = sorted({t for units in alternatives for u in units for t in u.terms})
    if not terms:
        return documents(spark, path).where("false").select("doc", F.lit(0.0).alias("rank"))
    rows = postings(spark, path, terms).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("words"))
    if any(all(u.negated for u in units) for units in alternatives):
        rows = documents(spark, path).select("doc").join(rows, "doc", "left")
    rows = rows.select("doc", *[F.try_element_at("words", F.lit(t)).alias(f"p{i}") for i, t in enumerate(terms)])
    at = {t: F.col(f"p{i}") for i, t in enumerate(terms)}
    fits = F.lit(False)
    for units in alternatives:
        every = F.lit(True)
        for u in units:
            every = every & _holds(u, at)
        fits = fits | every
    one = alternatives[0]
    joined = len(alternatives) == 1 and (len(one) > 1 or len(one[0].terms) > 1 and not one[0].negated)
    rank = _rank_all(list(at.values())) if joined and len(terms) > 1 else _rank_any(list(at.values()))
    return rows.where(fits).select("doc", rank.alias("rank"))


def ranked(hits: DataFrame, limit: int) -> DataFrame:
    """doc, rank and place (1 is the best; of equal ranks the smaller doc first)."""
    from pyspark.sql import Window

    top = hits.orderBy(F.desc("rank"), "doc").limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rank"), "doc")))


def keyword_search(spark: SparkSession, path: str, docs: DataFrame, key: str, text: str, newest: str, query: str, limit: int) -> DataFrame:
    """doc, rank and place: what the query describes; if nothing, and it has two words
    of two characters or more, what has any of these; if nothing again, the newest
    texts that hold the query as it is.  Only the last step reads texts."""
    strict = search(spark, path, query)
    if not strict.isEmpty():
        return ranked(strict, limit)
    words = [w for w in (re.sub("[\"']", "", w) for w in query.split()) if len(w) > 1]
    if len(words) > 1:
        loose = search(spark, path, " OR ".join(words))
        if not loose.isEmpty():
            return ranked(loose, limit)
    from pyspark.sql import Window

    found = docs.where(F.contains(F.lower(text), F.lit(query.lower()))).select(F.col(key).alias("doc"), F.col(newest).alias("new"))
    late = [F.desc_nulls_last("new"), F.asc("doc")]
    found = found.orderBy(*late).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*late)))
    return found.select("doc", F.lit(0.0).alias("rank"), "place")
