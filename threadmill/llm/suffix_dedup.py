"""Removing long passages that an earlier document has, by column-wise suffix sorting.

A byte goes if it stands in a string of ``length`` bytes that also begins in a
document with a smaller key.  Suffixes are sorted the way multi-document
Burrows-Wheeler constructions do it: a collection of strings is read column by
column from its end, each round puts one symbol in front of every string's
suffix, and the new order and the new common prefixes follow from the last
round's by a stable sort on that symbol.  Two neighbours whose common prefix has
``length`` bytes are the same passage.

The corpus is not one such collection but many: every string of ``length`` bytes
holds a minimizer (the smallest hash among its k-byte strings), equal strings
hold equal ones at equal places, and so each collection is what surrounds the
occurrences of one minimizer.  Minimizers of a single document are done with
before any text moves.  Spark's sorted shuffle partitions are the sequential
files; a task streams through them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import numbers, planes, runs
from .shared import release, written
from .textbatch import Slice, mix, powers, slices, tidy

LENGTH = 50
K = 20
#: Occurrences of a minimizer (some 16 MB of contexts) that one task sorts together.
#: Of more, equal contexts
#: are one first, and what is left compares the bytes of its windows in a
#: distributed aggregation.
CROWD = 200_000
#: Minimizers that a task sorts and packs at once, and that meet in one group of the
#: shuffle, about.
PACK = 1 << 18
BUCKET = 1 << 17
BROADCAST_ROWS = 1_000_000
#: Minimizers are dealt to so many rounds by their hash, so that only one round's
#: contexts stand on disk beside the texts they were cut from.
ROUNDS = 2
_CHUNK = 30_000
_U = np.uint64
_NONE = _U(0xFFFFFFFFFFFFFFFF)


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over every w neighbours of x."""
    size = 1
    while 2 * size <= w:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def minimizers(s: Slice, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and place in its text of every minimizer of a window of ``length`` bytes."""
    n, w = len(s.data), length - k + 1
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, down = powers(n + 1)
    h = mix((s.pre[k:] - s.pre[:-k]) * down[: n - k + 1])
    room = np.repeat(s.offs[1:], np.diff(s.offs)) - np.arange(n)  # bytes to the text's end
    h[room[: n - k + 1] < k] = _NONE
    low = _sliding(h, w, np.minimum)
    low[room[: len(low)] < length] = 0  # windows that would leave their text
    pad = np.zeros(w - 1, np.uint64)
    high = _sliding(np.concatenate([pad, low, pad]), w, np.maximum)
    at = np.flatnonzero((high == h) & (h != _NONE) & (high > 0))
    text = s.text_of(at)
    return h[at], text, at - s.offs[text]


def sort_columns(symbols: np.ndarray, group: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each string that an earlier document of its group has.

    symbols: a row for each string, -1 where its document ends.  group: ascending.
    A window is ``length`` symbols; -1 stands for none.
    """
    rows, width = symbols.shape
    order = np.arange(rows)
    lcp = np.full(rows + 1, width, np.int64)  # of a string and the one before it in order
    lcp[0] = 0
    lcp[1:-1][group[1:] != group[:-1]] = 0
    low, high = np.full(rows, -1, np.int64), np.full(rows, -1, np.int64)
    for c in range(width - 1, -1, -1):
        symbol = symbols[order, c].astype(np.int64)
        key = group[order] * 512 + symbol + 1
        turn = np.argsort(key, kind="stable")
        key = key[turn]
        same = np.flatnonzero((key[1:] == key[:-1]) & (symbol[turn][1:] >= 0)) + 1
        new = np.zeros(rows + 1, np.int64)
        if len(same):
            ends = np.stack([turn[same - 1] + 1, turn[same] + 1], axis=1).ravel()
            new[same] = np.minimum(np.minimum.reduceat(lcp, ends)[::2], length) + 1
        order, lcp = order[turn], np.minimum(new, length + 1)
        if c <= width - length:
            start = np.flatnonzero(lcp[:-1] < length)
            first = np.minimum.reduceat(doc[order], start)
            later = doc[order] > np.repeat(first, np.diff(np.append(start, rows)))
            low[order[later]] = c
            high[order[later]] = np.maximum(high[order[later]], c)
    return low, high


_PACKED = "bucket int, h binary, tid binary, back binary, pos binary"


def _pack(h: np.ndarray, tid: np.ndarray, back: np.ndarray, pos: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket of minimizers, sorted, with the bytes of alike numbers side by side."""
    order = np.argsort(h, kind="stable")
    h, tid, back, pos = h[order], tid[order], back[order], pos[order]
    bucket = (((h >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)
    start, count = runs(bucket)
    cols = [[planes(x[i : i + n]) for i, n in zip(start, count)] for x in (h, tid, back, pos)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[start].astype(np.int32)), *[pa.array(c, pa.binary()) for c in cols]], ["bucket", "h", "tid", "back", "pos"])


def _shared(table: pa.Table) -> pa.Table:
    """The minimizers of one bucket that texts of at least two keys have; each place once."""
    h = numbers(table["h"])
    order = np.argsort(h, kind="stable")
    h = h[order]
    start, count = runs(h)
    more = np.zeros(0, np.int64)
    if len(h):
        key = (numbers(table["tid"], np.int64) - numbers(table["back"], np.int64))[order]
        more = np.flatnonzero(np.repeat(np.minimum.reduceat(key, start) < np.maximum.reduceat(key, start), count))
    h, order = h[more], order[more]
    tid, pos = numbers(table["tid"], np.int64)[order], numbers(table["pos"], np.int64)[order]
    order = np.lexsort((pos, tid, h))
    h, tid, pos = h[order], tid[order], pos[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (tid[1:] != tid[:-1]) | (pos[1:] != pos[:-1])
    h, tid, pos = h[new], tid[new], pos[new]
    start, count = runs(h)
    out = pa.table({"h": h.view(np.int64), "tid": tid, "pos": pos.astype(np.int32), "n": np.repeat(count, count).astype(np.int64)})
    tidy()
    return out


def _near(left: DataFrame, right: DataFrame, on, rows: int, how: str = "inner") -> DataFrame:
    """left joined with a right side of a known number of rows."""
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right.hint("merge"), on, how)


def find_repeats(docs: DataFrame, key: str, text: str, length: int = LENGTH, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(classes, spans): t1, t2, first (the smallest key that has it) and tid of every
    distinct text of at least ``length`` bytes, and tid, start and end of the maximal
    runs of what texts of smaller keys have of it."""
    k = min(k, length)
    around = length - k
    spark = docs.sparkSession
    source = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    source = source.where(F.col("doc").isNotNull() & (F.octet_length("text") >= length))
    found = source.groupBy("t1", "t2").agg(F.min("doc").alias("first"), F.max(F.octet_length("text")).alias("size"))
    # Numbers in the order of keys; back: how many texts of the same key come before.
    found = found.repartitionByRange("first", "t1", "t2").sortWithinPartitions("first", "t1", "t2")
    found = written(found.withColumn("tid", F.monotonically_increasing_id()), "rep-texts")
    lowest = found.groupBy("first").agg(F.min("tid").alias("low"))
    classes = written(found.join(lowest, "first").select("t1", "t2", "first", "size", "tid", (F.col("tid") - F.col("low")).alias("back")), "rep-classes")
    n, size = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ones = classes.select("t1", "t2", F.col("first").alias("doc"), "tid", "back")
    # Only the first document of each text: copies are known to be repeats.
    firsts = _near(source, ones, ["t1", "t2", "doc"], n).select("tid", "back", "text")
    buckets = max(64, int(2 * size / (length - k + 2)) // BUCKET)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            tid, back = np.asarray(batch["tid"]), np.asarray(batch["back"])
            for s in slices(batch["text"]):
                h, at, pos = minimizers(s, length, k)
                held.append((h, tid[s.first + at], back[s.first + at], pos))
                n += len(h)
                if n >= PACK:
                    yield _pack(*map(np.concatenate, zip(*held)), buckets)
                    held, n = [], 0
        if n:
            yield _pack(*map(np.concatenate, zip(*held)), buckets)
        held = []
        tidy()

    marks = firsts.mapInArrow(mark, _PACKED).groupBy("bucket").applyInArrow(_shared, "h bigint, tid bigint, pos int, n bigint")
    marks = written(marks, "rep-minimizers")
    release(spark)

    # What surrounds each occurrence.
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks_ = batch["marks"]
            offs = np.asarray(marks_.offsets) - marks_.offsets[0].as_py()
            inner = marks_.flatten()
            h, pos, count = (np.asarray(inner.field(i)) for i in range(3))
            tid, ord_ = np.asarray(batch["tid"]), np.asarray(batch["tid"]) - np.asarray(batch["back"])
            for s in slices(batch["text"]):
                a, b = offs[s.first], offs[s.first + s.n]
                row = np.repeat(np.arange(s.n), np.diff(offs[s.first : s.first + s.n + 1]))
                for i in range(a, b, _CHUNK):
                    j = min(b, i + _CHUNK)
                    r, p = row[i - a : j - a], pos[i:j].astype(np.int64)
                    at = (s.offs[r] + p - around)[:, None] + np.arange(length + around)[None, :]
                    inside = (at >= s.offs[r][:, None]) & (at < s.offs[r + 1][:, None])
                    body = np.where(inside, s.data[np.clip(at, 0, len(s.data) - 1)], 0)
                    lead = np.minimum(p, around)
                    size = inside.sum(axis=1)
                    cuts = np.append(0, np.cumsum(size)).astype(np.int32)
                    ctx = pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer(cuts), pa.py_buffer(body[inside])])
                    yield pa.RecordBatch.from_arrays([pa.array(h[i:j]), pa.array(count[i:j]), pa.array(tid[s.first + r]), pa.array(ord_[s.first + r]), pa.array(pos[i:j]), pa.array(lead.astype(np.int32)), ctx], ["h", "n", "tid", "ord", "pos", "lead", "ctx"])
        tidy()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            h, doc, pos, lead = (np.asarray(table[c]) for c in ("h", "ord", "pos", "lead"))
            group = np.cumsum(np.append(0, h[1:] != h[:-1]))
            low, high = sort_columns(_matrix(table["ctx"], lead, around, length), group, doc, length)
            hit = np.flatnonzero(low >= 0)
            start = pos[hit].astype(np.int64) - around + low[hit]
            end = pos[hit].astype(np.int64) - around + high[hit] + length
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(table["tid"])[hit]), pa.array(start), pa.array(end)], ["tid", "start", "end"])
        tidy()

    def contexts(some: DataFrame) -> DataFrame:
        lists = some.groupBy("tid").agg(F.collect_list(F.struct("h", "pos", "n")).alias("marks"))
        return firsts.join(lists, "tid").select("tid", "back", "text", "marks").mapInArrow(cut, "h bigint, n bigint, tid bigint, ord bigint, pos int, lead int, ctx binary")

    each = []
    for i in range(ROUNDS):
        few = contexts(marks.where((F.col("n") <= CROWD) & (F.pmod("h", F.lit(ROUNDS)) == i))).repartition("h").sortWithinPartitions("h")
        few = few.select("h", "tid", "ord", "pos", "lead", "ctx").mapInArrow(sort, "tid bigint, start bigint, end bigint")
        each.append(written(few, "rep-round"))
    spans = reduce(DataFrame.unionByName, each)
    # marks holds counts, so whether there is anything crowded is known without the texts.
    crowd = marks.where(F.col("n") > CROWD)
    if not crowd.isEmpty():
        spans = spans.unionByName(_crowded(contexts(crowd), length))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Overlapping and adjacent spans of each text as one."""
        for batch in batches:
            given = batch["spans"]
            inner = given.flatten()
            start, end = (np.asarray(inner.field(i)) for i in range(2))
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(given.offsets)))
            order = np.lexsort((start, row))
            start, end, row = start[order], end[order], row[order]
            far = np.maximum.accumulate(end + (row << 40)) - (row << 40) if len(row) else end
            new = np.append(True, (row[1:] != row[:-1]) | (start[1:] > far[:-1])) if len(row) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            stop = far[np.append(at[1:], len(row)) - 1] if len(row) else far
            yield pa.RecordBatch.from_arrays([batch["tid"].take(pa.array(row[at])), pa.array(start[at]), pa.array(stop)], ["tid", "start", "end"])

    spans = spans.groupBy("tid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = written(spans.mapInArrow(join, "tid bigint, start bigint, end bigint"), "rep-spans")
    release(spark)
    return classes, spans


def _crowded(near: DataFrame, length: int) -> DataFrame:
    """tid, start and end of the windows in contexts of minimizers with very many
    occurrences that a smaller ord has.  Equal contexts, as inside a passage that very
    many texts share, are summed up before any row moves."""
    near = written(near.select("tid", "ord", F.col("pos").cast("long").alias("pos"), F.col("lead").cast("long").alias("lead"), "ctx"), "rep-crowded")
    each = near.groupBy("ctx").agg(F.min("ord").alias("ord"))
    at = F.explode(F.sequence(F.lit(0), F.octet_length("ctx") - length)).alias("at")
    each = each.where(F.octet_length("ctx") >= length).select("ctx", "ord", at)
    each = written(each.select("ctx", "ord", "at", F.substring("ctx", F.col("at") + 1, F.lit(length)).alias("window")), "rep-windows")
    least = each.groupBy("window").agg(F.min("ord").alias("least"))
    known = each.join(least, "window").groupBy("ctx").agg(F.collect_list(F.struct("at", "least")).alias("windows"))
    # Every window holds the minimizer, so what lies between the first and the last goes too.
    hit = F.transform(F.filter("windows", lambda w: w["least"] < F.col("ord")), lambda w: w["at"])
    rows = near.join(known, "ctx").select("tid", (F.col("pos") - F.col("lead")).alias("begin"), hit.alias("hit")).where(F.size("hit") > 0)
    return rows.select("tid", (F.col("begin") + F.array_min("hit")).alias("start"), (F.col("begin") + F.array_max("hit") + length).alias("end"))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of rows sorted by h, cut so that no group is in two of them."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < _CHUNK:
            continue
        table = pa.Table.from_batches(held)
        h = np.asarray(table["h"])
        cut = int(np.searchsorted(h, h[-1]))
        if cut:
            yield table.slice(0, cut)
        held, rows = table.slice(cut).to_batches(), len(h) - cut
    if held:
        yield pa.Table.from_batches(held)


def _matrix(ctx: pa.ChunkedArray, lead: np.ndarray, around: int, length: int) -> np.ndarray:
    """Contexts as rows aligned at their minimizers; -1 outside the document."""
    out = np.full((len(lead), length + around), -1, np.int16)
    for s in slices(ctx, 1 << 40):
        rows = np.repeat(np.arange(s.n), np.diff(s.offs)) + s.first
        cols = np.arange(len(s.data)) - np.repeat(s.offs[:-1], np.diff(s.offs)) + (around - lead)[rows]
        out[rows, cols] = s.data
    return out


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, whole_characters: bool = False) -> DataFrame:
    """docs with ``kept`` (the bytes that stay) and ``removed`` (start and end of
    every maximal run of bytes that go).

    A byte goes if it is covered by a string of ``length`` bytes that also begins
    in a document with a smaller key, judged on the input; matches never cross
    documents.  With whole_characters, characters that a run only touches stay, so
    that ``kept`` is UTF-8 again.  A null text is empty.  Rows with a null key are
    kept whole and are no one's earlier document; rows with equal keys are not
    each other's.  Texts shorter than ``length`` stay.  Columns called kept or
    removed, in any case, are replaced; all others stay, whatever their names.  An
    empty table stays empty.
    """
    given = [c for c in docs.columns if c.lower() not in ("kept", "removed")]
    classes, spans = find_repeats(docs, key, text, length)
    # The other columns travel as one, so that no name of theirs meets one used here.
    others = [c for c in given if c not in (key, text)]
    row = F.struct(*others) if others else F.lit(None)
    docs = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), row.alias("_row"))
    columns = [F.col("_key").alias(c) if c == key else F.col("_text").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in given]
    key, text = "_key", "_text"
    runs_ = spans.groupBy("tid").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    found = classes.join(runs_, "tid", "left").select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.col("first").alias("_first"), "_spans")
    found = written(found, "rep-found")
    size = max(found.count(), spans.count())  # a broadcast needs both few texts and few runs
    rows = _near(docs.withColumns({"_t1": F.xxhash64(text), "_t2": F.xxhash64(F.lit(1), text)}), found, ["_t1", "_t2"], size, "left")
    # A later copy of a text goes as a whole, whatever its first document keeps.
    copy = (F.col(key) > F.col("_first")) & (F.octet_length(text) >= length)
    rows = rows.withColumn("_copy", F.coalesce(copy, F.lit(False)))
    rows = rows.withColumn("_spans", F.when(F.col(key).isNotNull(), F.col("_spans")))

    def cut(batches: Iterator) -> Iterator:
        for texts, span_lists, copies in batches:
            kept, removed = [], []
            for body, found, is_copy in zip(texts, span_lists, copies):
                data = np.frombuffer((body or "").encode(), np.uint8)
                step = np.zeros(len(data) + 1, np.int64)
                if is_copy:
                    step[0] += 1
                elif found is not None:
                    step += np.bincount([x["start"] for x in found], minlength=len(data) + 1)
                    step -= np.bincount([x["end"] for x in found], minlength=len(data) + 1)
                gone = np.cumsum(step[:-1]) > 0
                if whole_characters and gone.any():
                    lead = np.flatnonzero((data & 0xC0) != 0x80)
                    gone = np.repeat(np.logical_and.reduceat(gone, lead), np.diff(np.append(lead, len(data))))
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                kept.append(data[~gone].tobytes())
                removed.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
            yield pd.DataFrame({"kept": pd.Series(kept, dtype=object), "removed": pd.Series(removed, dtype=object)})
        tidy()

    cut.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    done = F.pandas_udf(cut, "kept binary, removed array<struct<start:bigint,end:bigint>>")(F.col(text), F.col("_spans"), F.col("_copy"))
    rows = rows.withColumn("_done", done)
    return rows.select(*columns, F.col("_done.kept").alias("kept"), F.col("_done.removed").alias("removed"))
