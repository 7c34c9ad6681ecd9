"""Near-duplicate texts: an exact Jaccard join of shingle sets by PartEnum signatures.

Two sets whose Jaccard similarity is p % or more differ in few elements: at most
k = (m + n) (100 - p) / (100 + p) for sizes m and n.  Sets are put into bands of
like size; a band has one k.  The domain of shingles is partitioned at random
into first-level parts, and each of these into N2 second-level parts.  As k
differences cannot reach all first-level parts twice, some part has one at most,
and then all but one of its second-level parts are equal.  So the signatures, one
for each first-level part and each of its subsets of N2 - 1 second-level parts,
have at least one in common for every similar pair.

Sets that share a signature are compared with one of them, the one that shares
most signatures, which unites a group of near copies in a pair for each member.
Signatures whose members are still apart after that (a passage that many otherwise
different texts share, near copies of near copies) are not paired out: among their
members a pair must also share one of its rarest shingles, as two sets that overlap
in p % cannot differ in all of the first n - p n / 100 + 1 shingles of any common
order, and the places of that shingle must leave room for the overlap.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .packing import numbers, planes, runs
from .shared import release, written
from .textbatch import LOWER, Slice, mix, prefix, slices, span_hash, tidy

N2 = 3
#: First-level parts beyond k / 2, and one more for so many of k: so many parts of a
#: similar pair have one difference at most.  A set with fewer parts of which a
#: signature covers no shingle at all does without those signatures, which unlike
#: sets share.
SPARE, SPARE_K = 2, 16
#: Signatures that a task sorts and packs at once.
PACK = 1 << 18
#: Members of a signature within a pack that travel on; of more, the first does,
#: and the pack's list of them goes its own way.
TOGETHER = 4
#: Signatures that meet in one group of the shuffle, about.
BUCKET = 1 << 17
#: Members of a hub that are compared in one group.
HUB = 512
#: Bytes of sets in a batch.
BATCH = 1 << 22
#: Tables of up to so many rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000
_U = np.uint64


class Bands:
    """Size bands, and bridges across their edges for pairs from two of them; k and
    first-level parts of each.  A bridge only holds sets that have a partner in
    size on the other side, so its k is small."""

    def __init__(self, percent: int, largest: int = 1 << 40):
        self.percent = p = percent
        low = [1]
        while low[-1] <= largest:
            low.append(max(low[-1] + 1, low[-1] * 8 // 5, low[-1] * 100 // p + 1))
        self.low = np.array(low, np.int64)
        self.bridge = len(low)  # number of the first bridge, at the edge low[1]
        within = 2 * (self.low[1:] - 1) * (100 - p) // (100 + p)
        across = (self.low[1:] - 1) * (100 - p) // p
        self.k = np.concatenate([within, [0], across])
        self.spare = SPARE + self.k // SPARE_K
        self.parts = self.k // 2 + self.spare

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, side="right") - 1

    def memberships(self, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sets and the band or bridge in which they are signed.  Where k is 0 no
        signature is needed (equal sets are one already)."""
        p, band = self.percent, self.of(n)
        below, above = self.low[band], self.low[band + 1]
        for sets, number in (
            (n > 0, band),
            ((n > 0) & (100 * n >= p * above), self.bridge + band),
            ((n > 0) & (band > 0) & (p * n <= 100 * (below - 1)), self.bridge + band - 1),
        ):
            at = np.flatnonzero(sets & (self.k[number] > 0))
            yield at, number[at]


def shingle_sets(s: Slice, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text as 64-bit hashes: hash, text, set sizes.

    A text with fewer words than a shingle is one shingle; one without, none.
    """
    low = Slice(LOWER[s.data], s.offs, s.first)
    start, end, text = low.words
    pre = prefix(low.hashes(start, end))
    n_words = np.bincount(text, minlength=s.n)
    first = np.cumsum(n_words) - n_words
    at = np.arange(len(start))
    at = at[at + words <= len(start)]
    at = at[text[at] == text[at + words - 1]]
    short = np.flatnonzero((n_words > 0) & (n_words < words))
    begin = np.concatenate([at, first[short]])
    stop = np.concatenate([at + words, first[short] + n_words[short]])
    of = np.concatenate([text[at], short])
    h = span_hash(pre, begin, stop)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, of, np.bincount(of, minlength=s.n)


def signatures(h: np.ndarray, of: np.ndarray, n: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of each set, and the set each belongs to; the low byte is the band or bridge."""
    first = np.cumsum(n) - n
    sigs, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for sets, band in bands.memberships(n):
        if not len(sets):
            continue
        parts = bands.parts[band]
        base = np.cumsum(parts) - parts
        size = n[sets]
        row = np.repeat(np.arange(len(sets)), size)
        x = h[np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[sets], size)]
        place = mix(x + mix(band + 1)[row])
        one = ((place >> _U(32)) * parts[row].astype(np.uint64)) >> _U(32)
        two = ((place & _U(0xFFFFFFFF)) * _U(N2)) >> _U(32)
        cell = np.zeros(int(parts.sum()) * N2, np.uint64)
        at = (base[row] + one.astype(np.int64)) * N2 + two.astype(np.int64)
        np.add.at(cell, at, mix(x))
        held = np.bincount(at, minlength=len(cell)).reshape(-1, N2)
        cell = cell.reshape(-1, N2)
        member = np.repeat(np.arange(len(sets)), parts)
        number = np.arange(len(member)) - base[member]
        name = mix((band[member] * (1 << 40) + number * N2)[:, None] + np.arange(N2)[None, :])
        sig = mix((cell.sum(axis=1, dtype=np.uint64)[:, None] - cell) + name)
        sig = (sig & _U(0xFFFFFFFFFFFFFF00)) | (band[member].astype(np.uint64) & _U(0xFF))[:, None]
        bare = held.sum(axis=1)[:, None] == held
        few = np.bincount(member, bare.any(axis=1), len(sets)) < bands.spare[band]
        stay = ~(bare & few[member][:, None])
        sigs.append(sig[stay])
        owner.append(np.repeat(sets[member], N2).reshape(-1, N2)[stay])
    return np.concatenate(sigs), np.concatenate(owner)


def _in_order(sig: np.ndarray, rid: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by signature and set, each such pair once."""
    order = np.argsort(sig, kind="stable")
    sig, rid, flag = sig[order], rid[order], flag[order]
    same = sig[1:] == sig[:-1]
    at = np.flatnonzero(np.append(same, False) | np.append(False, same))
    if len(at):
        turn = at[np.lexsort((-flag[at].astype(np.int8), rid[at], sig[at]))]
        rid[at], flag[at] = rid[turn], flag[turn]
        new = np.ones(len(sig), bool)
        new[1:] = ~same | (rid[1:] != rid[:-1])
        sig, rid, flag = sig[new], rid[new], flag[new]
    return sig, rid, flag


_PACKED = "bucket int, part int, sig binary, rid binary, flag binary"


def _pack(sig: np.ndarray, rid: np.ndarray, buckets: int, spread: int) -> pa.RecordBatch:
    """Rows for the shuffle: signatures and sets of each bucket (part 0), and the
    lists of those signatures that many sets of this pack share (part 1)."""
    sig, rid, flag = _in_order(sig, rid, np.zeros(len(sig), np.uint8))
    start, count = runs(sig)
    many = np.repeat(count > TOGETHER, count)
    go = ~many
    go[start[count > TOGETHER]] = True
    flag[many] = 1
    bucket = (((sig >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)
    rows = []
    at, n = runs(bucket[go])
    s, r, f, b = sig[go], rid[go], flag[go], bucket[go]
    for i, k in zip(at, n):
        rows.append((int(b[i]), 0, planes(s[i : i + k]), planes(r[i : i + k]), f[i : i + k].tobytes()))
    if many.any():
        rows.append((spread % buckets, 1, planes(sig[many]), planes(rid[many]), b""))
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], ["bucket", "part", "sig", "rid", "flag"])


def _meet(table: pa.Table) -> pa.Table:
    """Of one bucket: the two sets of a signature that only two have (sig is null,
    n: how many such signatures), and signature and set of those that more have."""
    first = table.filter(pa.compute.equal(table["part"], 0))
    lists = table.filter(pa.compute.equal(table["part"], 1))
    flag = np.frombuffer(b"".join(first["flag"].to_pylist()), np.uint8)
    sig, rid, flag = _in_order(numbers(first["sig"]), numbers(first["rid"], np.int64), flag.copy())
    start, count = runs(sig)
    listed = np.maximum.reduceat(flag, start) if len(start) else flag
    two = start[(count == 2) & (listed == 0)]
    pair = np.stack([rid[two], rid[two + 1]], axis=1)
    pair, n = np.unique(pair, axis=0, return_counts=True)
    more = np.repeat((count > 2) | (count == 2) & (listed > 0), count)
    sig = np.concatenate([sig[more], numbers(lists["sig"])])
    rid = np.concatenate([rid[more], numbers(lists["rid"], np.int64)])
    none = len(pair)
    return pa.table({
        "sig": pa.array(np.append(np.zeros(none, np.uint64), sig).view(np.int64), mask=np.arange(none + len(sig)) < none),
        "a": np.append(pair[:, 0], rid),
        "b": np.append(pair[:, 1], rid),
        "n": np.append(n, np.ones(len(sig), np.int64)),
    })


def _near(left: DataFrame, right: DataFrame, on, rows: int, how: str = "inner") -> DataFrame:
    """left joined with a right side of a known number of rows."""
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right.hint("merge"), on, how)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, hashes: bool = False) -> DataFrame:
    """key, ``n_shingles`` and ``component_id`` for every row of docs.

    Rows link when 100 * intersection >= percent * union of their sets of shingles
    (``words`` words ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case).  component_id:
    the smallest key that links lead to.  Texts without a word, and nulls, have no
    shingle, link with nothing and are their own component.  Repeated rows and
    copies are equal sets and therefore one component; a null key is a component's
    id only if no other key is in it.  Other columns are dropped, but with
    ``hashes`` t1 and t2, two hashes of the text, are returned as well, and
    ``first``: the component's first row as a struct of t1 and t2, in the order of
    key (nulls last), t1, t2; its key is component_id.  An empty table stays empty.
    Shingles are told apart by 64-bit hashes, sets by 128 bits.

    Scale: equal sets are one from the start, and one row of each is signed.
    Signatures are sorted and packed before their shuffle, and a signature that a
    third of the texts have sends one row for each pack.  Pairs come from stars;
    only signatures whose members are still in different components go on, by
    their members' rarest shingles.  A pair costs the move of one set; a hub's set
    is repeated once for HUB members.  Quadratic in one case only: unlinked texts
    that all have about p % of their shingles in common.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.col(key).alias("key"), body.alias("text"), F.xxhash64(body).alias("t1"), F.xxhash64(F.lit(1), body).alias("t2"))
    key_type = source.schema["key"].dataType.simpleString()
    bands = Bands(percent)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2 = [], [], []
            for s in slices(batch["text"]):
                h, of, size = shingle_sets(s, words)
                a, b = np.zeros(s.n, np.uint64), np.zeros(s.n, np.uint64)
                np.add.at(a, of, mix(h))
                np.add.at(b, of, mix(h ^ _U(0x5851F42D4C957F2D)))
                n.append(size), f1.append(a.view(np.int64)), f2.append(b.view(np.int64))
            cols = [pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (n, f1, f2)]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["t1"], batch["t2"], *cols], ["key", "t1", "t2", "n", "f1", "f2"])
        tidy()

    sets = written(source.mapInArrow(measure, f"key {key_type}, t1 bigint, t2 bigint, n bigint, f1 bigint, f2 bigint"), "dup-sets")
    reps = sets.where("n > 0").groupBy("n", "f1", "f2").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "t1", "t2")).alias("low"))
    reps = written(reps.select(F.monotonically_increasing_id().alias("rid"), "n", "f1", "f2", "low"), "dup-reps")
    n_reps, elements = reps.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    rows_of = reps.select("rid", F.col("low.key").alias("key"), F.col("low.t1").alias("t1"), F.col("low.t2").alias("t2"))

    def texts_of(wanted: DataFrame | None, rows: int) -> DataFrame:
        """text, rid and the other columns of ``wanted`` for its sets (none: for all).
        Only rows that are equal in key and text can give a set twice."""
        found = rows_of if wanted is None else _near(rows_of, wanted, "rid", rows)
        r, d = found.withColumnRenamed("key", "k").alias("r"), source.alias("d")
        same = (F.col("d.t1") == F.col("r.t1")) & (F.col("d.t2") == F.col("r.t2")) & F.col("d.key").eqNullSafe(F.col("r.k"))
        return _near(d, r, same, rows).select("d.text", *[f"r.{c}" for c in found.columns if c not in ("key", "t1", "t2")])

    # About N2 k / 2 signatures for a set in its band and, most often, one bridge.
    buckets = max(64, int(2 * N2 * elements * (100 - percent) / (100 + percent)) // BUCKET)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, rids, n, turn = [], [], 0, 0
        for batch in batches:
            rid = np.asarray(batch["rid"])
            for s in slices(batch["text"]):
                sig, owner = signatures(*shingle_sets(s, words), bands)
                sigs.append(sig), rids.append(rid[s.first + owner])
                n += len(sig)
                if n >= PACK:
                    turn += 1
                    yield _pack(np.concatenate(sigs), np.concatenate(rids), buckets, turn * 7919 + int(rids[-1][-1]))
                    sigs, rids, n = [], [], 0
        if n:
            yield _pack(np.concatenate(sigs), np.concatenate(rids), buckets, int(rids[-1][-1]) if len(rids[-1]) else 0)
        sigs, rids = [], []
        tidy()

    packed = texts_of(None, n_reps).mapInArrow(sign, _PACKED)
    met = packed.groupBy("bucket").applyInArrow(_meet, "sig bigint, a bigint, b bigint, n bigint")
    met = written(met, "dup-signatures")
    release(spark)

    # Each signature's star: around that member which most signatures of several have.
    members = met.where("sig is not null").select("sig", F.col("a").alias("rid"))
    drawn = written(members.groupBy("rid").agg(F.count(F.lit(1)).alias("drawn")), "dup-drawn")
    n_drawn = drawn.count()
    centre = _near(members, drawn, "rid", n_drawn).groupBy("sig").agg(F.max(F.struct("drawn", (-F.col("rid")).alias("id"))).alias("top"))
    centre = written(centre.select("sig", (-F.col("top.id")).alias("hub")), "dup-centres")
    star = _near(members, centre, "sig", centre.count()).where("hub <> rid").groupBy("hub", "rid").agg(F.count(F.lit(1)).alias("n"))
    two = met.where("sig is null").groupBy(F.col("a").alias("hub"), F.col("b").alias("rid")).agg(F.sum("n").alias("n"))
    star = written(star.unionByName(two), "dup-stars")
    compare = _Comparer(texts_of, reps.select("rid", "n"), n_reps, words, percent)
    # First each text with the one that it shares most signatures with, then only what is still apart.
    best = star.groupBy("rid").agg(F.max(F.struct("n", (-F.col("hub")).alias("id"))).alias("top"))
    compare.add(best.select((-F.col("top.id")).alias("a"), F.col("rid").alias("b")))
    at = compare.roots()
    left = star.select(F.col("hub").alias("a"), F.col("rid").alias("b"))
    for end in ("a", "b"):
        left = _near(left, at.select(F.col("rid").alias(end), F.col("root").alias(f"root_{end}")), end, n_reps)
    compare.add(left.where("root_a <> root_b").select("a", "b"))

    # Members of signatures that are still in different components.
    at = compare.roots()
    rooted = _near(members, at, "rid", n_reps)
    apart = rooted.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("sig")
    apart = written(apart, "dup-apart")
    left = written(_near(rooted, apart, "sig", apart.count(), "left_semi").select("rid", "root").distinct(), "dup-left")
    n_left = left.count()
    if n_left:
        compare.add(_rare_pairs(texts_of(left.select("rid"), n_left), _near(reps.select("rid", "n"), left, "rid", n_left), n_left, words, percent))

    roots = _near(reps, compare.roots(), "rid", n_reps)
    lows = roots.groupBy("root").agg(F.min("low").alias("top"))
    each = roots.join(lows, "root").select("n", "f1", "f2", F.col("top.key").alias("component"), F.struct("top.t1", "top.t2").alias("first"))
    each = written(each, "dup-components")
    out = _near(sets, each, ["n", "f1", "f2"], n_reps, "left")
    first = F.when(F.col("n") > 0, F.col("first")).otherwise(F.struct(sets["t1"], sets["t2"]))
    more = ["t1", "t2", first.alias("first")] if hashes else []
    return out.select(F.col("key").alias(key), *more, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key")).alias("component_id"))


def _rare_pairs(texts: DataFrame, left: DataFrame, rows: int, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of sets with different roots that can be similar by their rarest
    shingles.  texts: text, rid.  left: rid, n, root of these sets, as many as ``rows``.

    The order is by the number of these sets that have a shingle.  A shingle at
    place i of a set of n leaves an overlap of n - i at most, and a similar set of m
    needs (n + m) p / (100 + p), so m is ``most`` at most.  Shingles move once to be
    counted where they meet, and from there those that are not alone to their sets.
    """
    spark = texts.sparkSession

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = np.asarray(batch["rid"])
            for s in slices(batch["text"]):
                h, of, _ = shingle_sets(s, words)
                yield pa.RecordBatch.from_arrays([pa.array(rid[s.first + of]), pa.array(h.view(np.int64))], ["rid", "item"])
        tidy()

    every = texts.mapInArrow(items, "rid bigint, item bigint")
    common = every.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("item"))).where("df > 1")
    common = common.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("df", "item"))).alias("common"))
    own = _near(common, left, "rid", rows)
    own = own.withColumn("alone", F.col("n") - F.size("common"))
    reach = F.floor(F.col("n") * (100 - percent) / 100) + 1 - F.col("alone")
    early = own.where(reach > 0).select("rid", "root", "n", "alone", F.posexplode(F.slice("common", F.lit(1), reach.cast("int"))).alias("place", "one"))
    most = F.floor((F.col("n") - F.col("alone") - F.col("place")) * (100 + percent) / percent) - F.col("n")
    early = early.select(F.col("one.item").alias("item"), "rid", "root", "n", most.cast("long").alias("most")).where(f"100 * most >= {percent} * n")
    early = written(early, "dup-early")
    # What the largest component has under a shingle meets only what others have.
    held = early.groupBy("item", "root").agg(F.count(F.lit(1)).alias("k"))
    held = held.groupBy("item").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("k", "root")).alias("top")).where("roots > 1")
    held = written(held.select("item", F.col("top.root").alias("major")), "dup-held")
    early = written(_near(early, held, "item", held.count()), "dup-met")
    release(spark)
    x, y = early.where("root <> major").alias("x"), early.alias("y")
    fits = F.expr(f"x.item = y.item AND x.root <> y.root AND x.n <= y.most AND y.n <= x.most AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)")
    return x.join(y, fits).select(F.least("x.rid", "y.rid").alias("a"), F.greatest("x.rid", "y.rid").alias("b")).distinct()


class _Comparer:
    """Compares pairs of sets exactly and keeps the links."""

    def __init__(self, texts_of, sizes: DataFrame, rows: int, words: int, percent: int):
        self.texts_of, self.sizes, self.rows, self.words, self.percent = texts_of, sizes, rows, words, percent
        self.done: list[DataFrame] = []
        self.links: list[DataFrame] = []

    def add(self, pairs: DataFrame) -> None:
        """Compares those of the pairs (a, b) that were not compared before and can be
        similar by their sizes.  a: the hub, whose set meets those of its b's in groups
        of about HUB."""
        for end in ("a", "b"):
            pairs = _near(pairs, self.sizes.select(F.col("rid").alias(end), F.col("n").alias(f"n_{end}")), end, self.rows)
        pairs = pairs.where(f"100 * least(n_a, n_b) >= {self.percent} * greatest(n_a, n_b)").select("a", "b")
        pairs = pairs.withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")})
        for old in self.done:
            pairs = pairs.join(old, ["x", "y"], "left_anti")
        pairs = written(pairs.groupBy("x", "y").agg(F.min("a").alias("a")).select("x", "y", "a", (F.col("x") + F.col("y") - F.col("a")).alias("b")), "dup-pairs")
        self.done.append(pairs.select("x", "y"))
        hubs = written(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("blocks")), "dup-hubs")
        n_hubs = hubs.count()
        if not n_hubs:
            return
        parts = _near(pairs, hubs, "a", n_hubs).select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"))
        mine = parts.select(F.col("b").alias("rid"), F.col("a").alias("hub"), "block")
        theirs = hubs.select(F.col("a").alias("rid"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        roles = mine.unionByName(theirs).groupBy("rid").agg(F.collect_list(F.struct("hub", "block")).alias("roles"))
        roles = written(roles, "dup-roles")
        words, p = self.words, self.percent

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rid, given = np.asarray(batch["rid"]), batch["roles"]
                offs, flat = np.asarray(given.offsets), given.values
                hub, block = np.asarray(flat.field("hub")), np.asarray(flat.field("block"))
                for s in slices(batch["text"]):
                    h, _, size = shingle_sets(s, words)
                    cuts = np.append(0, np.cumsum(size))
                    at = np.arange(offs[s.first], offs[s.first + s.n])
                    of = np.repeat(np.arange(s.n), np.diff(offs[s.first : s.first + s.n + 1]))
                    # Sets that many groups need are repeated, in batches of bounded bytes.
                    turn = np.cumsum(size[of] * 8) // BATCH
                    for _, rows in zip(*np.unique(turn, return_index=True)) if len(of) else ():
                        rows = np.flatnonzero(turn == turn[rows])
                        items = [h[cuts[i] : cuts[i + 1]].tobytes() for i in of[rows]]
                        yield pa.RecordBatch.from_arrays([pa.array(hub[at[rows]]), pa.array(block[at[rows]]), pa.array(rid[s.first + of[rows]]), pa.array(items, pa.binary())], ["hub", "block", "rid", "items"])
            tidy()

        built = self.texts_of(roles, roles.count()).mapInArrow(build, "hub bigint, block int, rid bigint, items binary")
        built = built.repartition("hub", "block").sortWithinPartitions("hub", "block", F.col("rid") != F.col("hub"))

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, x = None, np.zeros(0, np.uint64)
            for batch in batches:
                hub, block, rid = (np.asarray(batch[c]) for c in ("hub", "block", "rid"))
                links = []
                sets = batch["items"]
                offs = np.frombuffer(sets.buffers()[1], np.int32)[sets.offset : sets.offset + len(sets) + 1] // 8
                flat = np.frombuffer(sets.buffers()[2], np.uint8)[: 8 * int(offs[-1])].view(np.uint64) if len(sets) else x[:0]
                edges = np.flatnonzero((hub[1:] != hub[:-1]) | (block[1:] != block[:-1])) + 1
                for i, j in zip(np.append(0, edges), np.append(edges, len(hub))):
                    if i < j and (hub[i], block[i]) != now:
                        now, x = (hub[i], block[i]), flat[offs[i] : offs[i + 1]].copy()
                    y, size = flat[offs[i] : offs[j]], np.diff(offs[i : j + 1])
                    hit = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
                    both = np.diff(np.append(0, np.cumsum(hit))[np.append(0, np.cumsum(size))])
                    good = (100 * both >= p * (len(x) + size - both)) & (rid[i:j] != hub[i])
                    links.append(rid[i:j][good]), links.append(hub[i:j][good])
                a, b = np.concatenate([rid[:0], *links[1::2]]), np.concatenate([rid[:0], *links[::2]])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            tidy()

        self.links.append(written(built.mapInArrow(verify, "a bigint, b bigint"), "dup-links"))
        release(pairs.sparkSession)

    def roots(self) -> DataFrame:
        """rid and root of every set, from the links so far."""
        every = self.sizes.select("rid")
        if not self.links:
            return every.withColumn("root", F.col("rid"))
        found = connected_components(reduce(DataFrame.unionByName, self.links))
        joined = every.join(found.withColumnRenamed("node", "rid"), "rid", "left").select("rid", F.coalesce("root", "rid").alias("root"))
        return written(joined, "dup-roots")
