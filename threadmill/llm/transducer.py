"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The transducer is the composition of three small ones: the normaliser (a space
before the text), the pieces (one arc path for each, its weight the negated
score) and byte fallback (one arc for each byte, dearer than any piece).  A text
composed with it is a lattice over the text's bytes, and the encoding is the
lattice's shortest path in the tropical semiring.

No piece spans the place where a run of spaces begins, nor a byte that stands in
no piece at all, so the lattice falls apart into chunks there.  Equal chunks have
equal shortest paths: each is solved once a task, many chunks in step.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .pieces import Cache, Trie, build_trie
from .textbatch import Slice, slices, tidy

MARK = "▁"
SPACE = 0x20
#: Bytes of texts that are encoded at once.
_SLICE = 1 << 18
#: A byte arc costs this much more than the dearest piece.
FALLBACK_EXTRA = 10.0


@dataclass
class Transducer:
    trie: Trie
    cost: np.ndarray  # of each id
    byte_id: np.ndarray
    byte_cost: float
    alone: np.ndarray  # bytes that stand in no piece
    spelling: np.ndarray  # the bytes of all ids, laid end to end
    spell_at: np.ndarray

    @staticmethod
    def read(model_file: str) -> Transducer:
        """Compiles a piece model.

        Its normaliser has to be the identity with a dummy space before the text,
        and it needs byte fallback; other models are refused.
        """
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces: dict[bytes, int] = {}
        spelling: list[bytes] = []
        byte_id = np.full(256, -1, np.int32)
        cost = np.zeros(m.get_piece_size())
        for i in range(m.get_piece_size()):
            name = m.id_to_piece(i)
            if m.is_byte(i):
                c = int(name[3:-1], 16)
                byte_id[c] = i
                spelling.append(bytes([c]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                spelling.append(b"")
            else:
                if MARK in name.lstrip(MARK):
                    raise ValueError(f"piece {name!r} spans two words")
                spelling.append(name.replace(MARK, " ").encode())
                pieces[spelling[-1]] = i
                cost[i] = -m.get_score(i)
        if (byte_id < 0).any():
            raise ValueError("the model has no byte fallback")
        if m.decode(m.encode(" Aé  b\n")) != " Aé  b\n":
            raise ValueError("the model's normaliser is not the identity with a dummy space")
        trie, _ = build_trie([pieces])
        alone = np.ones(256, bool)
        alone[list(set(b"".join(p for p in pieces if len(p) > 1)))] = False
        at = np.zeros(len(spelling) + 1, np.int64)
        np.cumsum([len(x) for x in spelling], out=at[1:])
        return Transducer(trie, cost, byte_id, float(cost.max()) + FALLBACK_EXTRA, alone, np.frombuffer(b"".join(spelling), np.uint8), at)

    def shortest(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of each chunk's shortest path, laid end to end, and how many each has.

        Of equally short paths, the one whose last piece is longest, and so on
        towards the front.
        """
        n, width = len(start), int(length.max(initial=0))
        best = np.full((n, width + 1), np.inf)
        best[:, 0] = 0
        via = np.zeros((n, width + 1), np.int32)
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        for s in range(width):
            rows = np.arange(int(np.searchsorted(-length, -s, side="left")))
            byte = data[start[rows] + s]
            node = np.full(len(rows), self.trie.roots[0], np.int32)
            here = best[rows, s]
            self._relax(best, via, rows, s + 1, here + self.byte_cost, self.byte_id[byte])
            t = s
            while len(rows):
                node, ok = self.trie.step(node, byte)
                rows, node, here = rows[ok], node[ok], here[ok]
                t += 1
                hit = self.trie.value[node]
                end = hit >= 0
                self._relax(best, via, rows[end], t, here[end] + self.cost[hit[end]], hit[end])
                more = length[rows] > t
                rows, node, here = rows[more], node[more], here[more]
                byte = data[start[rows] + t]
        # Backwards from the ends, all chunks in step.
        at, rows, out = length.copy(), np.arange(n), []
        size = np.diff(self.spell_at)
        while len(rows := rows[at[rows] > 0]):
            ids = via[rows, at[rows]]
            out.append((rows, ids))
            at[rows] -= size[ids]
        count = np.zeros(n, np.int64)
        for rows, _ in out:
            count[rows] += 1
        ends = np.cumsum(count)
        flat = np.zeros(int(ends[-1]) if n else 0, np.int32)
        put = ends.copy()
        for rows, ids in out:
            put[rows] -= 1
            flat[put[rows]] = ids
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        return flat[_ranges((ends - count)[back], count[back])], count[back]

    @staticmethod
    def _relax(best, via, rows, t, cost, ids) -> None:
        better = cost < best[rows, t]
        best[rows[better], t] = cost[better]
        via[rows[better], t] = ids[better]


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, laid end to end."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - count), count)


class Encoder:
    """Encodes slices of texts; remembers the chunks it has solved."""

    def __init__(self, fst: Transducer):
        self.fst = fst
        self._forget()

    def _forget(self) -> None:
        self.cache = Cache()
        self.pool, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)

    def encode(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts laid end to end, and where each text's begin."""
        # Normaliser: a space before each text that is not empty.
        filled = np.diff(s.offs) > 0
        shift = np.cumsum(filled)
        data = np.full(len(s.data) + int(shift[-1]), SPACE, np.uint8)
        data[np.arange(len(s.data)) + np.repeat(shift, np.diff(s.offs))] = s.data
        t = Slice(data, s.offs + np.append(0, shift), s.first)
        space, alone = data == SPACE, self.fst.alone[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
        cut[t.offs[:-1][filled]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data)) if len(start) else start
        keys, first, back = np.unique(t.hashes(start, end), return_index=True, return_inverse=True)
        if self.cache.full:
            self._forget()
        new = self.cache.missing(keys)
        self._solve(data, keys[new], start[first[new]], (end - start)[first[new]])
        entry = self.cache.get(keys)[back]
        count = self.counts[entry]
        ids = self.pool[_ranges(self.starts[entry], count)]
        sums = np.append(0, np.cumsum(count))
        return ids, sums[np.searchsorted(start, t.offs)]

    def _solve(self, data, keys, start, length) -> None:
        # Chunks of like lengths share a table, so that one long chunk does not widen all.
        kind = np.ceil(np.log2(np.maximum(length, 1))).astype(int)
        entry = np.zeros(len(keys), np.int64)
        pools, base = [], len(self.pool)
        for k in np.unique(kind):
            mine = np.flatnonzero(kind == k)
            for part in np.array_split(mine, max(1, int(len(mine) << k) >> 21)):
                flat, count = self.fst.shortest(data, start[part], length[part])
                entry[part] = len(self.counts) + np.arange(len(part))
                self.counts = np.append(self.counts, count)
                self.starts = np.append(self.starts, base + np.cumsum(count) - count)
                pools.append(flat)
                base += len(flat)
        self.pool = np.concatenate([self.pool, *pools])
        self.cache.add(keys, entry)


def decode_ids(fst: Transducer, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts laid end to end without the dummy space, and where each begins."""
    size = np.diff(fst.spell_at)[ids]
    out = fst.spelling[_ranges(fst.spell_at[ids], size)]
    ends = np.append(0, np.cumsum(size))[offs]
    heads = ends[:-1][ends[:-1] < ends[1:]]
    heads = heads[out[heads] == SPACE]
    keep = np.ones(len(out), bool)
    keep[heads] = False
    return out[keep], ends - np.append(0, np.cumsum(keep == False))[ends]  # noqa: E712


def encode(docs: DataFrame, fst: Transducer, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with ``out``, the ids of each whole text as an array of ints.

    Null and empty texts have no ids.  Rows are encoded one by one: repeated rows
    and further columns stay, a column called ``out`` is replaced.  Any bytes can
    be encoded, by byte fallback at the worst.  No shuffle; the transducer that is
    broadcast has the size of the vocabulary.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fst)
    docs = docs.drop(out)
    plain = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for s in slices(batch[text], _SLICE):
                ids, at = encoder.encode(s)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*[batch[c].slice(s.first, s.n) for c in plain], lists], [*plain, out])
        tidy()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, ArrayType(IntegerType()))]))


def decode(docs: DataFrame, fst: Transducer, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with ``out``, the text that the ids stand for; null ids give an empty text.

    Ids outside the vocabulary raise an error.  Bytes that are no UTF-8 (ids that
    encode did not make) are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fst)

    def run(column: pd.Series) -> pd.Series:
        parts = [np.asarray(x if x is not None else [], np.int64) for x in column]
        at = np.append(0, np.cumsum([len(p) for p in parts]))
        body, offs = decode_ids(shared.value, np.concatenate([np.zeros(0, np.int64), *parts]), at)
        return pd.Series([body[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:])], dtype=object)

    run.__annotations__ = {"column": pd.Series, "return": pd.Series}
    return docs.withColumn(out, F.pandas_udf(run, "string")(F.col(ids)))


def encode_digest(docs: DataFrame, fst: Transducer, text: str = "text") -> DataFrame:
    """docs with ``n_pieces``, ``ids_crc32`` (of the ids as little-endian 32-bit
    numbers), ``n_fallback`` (byte pieces) and ``round_trip`` (decoding gives the
    text's bytes back), from the same encoder and decoder, without writing the ids.
    Nulls and empty texts have 0 pieces and round_trip true.  Columns of these names, in
    any case, are replaced; all others stay."""
    shared = docs.sparkSession.sparkContext.broadcast(fst)

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = shared.value
        encoder = Encoder(f)
        fallback = np.zeros(len(f.cost), np.int64)
        fallback[f.byte_id] = 1
        for column in columns:
            rows: dict[str, list] = {"n_pieces": [], "ids_crc32": [], "n_fallback": [], "round_trip": []}
            for s in slices(pa.array(column, pa.large_string(), from_pandas=True), _SLICE):
                ids, at = encoder.encode(s)
                body, offs = decode_ids(f, ids, at)
                raw = ids.astype("<i4").tobytes()
                rows["n_pieces"].extend(np.diff(at).tolist())
                rows["n_fallback"].extend(np.diff(np.append(0, np.cumsum(fallback[ids]))[at]).tolist())
                rows["ids_crc32"].extend(zlib.crc32(memoryview(raw)[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:]))
                rows["round_trip"].extend(np.array_equal(body[a:b], s.data[c:d]) for a, b, c, d in zip(offs[:-1], offs[1:], s.offs[:-1], s.offs[1:]))
            yield pd.DataFrame(rows)

    run.__annotations__ = {"columns": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    digest = F.pandas_udf(run, "n_pieces bigint, ids_crc32 bigint, n_fallback bigint, round_trip boolean")(F.col(text))
    fields = ("n_pieces", "ids_crc32", "n_fallback", "round_trip")
    given = [c for c in docs.columns if c.lower() not in fields]
    rows = docs.select(F.struct(*given).alias("row"), digest.alias("digest"))
    return rows.select("row.*", *[F.col(f"digest.{x}") for x in fields])
