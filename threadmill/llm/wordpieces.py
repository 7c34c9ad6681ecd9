"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie with failure links.  The link of a node leads to where
matching goes on after the pieces that the node's string is certain to begin
with; how many those are is known beforehand.  One walk over a word therefore
counts its pieces without building them or going back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Cache, Trie, build_trie
from .textbatch import Slice, slices

MARK = "▁"


def read_vocabulary(model_file: str) -> tuple[set[bytes], set[bytes]]:
    """Pieces that may begin a word, and pieces that may go on in one.

    From a piece model: a mark before a piece means that it begins a word.
    Single bytes are pieces of both kinds where the model has byte pieces, so
    every word then splits into pieces.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    first, later = set(), set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            first.add(bytes([int(piece[3:-1], 16)]))
            later.add(bytes([int(piece[3:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or not piece.strip(MARK) or MARK in piece[1:]:
            continue
        elif piece.startswith(MARK):
            first.add(piece[1:].encode())
        else:
            later.add(piece.encode())
    return first, later


class Automaton:
    """fail[v] and pops[v]: where to go on when node v has no child, and how many
    pieces are then complete; fail is -1 where the word has no split at all."""

    def __init__(self, first: set[bytes], later: set[bytes]):
        self.trie, edges = build_trie([dict.fromkeys(first, 0), dict.fromkeys(later, 0)])
        t: Trie = self.trie
        self.first, self.later = t.roots
        self.fail = np.full(len(t.base), -1, np.int32)
        self.pops = np.zeros(len(t.base), np.int32)
        for parent, c, node in edges:
            if t.value[node] >= 0:
                self.fail[node], self.pops[node] = self.later, 1
                continue
            z, n = int(self.fail[parent]), int(self.pops[parent])
            while z >= 0 and t.check[t.base[z] + c] != z:
                z, n = int(self.fail[z]), n + int(self.pops[z])
            if z >= 0:
                self.fail[node], self.pops[node] = t.base[z] + c, n

    def count(self, s: Slice, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces of each word; a word without a split counts as one."""
        order = np.argsort(start - end, kind="stable")  # longest first: those that go on are a prefix
        at, length = start[order], (end - start)[order]
        node = np.full(len(at), self.first, np.int32)
        total = np.zeros(len(at), np.int64)
        dead = np.zeros(len(at), bool)
        for i in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -i, side="left"))
            todo = np.arange(live)
            while len(todo):
                nxt, ok = self.trie.step(node[todo], s.data[at[todo] + i])
                node[todo[ok]] = nxt[ok]
                todo = self._fall(todo[~ok], node, total, dead)
        todo = np.arange(len(at))
        while True:
            todo = todo[(node[todo] != self.later) & (node[todo] != self.first)]
            if not len(todo):
                break
            todo = self._fall(todo, node, total, dead)
        out = np.empty(len(at), np.int64)
        out[order] = np.where(dead, 1, total)
        return out

    def _fall(self, todo, node, total, dead) -> np.ndarray:
        """Follows the failure links of todo; those without one are dead."""
        fail = self.fail[node[todo]]
        total[todo] += self.pops[node[todo]]
        lost = todo[fail < 0]
        dead[lost] = True
        node[lost] = self.later
        todo = todo[fail >= 0]
        node[todo] = self.fail[node[todo]]
        return todo


def count_slices(automaton: Automaton, column: pa.Array, cache: Cache) -> Iterator[np.ndarray]:
    for s in slices(column, 1 << 20):  # larger slices: each merges its new words into the cache
        start, end, text = s.words
        keys, first, back = np.unique(s.hashes(start, end), return_index=True, return_inverse=True)
        if cache.full:
            cache.__init__(cache.limit)
        new = cache.missing(keys)
        cache.add(keys[new], automaton.count(s, start[first[new]], end[first[new]]))
        yield s.per_text(cache.get(keys)[back], text)


def token_counts(docs: DataFrame, vocabulary: tuple[set[bytes], set[bytes]], text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with ``out``: the word pieces of each whole text.

    Words are ``[^\\x20\\x09-\\x0D]+``; each splits greedily into the longest
    piece that begins it and then the longest that goes on.  A word that has no
    such split counts as one unknown piece.  Null and empty texts have 0.  Rows
    are looked at one by one: repeated rows and further columns stay as they are,
    and a column called ``out`` is replaced.  No shuffle.  What is broadcast is
    the automaton, whose size is that of the vocabulary.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(*vocabulary))

    def counted(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = Cache()
        for column in columns:
            parts = list(count_slices(automaton.value, pa.array(column, pa.large_string(), from_pandas=True), cache))
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0, np.int64), dtype="int64")

    counted.__annotations__ = {"columns": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(out, F.pandas_udf(counted, "bigint")(F.col(text)))
