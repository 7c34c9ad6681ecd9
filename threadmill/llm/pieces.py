"""Vocabulary tries as arrays, walked for many words at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trie:
    """A byte trie in two arrays: the child of node v by byte c is base[v] + c if
    check holds v there.  value is an entry's number, or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    roots: tuple[int, ...]

    def step(self, node: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nxt = self.base[node] + byte
        return nxt, self.check[nxt] == node


def build_trie(tables: list[dict[bytes, int]]) -> tuple[Trie, list[tuple[int, int, int]]]:
    """One trie with a root for each table, and its edges (parent, byte, child)
    parents first."""
    children: list[dict[int, int]] = []
    value: list[int] = []

    def node() -> int:
        children.append({})
        value.append(-1)
        return len(children) - 1

    roots = [node() for _ in tables]
    for root, table in zip(roots, tables):
        for key, number in table.items():
            at = root
            for c in key:
                if c not in children[at]:
                    children[at][c] = node()
                at = children[at][c]
            value[at] = number
    # First fit: a node's children go to the first offset at which all are free.
    room = 4 * len(children) + 1024
    used = bytearray(room)
    place = [0] * len(children)
    base, check = np.zeros(room, np.int32), np.full(room, -1, np.int32)
    out_value = np.full(room, -1, np.int32)
    free = 0
    for r in roots:
        while used[free]:
            free += 1
        used[free] = 1
        place[r] = free
        out_value[free] = value[r]
    edges, queue = [], list(roots)
    reach: dict[int, int] = {}  # where the last node with so many children was put
    for v in queue:
        labels = sorted(children[v])
        if not labels:
            continue
        while used[free]:
            free += 1
        at = max(free, labels[0], reach.get(len(labels), 0))
        while any(used[at - labels[0] + c] for c in labels):
            at += 1
        reach[len(labels)] = at
        b = at - labels[0]
        base[place[v]] = b
        for c in labels:
            child = children[v][c]
            used[b + c] = 1
            place[child] = b + c
            check[b + c] = place[v]
            out_value[b + c] = value[child]
            edges.append((place[v], c, b + c))
            queue.append(child)
        if at + 600 > room - 512:
            grow = room // 2
            used += bytearray(grow)
            base, check = np.append(base, np.zeros(grow, np.int32)), np.append(check, np.full(grow, -1, np.int32))
            out_value, room = np.append(out_value, np.full(grow, -1, np.int32)), room + grow
    top = max(i for i in range(room) if used[i]) + 257
    return Trie(base[:top], check[:top], out_value[:top], tuple(place[r] for r in roots)), edges


class Cache:
    """Results of words by their 64-bit hash, for the life of one task.

    ``limit`` only bounds memory: a full cache starts anew.
    """

    def __init__(self, limit: int = 1 << 20):
        self.limit = limit
        self.keys = np.zeros(0, np.uint64)
        self.values = np.zeros(0, np.int64)

    def missing(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        if not len(self.keys):
            return np.ones(len(keys), bool)
        return self.keys[np.minimum(at, len(self.keys) - 1)] != keys

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """keys: sorted and not yet present."""
        at = np.searchsorted(self.keys, keys)
        self.keys, self.values = np.insert(self.keys, at, keys), np.insert(self.values, at, values)

    def get(self, keys: np.ndarray) -> np.ndarray:
        return self.values[np.searchsorted(self.keys, keys)]

    @property
    def full(self) -> bool:
        return len(self.keys) > self.limit
