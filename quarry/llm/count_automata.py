"""Weighted acyclic automata that map word sequences to counts.

An automaton reads a path of labels (here language, then words); the arc that ends a path carries
the path's own weight, so prefixes have weights too. In memory it is laid out by level: the nodes of
a level ascend by (parent, label), that is, paths ascend by the order of their labels' bytes, a
prefix before what it begins. ``of_paths`` builds it from sorted paths level by level.

``to_bytes`` writes the minimal form: from the last level up, nodes with equal arcs (label, weight,
target) are one state, whatever leads to them. Candidates for that meet by a hash of their arcs and
are compared arc by arc, so the form is exact."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import numpy as np
import zstandard

from quarry.llm.common import pack_small, unpack_small

_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]
Key = tuple[bytes, ...]


def folded(key: np.ndarray, weight: np.ndarray, fold: np.ufunc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys ascending, folded weights, number of each row's key)."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.empty(0, bool)
    number = np.empty(len(k), np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return k[first], fold.reduceat(weight[order], first) if len(k) else weight[:0], number


def runs_of(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    total = np.cumsum(n)
    return np.arange(int(total[-1]) if len(n) else 0) + np.repeat(start - (total - n), n)


class CountAutomaton:
    def __init__(self, words: list[bytes], parent: list[np.ndarray], label: list[np.ndarray], weight: list[np.ndarray]):
        self.words = words  # ascending; labels number them
        self.parent, self.label, self.weight = parent, label, weight

    @property
    def depth(self) -> int:
        return len(self.label)

    @property
    def n_nodes(self) -> int:
        return sum(map(len, self.label))

    def keys(self, d: int) -> np.ndarray:
        return self.parent[d] << 32 | self.label[d]

    def children(self, d: int) -> np.ndarray:
        """Where the arcs of each node of level ``d`` begin in the next level, and their end."""
        return np.searchsorted(self.parent[d + 1], np.arange(len(self.label[d]) + 1))

    # ---- building -------------------------------------------------------------------------------

    @classmethod
    def of_levels(cls, words: list[bytes], steps: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]], fold: np.ufunc = np.add) -> CountAutomaton:
        """From (row of the level before, label, weight) of each level's paths, in any order."""
        parent, label, weight = [], [], []
        number = np.zeros(1, np.int64)
        for before, labels, w in steps:
            key, total, number = folded(number[before] << 32 | labels, w, fold)
            parent.append(key >> 32)
            label.append(key & 0xFFFFFFFF)
            weight.append(total)
        return cls(words, parent, label, weight)

    @classmethod
    def of_paths(cls, words: list[bytes], columns: Sequence[np.ndarray], weight: np.ndarray, fold: np.ufunc = np.add) -> CountAutomaton:
        """From paths of one length, a column of labels for each level; prefixes weigh 0."""
        row = np.arange(len(weight))
        none = np.zeros(len(weight), np.int64)
        last = len(columns) - 1
        return cls.of_levels(words, [(row if d else none, c, weight if d == last else none) for d, c in enumerate(columns)], fold)

    @classmethod
    def union(cls, parts: Sequence[CountAutomaton], fold: np.ufunc = np.add) -> CountAutomaton:
        """All paths of the parts; the weights of equal paths are folded."""
        words = sorted(set().union(*[p.words for p in parts])) if len(parts) > 1 else list(parts[0].words) if parts else []
        at = dict(zip(words, range(len(words))))
        own = [np.fromiter(map(at.__getitem__, p.words), np.int64, len(p.words)) for p in parts]
        parent, label, weight = [], [], []
        number = [np.zeros(1, np.int64) for _ in parts]
        for d in range(max((p.depth for p in parts), default=0)):
            have = [p.depth > d for p in parts]
            key = np.concatenate([m[p.parent[d]] << 32 | o[p.label[d]] for p, o, m, h in zip(parts, own, number, have) if h])
            key, total, every = folded(key, np.concatenate([p.weight[d] for p, h in zip(parts, have) if h]), fold)
            sizes = [len(p.label[d]) if h else 0 for p, h in zip(parts, have)]
            number = np.split(every, np.cumsum(sizes)[:-1])
            parent.append(key >> 32), label.append(key & 0xFFFFFFFF), weight.append(total)
        return cls(words, parent, label, weight)

    def _with(self, parent: list[np.ndarray], label: list[np.ndarray], weight: list[np.ndarray]) -> CountAutomaton:
        """An automaton of some of the nodes; words that no arc has go."""
        used = np.zeros(len(self.words), bool)
        for x in label:
            used[x] = True
        number = np.cumsum(used) - 1
        return CountAutomaton([self.words[i] for i in np.flatnonzero(used).tolist()], parent, [number[x] for x in label], weight)

    def pruned(self, least: int) -> CountAutomaton:
        """Without paths that weigh under ``least``, but for prefixes of others and the first level."""
        keep = [w >= least for w in self.weight]
        for d in range(self.depth - 1, 0, -1):
            keep[d - 1][self.parent[d][keep[d]]] = True
        parent, number = [], np.zeros(1, np.int64)
        for d, k in enumerate(keep):
            k |= d == 0
            parent.append(number[self.parent[d][k]])
            number = np.cumsum(k) - 1
        return self._with(parent, [x[k] for x, k in zip(self.label, keep)], [x[k] for x, k in zip(self.weight, keep)])

    # ---- prefix ranges --------------------------------------------------------------------------

    def path(self, d: int, i: int) -> Key:
        out = []
        for level in range(d, -1, -1):
            out.append(self.words[self.label[level][i]])
            i = self.parent[level][i]
        return tuple(reversed(out))

    def below(self, border: Key) -> list[int]:
        """How many nodes of each level have a path that sorts before ``border``."""
        out, low, high, on = [], 0, len(self.label[0]) if self.depth else 0, True
        for d in range(self.depth):
            if on and d < len(border):
                w = bisect_left(self.words, border[d])
                i = low + int(np.searchsorted(self.label[d][low:high], w))
                on = i < high and w < len(self.words) and self.words[w] == border[d] and self.label[d][i] == w
                own = on and d + 1 < len(border)  # a proper prefix of the border sorts before it
            else:
                i, on, own = low, False, False
            out.append(i + own)
            if d + 1 < self.depth:
                low, high = np.searchsorted(self.parent[d + 1], [i, i + 1]).tolist()
        return out

    def cut(self, borders: Sequence[Key]) -> list[tuple[int, CountAutomaton]]:
        """(range, the paths in it) of the ranges that hold paths: range i ends before border i.
        Paths lead through prefixes of other ranges, which weigh 0 here."""
        if not self.n_nodes:
            return []
        last = max(self.path(d, -1) for d in range(self.depth) if len(self.label[d]))
        a, b = bisect_right(borders, self.path(0, 0)), bisect_right(borders, last)
        cuts = [[0] * self.depth, *[self.below(x) for x in borders[a:b]], [len(x) for x in self.label]]
        out = []
        for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
            if low == high:
                continue
            start, stop = list(low), list(high)
            for d in range(self.depth - 1, 0, -1):  # the prefixes that lead to the first path
                if start[d] < stop[d]:
                    start[d - 1] = min(start[d - 1], int(self.parent[d][start[d]]))
            parent, label, weight = [], [], []
            for d, (x, y) in enumerate(zip(start, stop)):
                parent.append(self.parent[d][x:y] - (start[d - 1] if d else 0))
                label.append(self.label[d][x:y])
                own = self.weight[d][x:y].copy()
                own[: low[d] - x] = 0
                weight.append(own)
            out.append((a + i, self._with(parent, label, weight)))
        return out

    # ---- composition ----------------------------------------------------------------------------

    def locate(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """Node of the last level for paths given by columns of labels of this automaton; -1 for none."""
        at = np.zeros(len(columns[0]), np.int64)
        for d, labels in enumerate(columns):
            if d >= self.depth or not len(self.label[d]):
                return np.full(len(at), -1)
            have, key = self.keys(d), at << 32 | labels
            i = np.minimum(np.searchsorted(have, key), len(have) - 1)
            at = np.where((at >= 0) & (labels >= 0) & (have[i] == key), i, -1)
        return at

    def labels_in(self, other: CountAutomaton) -> np.ndarray:
        """The labels that this automaton's words have in ``other``; -1 for none."""
        at = dict(zip(other.words, range(len(other.words))))
        return np.array([at.get(w, -1) for w in self.words], np.int64)

    def composed(self, counts: CountAutomaton) -> CountAutomaton:
        """The same paths with the weights they have in ``counts``; 0 for paths it lacks."""
        own = self.labels_in(counts)
        weight, at = [], np.zeros(1, np.int64)
        for d in range(self.depth):
            before, labels = at[self.parent[d]], own[self.label[d]]
            at = np.full(len(labels), -1)
            if d < counts.depth and len(counts.label[d]):
                have, key = counts.keys(d), before << 32 | labels
                i = np.minimum(np.searchsorted(have, key), len(have) - 1)
                at = np.where((before >= 0) & (labels >= 0) & (have[i] == key), i, -1)
                weight.append(np.where(at >= 0, counts.weight[d][at], 0))
            else:
                weight.append(np.zeros(len(labels), np.int64))
        return CountAutomaton(self.words, self.parent, self.label, weight)

    # ---- the minimal form -----------------------------------------------------------------------

    def _states(self, d: int, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state of each node of level ``d``, first node of each state): nodes with equal arcs
        share one. ``target`` are the states of the next level's nodes."""
        arcs = (self.label[d + 1], self.weight[d + 1], target)
        begin = self.children(d)
        n = np.diff(begin)
        mixed = sum((x.astype(np.uint64) + np.uint64(i + 1)) * m for i, (x, m) in enumerate(zip(arcs, _MIX)))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX[1]
        mixed = np.concatenate([[np.uint64(0)], np.cumsum(mixed ^ (mixed >> np.uint64(32)), dtype=np.uint64)])
        sign = mixed[begin[1:]] - mixed[begin[:-1]]
        sign, first, state = np.unique(sign * _MIX[0] + n.astype(np.uint64), return_index=True, return_inverse=True)
        # compare every node's arcs with those of its state's first node
        other = first[state]
        differ = n != n[other]
        mine = runs_of(begin[:-1][~differ], n[~differ])
        theirs = runs_of(begin[:-1][other[~differ]], n[~differ])
        unequal = np.zeros(len(mine), bool)
        for x in arcs:
            unequal |= x[mine] != x[theirs]
        differ[~differ] = np.diff(np.concatenate([[0], np.cumsum(unequal)])[np.concatenate([[0], np.cumsum(n[~differ])])]) > 0
        alone = np.flatnonzero(differ)  # a collision of the hash: a state of its own
        state[alone] = len(first) + np.arange(len(alone))
        return state, np.concatenate([first, alone])

    def to_bytes(self) -> bytes:
        target = np.zeros(len(self.label[-1]) if self.depth else 0, np.int64)
        blobs = []
        for d in range(self.depth - 1, -1, -1):
            if d:
                state, first = self._states(d - 1, target)
                begin = self.children(d - 1)
                n = np.diff(begin)[first]
                arcs = runs_of(begin[:-1][first], n)
            else:
                state, n, arcs = np.zeros(1, np.int64), np.array([len(self.label[0])]), np.arange(len(self.label[0]))
            blobs += [pack_small(x) for x in (n, self.label[d][arcs], self.weight[d][arcs], target[arcs])]
            target = state
        size = np.fromiter(map(len, self.words), np.int64, len(self.words))
        blobs += [pack_small(size), zstandard.ZstdCompressor(level=1).compress(b"".join(self.words))]
        return b"".join([self.depth.to_bytes(8, "little"), *[part for b in blobs for part in (len(b).to_bytes(8, "little"), b)]])

    @classmethod
    def from_bytes(cls, data: bytes) -> CountAutomaton:
        depth, at, blobs = int.from_bytes(data[:8], "little"), 8, []
        while at < len(data):
            n = int.from_bytes(data[at : at + 8], "little")
            blobs.append(data[at + 8 : at + 8 + n])
            at += 8 + n
        letters = zstandard.ZstdDecompressor().decompress(blobs.pop())
        *arrays, size = [unpack_small(b).astype(np.int64) for b in blobs]
        ends = np.cumsum(size).tolist()
        words = [letters[i:j] for i, j in zip([0, *ends], ends)]
        parent, label, weight = [], [], []
        state = np.zeros(1, np.int64)
        for d in range(depth):
            n, labels, weights, target = arrays[4 * (depth - 1 - d) : 4 * (depth - d)]
            arcs = runs_of((np.cumsum(n) - n)[state], n[state])
            parent.append(np.repeat(np.arange(len(state)), n[state]))
            label.append(labels[arcs]), weight.append(weights[arcs])
            state = target[arcs]
        return cls(words, parent, label, weight)
