"""Periodic runs of words, by Lyndon roots.

A run is a maximal stretch of words with smallest period q and at least ``min_periods`` times q
words (``min_periods`` >= 2). By the runs theorem each run holds, under one of two opposite orders
of the words, a Lyndon root of length q that is the longest Lyndon word starting at its place. So:

1. ``lyndon_lengths`` gives the length of the longest Lyndon word at every place. It is phase one
   of Baier's suffix sorter: suffixes start in groups by their first word; groups are taken in
   descending order; every member points to the nearest place before it that is in a lower group,
   and the places pointed at leave their group for a new one right behind it, those pointed at more
   often behind those pointed at less. What a group's suffixes then have in common is their longest
   Lyndon word. No second phase and no suffix array is needed. It runs once for each order.
2. Each root is extended by longest common extensions to both sides (``Extensions``: ranks of
   blocks of doubling lengths). Stretches that are long enough are runs; equal ones fold.

Before that, ``sections`` leaves out words that no such run can hold: every word of a run behind
its first q words stands in it already, at most q words earlier, so places with that property
must lie side by side at least ``(min_periods - 1) q`` times. This drops no run and nothing is
sampled: ordinary prose has few such places, a document that is one long repetition keeps all.

Words are runs of bytes other than 0x20, 0x09-0x0D. Null, empty and blank texts have no words, no
runs and collapse to an empty text. Rows map one to one: null ids and repeated rows stay, the
place of a row does not matter, other columns are ignored, an empty table gives no rows. A document
is held by one task; batches are cut at ``SLICE_BYTES``, a longer text is a slice of its own. The
extensions hold 64 bytes a word of the slice's sections."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import text_or_empty

SLICE_BYTES = 4 << 20
#: Block lengths of the extensions go up to 2^TOP; longer ones take several blocks.
TOP = 14


def lyndon_lengths(s: np.ndarray) -> list[int]:
    """Length of the longest Lyndon word that starts at each place of ``s`` (integers)."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    first = np.flatnonzero(np.diff(s[order], prepend=s[order[:1]] - 1))
    begin = np.empty(n, np.int64)
    begin[order] = np.repeat(first, np.diff(first, append=n))
    sa, group = order.tolist(), begin.tolist()  # suffixes by group; the start of each suffix's group
    size, length, lyndon = [0] * n, [0] * n, [0] * n
    for a, b in zip(first.tolist(), [*first[1:].tolist(), n]):
        size[a], length[a] = b - a, 1
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    place = at.tolist()
    # the places whose group is not done, as a linked list; slot n serves both ends
    left, right = [*range(-1, n - 1), n - 1], [*range(1, n + 1), 0]
    end = n
    while end:
        g = group[sa[end - 1]]
        members, root, end = sorted(sa[g:end]), length[g], g
        before: dict[int, int] = {}
        for i in members:
            lyndon[i] = root
            j, k = left[i], right[i]
            right[j], left[k] = k, j
            if j >= 0:
                before[j] = before.get(j, 0) + 1
        for times in sorted(set(before.values()), reverse=True):
            leaving: dict[int, list[int]] = {}
            for j, c in before.items():
                if c == times:
                    leaving.setdefault(group[j], []).append(j)
            for old, js in leaving.items():
                rest = size[old] - len(js)
                new = old + rest
                if rest:
                    tail = old + size[old]
                    for j in js:  # to the right end of the old group
                        tail -= 1
                        x, a = sa[tail], place[j]
                        sa[a], place[x] = x, a
                        sa[tail], place[j], group[j] = j, tail, new
                    size[old] = rest
                size[new], length[new] = len(js), length[old] + times * root
    return lyndon


class Extensions:
    """Longest common extensions between places of ``s``, whose first and last symbols occur once."""

    def __init__(self, s: np.ndarray, longest: int):
        n = len(s)
        self.ranks = [s.astype(np.int64)]
        while (1 << len(self.ranks)) <= longest and len(self.ranks) <= TOP:
            low, h = self.ranks[-1], 1 << (len(self.ranks) - 1)
            high = np.concatenate([low[h:], n + np.arange(min(h, n))])
            self.ranks.append(np.unique(low * (2 * n) + high, return_inverse=True)[1])

    def _steps(self) -> Iterator[tuple[np.ndarray, int, bool]]:
        for k in range(len(self.ranks) - 1, -1, -1):
            yield self.ranks[k], 1 << k, k == len(self.ranks) - 1

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from a < b on are equal."""
        n = np.zeros(len(a), np.int64)
        for rank, h, again in self._steps():
            todo = np.arange(len(a))
            while len(todo):
                todo = todo[rank[a[todo] + n[todo]] == rank[b[todo] + n[todo]]]
                n[todo] += h
                if not again:
                    break
        return n

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols before a < b are equal."""
        n = np.zeros(len(a), np.int64)
        for rank, h, again in self._steps():
            todo = np.arange(len(a))
            while len(todo):
                todo = todo[a[todo] - n[todo] >= h]
                todo = todo[rank[a[todo] - n[todo] - h] == rank[b[todo] - n[todo] - h]]
                n[todo] += h
                if not again:
                    break
        return n


def sections(codes: np.ndarray, doc: np.ndarray, min_words: int, min_periods: int) -> np.ndarray:
    """(start, end) of the stretches, in ascending order, that may hold runs. ``codes`` are the words
    of all documents end to end, ``doc`` the document of each."""
    n = len(codes)
    if not n:
        return np.empty((0, 2), np.int64)
    starts = np.searchsorted(doc, doc)
    order = np.argsort(doc.astype(np.int64) * (int(codes.max()) + 1) + codes, kind="stable")
    same = (codes[order[1:]] == codes[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    gap = np.full(n, n + 1, np.int64)
    gap[order[1:][same]] = order[1:][same] - order[:-1][same]
    ends = np.zeros(n + 1, np.int64)
    widest = int(np.bincount(doc).max()) // min_periods
    least, limit = 1, 1
    while least <= widest:  # periods least..limit
        near = np.diff((gap <= limit).astype(np.int8), prepend=0, append=0)
        a, b = np.flatnonzero(near == 1), np.flatnonzero(near == -1)
        long = b - a >= max(min_words - limit, (min_periods - 1) * least)
        a, b = a[long], b[long]
        np.add.at(ends, np.maximum(a - limit, starts[a]), 1)
        np.add.at(ends, b, -1)
        least, limit = limit + 1, 2 * limit
    inside = np.diff((np.cumsum(ends[:-1]) > 0).astype(np.int8), prepend=0, append=0)
    borders = np.concatenate([inside != 0, [False]])[: n + 1]
    borders[np.flatnonzero(np.diff(doc)) + 1] |= True
    cuts = np.flatnonzero(borders)
    held = np.cumsum(inside)[cuts[:-1]] > 0 if len(cuts) else np.empty(0, bool)
    return np.stack([cuts[:-1][held], cuts[1:][held]], axis=1) if held.any() else np.empty((0, 2), np.int64)


def find_runs(codes: np.ndarray, doc: np.ndarray, min_words: int = 24, min_periods: int = 3) -> np.ndarray:
    """(start, length, period) of the runs in the words of all documents end to end, by start, then
    period. No run crosses documents."""
    parts = sections(codes, doc, min_words, min_periods)
    if not len(parts):
        return np.empty((0, 3), np.int64)
    sizes = parts[:, 1] - parts[:, 0]
    offset = np.cumsum(sizes + 1) - sizes  # a symbol of its own before each section and at the end
    joined = np.empty(int(sizes.sum()) + len(parts) + 1, np.int64)
    top = int(codes.max()) + 1
    joined[np.append(offset - 1, len(joined) - 1)] = top + np.arange(len(parts) + 1)
    at, root = [], []
    for (a, b), o in zip(parts.tolist(), offset.tolist()):
        s = np.unique(codes[a:b], return_inverse=True)[1]
        joined[o : o + b - a] = codes[a:b]
        for order in (s, -s):
            length = np.array(lyndon_lengths(order), np.int64)
            i = np.flatnonzero(min_periods * length <= b - a)
            at.append(i + o), root.append(length[i])
    i, p = np.unique(np.stack([np.concatenate(at), np.concatenate(root)]), axis=1)
    ext = Extensions(np.unique(joined, return_inverse=True)[1], int(sizes.max()))
    back = ext.backward(i, i + p)
    length = back + p + ext.forward(i, i + p)
    keep = length >= np.maximum(min_words, min_periods * p)
    runs = np.unique(np.stack([(i - back)[keep], length[keep], p[keep]], axis=1), axis=0)
    section = np.searchsorted(offset, runs[:, 0], side="right") - 1
    runs[:, 0] += parts[section, 0] - offset[section]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def slices(texts: pa.Array, slice_bytes: int) -> Iterator[tuple[int, int]]:
    """Cuts of consecutive texts of about so many bytes."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // slice_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return ((i, j) for i, j in zip(cuts, cuts[1:]) if i < j)


def word_runs(docs: DataFrame, min_words: int = 24, min_periods: int = 3, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start, then period) and collapsed:
    the words that no run holds behind its first period, joined by one space. ``rewrite`` may
    change a document's words before. A map; no shuffle."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(1), SLICE_BYTES):
                yield of_slice(b.slice(i, j - i))

    def of_slice(b: pa.RecordBatch) -> pa.RecordBatch:
        words = [t.split() for t in b.column(1).cast(pa.binary()).to_pylist()]
        if rewrite is not None:
            words = [rewrite(d, w) for d, w in zip(b.column(0).to_pylist(), words)]
        n = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(n) - n
        flat = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode()
        doc = np.repeat(np.arange(len(n)), n)
        runs = find_runs(flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), doc, min_words, min_periods)
        gone = np.zeros(len(doc) + 1, np.int64)
        np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
        np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
        kept = np.cumsum(gone[:-1]) == 0
        of = doc[runs[:, 0]] if len(runs) else np.empty(0, np.int64)
        for d in np.unique(of).tolist():
            words[d] = [w for w, k in zip(words[d], kept[start[d] : start[d] + n[d]].tolist()) if k]
        offsets = np.searchsorted(of, np.arange(len(n) + 1))
        columns = pa.StructArray.from_arrays([pa.array(runs[:, 0] - start[of]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], fields=list(kind.value_type))
        listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), columns, type=kind)
        collapsed = pa.array([b" ".join(w) for w in words], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n), listed, collapsed], names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs["text"]).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a tail that repeats, in a tenth of the documents (by crc32 of the id; without
    an id in none)."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def strongest(runs: Column) -> Column:
    """The run of the greatest exponent, compared exactly; ties to the least start, then period."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def run_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""
    found = word_runs(docs, 24, 3, looped).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
