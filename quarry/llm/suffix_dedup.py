"""Suffix-array dedup: remove every byte covered by a ``width``-byte string that starts earlier too.

Which suffixes are sorted. Sorting all suffixes of a corpus moves ``width`` bytes a byte of text,
so the suffix array is sparse: every window of ``width`` bytes has an anchor, the position of the
least hash among its ``gram``-byte substrings (leftmost on ties), which depends on the window's
content alone, so equal windows have equal anchor offsets. About one byte in 32 is an anchor.
Anchors whose gram occurs once in the corpus (repeats.py, exact counts) own no repeated window.

The key of an anchor is the text from the anchor to the end of its last owned window, then the
text before it, read backwards, to the start of its first one; equal keys mean that all owned
windows are equal. The distributed merge sort of these keys:

1. A chunk sorts its keys, resolves equal ones locally (all but the earliest are removed), and
   writes one front-coded run: shared prefix length with the key before, and the rest.
2. Splitters are drawn from samples of the runs; runs are cut there, cuts are exchanged still
   front-coded, and a range merges its runs with a loser tree that keeps each loser's common
   prefix with the winner it lost to, so known prefixes are never compared again. A key arrives
   once a run however often it occurs.
3. Equal neighbours leave the earliest. Different keys of one gram may still share windows: the
   range compares their windows with the same anchor offset exactly, keeping the earliest start.
   A gram so common that it fills whole ranges is cut between them by full keys; its windows are
   then grouped by a 128-bit hash over all ranges, which splits any hot group.

Decisions are (document, start, end) rows; they meet the texts by chunk. Order is ascending
doc_id; rows without doc_id come last; rows that repeat a doc_id follow each other by the first
256 bytes of the text, then by its md5.
Null text counts as empty; texts shorter than ``width`` have no window and lose nothing.
An empty table gives no rows."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import only, pack_small, parts_for, saved, unpack_small
from quarry.llm.repeats import HEAD, Totals, chunk_of, chunks_of, with_repeats

WIDTH, GRAM = 100, 40
#: A position is (rows before it with the same doc_id) << SUB | byte offset.
SUB = 32
_MULT = 0x9E3779B97F4A7C15
_MIXERS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_CUT = "key long, start long, end long, n_keys long, run binary, sample array<binary>"


class _Powers:
    """Powers of the hash base and of its inverse mod 2^64, grown as texts need them."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _MULT), ("down", pow(_MULT, -1, 1 << 64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up[:n], cls.down[:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed rolling hash of each ``gram``-byte substring."""
    n = len(data)
    up, down = _Powers.of(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(7)) * down, out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * up[: n - gram + 1]
    for m in _MIXERS:
        h ^= h >> np.uint64(32)
        h *= m
    return h ^ (h >> np.uint64(29))


#: Low bits of a hash that give way to the position, and windows handled at once.
_PLACE, _SEGMENT = 24, 1 << 23


def anchors(data: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, anchor, first, last): the anchors in order and the starts of the windows each owns.
    Hashes are compared by their upper bits with the position below them, so one sliding minimum
    finds the leftmost least gram of every window."""
    w = width - gram + 1
    e = np.empty(0, np.int64)
    if len(data) < width:
        return np.empty(0, np.uint64), e, e, e
    h = gram_hashes(data, gram)
    where = []
    for at in range(0, len(h) - w + 1, _SEGMENT):
        part = h[at : at + _SEGMENT + w - 1]
        least = (part >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(part), dtype=np.uint64)
        span = 1
        while 2 * span <= w:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < w:
            least = np.minimum(least[: len(part) - w + 1], least[w - span :])
        where.append((least & np.uint64((1 << _PLACE) - 1)).astype(np.int64) + at)
    anchor = np.concatenate(where)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.append(first[1:], len(anchor)) - 1
    return h[anchor[first]], anchor[first], first, last


# ---- front-coded runs ---------------------------------------------------------------------------

def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be at least ``start``."""
    n = min(len(a), len(b))
    at = start
    while at < n and a[at : at + 8] == b[at : at + 8]:
        at += 8
    while at < n and a[at] == b[at]:
        at += 1
    return min(at, n)


def write_run(keys: list[bytes], docs: list[int], places: list[int], shared: list[int] | None = None) -> bytes:
    """``shared``: the common prefixes with the keys before, if known (that of the first is 0)."""
    if shared is None:
        shared = [0, *map(common_prefix, keys, keys[1:])] if keys else []
    rest = b"".join([k[s:] for k, s in zip(keys, shared)])
    parts = [pack_small(np.array(x, dtype=np.int64)) for x in (shared, [len(k) for k in keys], docs, places)]
    parts.append(zstandard.ZstdCompressor(level=3).compress(rest))
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def read_run(blob: bytes) -> tuple[list[bytes], list[int], list[int], list[int]]:
    """(keys, docs, places, shared prefixes)."""
    parts, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 8], "little")
        parts.append(blob[at + 8 : at + 8 + n])
        at += 8 + n
    shared, size, docs, places = [unpack_small(p).astype(np.int64).tolist() for p in parts[:4]]
    rest = zstandard.ZstdDecompressor().decompress(parts[4])
    keys, key, at = [], b"", 0
    for s, n in zip(shared, size):
        key = key[:s] + rest[at : at + n - s]
        at += n - s
        keys.append(key)
    return keys, docs, places, shared


class LoserTree:
    """Merges sorted runs of (keys, docs, places, shared). A run's ``h`` is the common prefix of
    its head with the last winner it was compared with; where two differ the longer one is the
    smaller key, and only equal ones are compared, from there on."""

    def __init__(self, runs: list[tuple]):
        self.runs = [r for r in runs if r[0]]
        k = len(self.runs)
        self.size = 1 << max(0, (k - 1).bit_length())
        self.at = [0] * k
        self.head: list[bytes | None] = [r[0][0] for r in self.runs] + [None] * (self.size - k)
        self.h = [0] * self.size
        self.loser = [0] * self.size
        self.top = self._build(1) if k else 0

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        return self._play(node, self._build(2 * node), self._build(2 * node + 1))

    def _play(self, node: int, a: int, b: int) -> int:
        """The winner of runs a and b; the loser stays at the node."""
        x, y = self.head[a], self.head[b]
        if y is None:
            self.loser[node] = b
            return a
        if x is None:
            self.loser[node] = a
            return b
        ha, hb = self.h[a], self.h[b]
        if ha == hb:
            n = common_prefix(x, y, ha)
            if x[n:] <= y[n:]:
                self.h[b], self.loser[node] = n, b
                return a
            self.h[a], self.loser[node] = n, a
            return b
        if ha > hb:
            self.loser[node] = b
            return a
        self.loser[node] = a
        return b

    def __iter__(self) -> Iterator[tuple[bytes, int, int, int]]:
        """(key, doc, place, common prefix with the key before) in order."""
        if not self.runs:
            return
        while True:
            w = self.top
            key = self.head[w]
            if key is None:
                return
            keys, docs, places, shared = self.runs[w]
            i = self.at[w]
            yield key, docs[i], places[i], self.h[w]
            i += 1
            self.at[w] = i
            if i < len(keys):
                self.head[w], self.h[w] = keys[i], shared[i]
            else:
                self.head[w], self.h[w] = None, 0
            node = (self.size + w) >> 1
            while node:
                w = self._play(node, self.loser[node], w) if self.head[w] is not None else self._play(node, w, self.loser[node])
                node >>= 1
            self.top = w


# ---- the stages ---------------------------------------------------------------------------------

def numbered(table: pa.Table) -> list[tuple[int, int, int]]:
    """(row, key, sub) of a chunk's rows: rows that repeat a key and have no number yet are numbered
    by the head of the text and its md5, as ``chunks_of`` numbers the others."""
    keys, subs = table.column("key").to_pylist(), table.column("sub").to_pylist()
    order = sorted(range(len(keys)), key=lambda i: (keys[i], subs[i] or 0))
    whole = [k for k, s in zip(keys, subs) if s is None]
    if len(set(whole)) < len(whole):
        texts = [t.encode() for t in table.column("text").to_pylist()]
        order.sort(key=lambda i: (keys[i], (texts[i][:HEAD], hashlib.md5(texts[i]).hexdigest()) if subs[i] is None else (subs[i],)))
    out, before, sub = [], None, 0
    for i in order:
        sub = sub + 1 if keys[i] == before else 0
        before = keys[i]
        out.append((i, keys[i], sub if subs[i] is None else subs[i]))
    return out


def _data(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), dtype=np.uint8)


def _spread(h: np.ndarray) -> np.ndarray:
    """Least hashes of windows are small numbers; a bijection spreads them over all hash ranges."""
    h = h * _MIXERS[1]
    return h ^ (h >> np.uint64(32))


def sorted_runs(rows: DataFrame, n_chunks: int, bits: int, width: int, gram: int, samples: int) -> DataFrame:
    """A run a chunk, and the removals that the chunk decides alone."""

    def keys(table: pa.Table) -> np.ndarray:
        every = [np.empty(0, np.uint64)]
        for text in table.column("text").to_pylist():
            every.append(_spread(anchors(_data(text), width, gram)[0]))
        return np.concatenate(every)

    def use(table: pa.Table, totals: Totals) -> pa.Table:
        texts = table.column("text").to_pylist()
        earliest: dict[bytes, tuple[int, int]] = {}
        gone: list[tuple[int, int, int]] = []
        for row, key, sub in numbered(table):  # ascending: the first to come is the earliest
            text = texts[row].encode()
            h, p, first, last = anchors(np.frombuffer(text, dtype=np.uint8), width, gram)
            hit = totals.of(_spread(h)) > 1
            back = text[::-1]
            n, base = len(text), sub << SUB
            start = stop = -1
            for a, f, l in zip(p[hit].tolist(), first[hit].tolist(), last[hit].tolist()):
                right = text[a : l + width]
                k = right + back[n - a : n - f] + bytes((len(right),))
                if k not in earliest:
                    earliest[k] = (key, base | a)
                    continue
                if f > stop:
                    if start >= 0:
                        gone.append((key, base | start, base | stop))
                    start = f
                stop = l + width
            if start >= 0:
                gone.append((key, base | start, base | stop))
        run = sorted(earliest)
        where = [earliest[k] for k in run]
        blob = write_run(run, [x[0] for x in where], [x[1] for x in where])
        step = max(1, len(run) // samples)
        picked = run[step // 2 :: step]
        return pa.table(
            [
                pa.array([g[0] for g in gone] + [None], pa.int64()), pa.array([g[1] for g in gone] + [None], pa.int64()), pa.array([g[2] for g in gone] + [None], pa.int64()),
                pa.array([None] * len(gone) + [len(run)], pa.int64()), pa.array([None] * len(gone) + [blob], pa.binary()), pa.array([None] * len(gone) + [picked], pa.list_(pa.binary())),
            ],
            names=[c.split()[0] for c in _CUT.split(", ")],
        )

    return with_repeats(rows, n_chunks, bits, keys, use, _CUT)


#: Sampled keys (of some 200 bytes) from which the driver draws the borders, whatever the corpus.
MOST_SAMPLES = 200_000


def splitters(samples: list[tuple[int, list[bytes]]], parts: int, gram: int) -> tuple[list[bytes], set[bytes]]:
    """Borders of at most ``parts`` ranges, and the grams cut by a border. A border is a gram's first
    key; a gram that would take several different borders keeps them as full keys and is cut. A
    sampled key that stands for more than a range is one border."""
    weighed = sorted((k, n / len(ks)) for n, ks in samples for k in ks)
    total = sum(w for _, w in weighed)
    chosen, run, want = [], 0.0, 1
    for k, w in weighed:
        run += w
        if want < parts and run >= want * total / parts:
            want = int(run * parts / total) + 1
            if not chosen or chosen[-1] != k:
                chosen.append(k)
    of_gram: dict[bytes, list[bytes]] = {}
    for k in chosen:
        of_gram.setdefault(k[:gram], []).append(k)
    borders, cut = [], set()
    for g, ks in of_gram.items():
        borders.append(g)
        if len(ks) > 1:
            borders += ks
            cut.add(g)
    return sorted(set(borders)), cut


def merged_removals(runs: DataFrame, width: int, gram: int, keys_per_part: int, least_parts: int) -> DataFrame:
    """(key, start, end) of what only the merge of all runs can decide."""
    spark = runs.sparkSession
    heads = runs.where("run IS NOT NULL").select("n_keys", "sample")
    found = heads.agg(F.coalesce(F.sum("n_keys"), F.lit(0)).alias("keys"), F.coalesce(F.sum(F.size("sample")), F.lit(0)).alias("drawn")).first()
    if found["drawn"] > MOST_SAMPLES:
        heads = heads.sample(MOST_SAMPLES / found["drawn"], seed=17)
    samples = [(r["n_keys"], [bytes(k) for k in r["sample"]]) for r in heads.collect() if r["sample"]]  # MOST_SAMPLES keys
    parts = min(parts_for(found["keys"], keys_per_part, least_parts), max(1, sum(len(ks) for _, ks in samples)))
    borders, cut_grams = splitters(samples, parts, gram)
    shared_borders = spark.sparkContext.broadcast((borders, cut_grams))  # a few keys a range

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders, _ = shared_borders.value
        for b in batches:
            for blob in b.column(0):
                keys, docs, places, shared = read_run(blob.as_py())
                at = [0, *(bisect_left(keys, x) for x in borders), len(keys)]
                part, piece = [], []
                for i, (x, y) in enumerate(zip(at, at[1:])):
                    if x < y:
                        part.append(i)
                        piece.append(write_run(keys[x:y], docs[x:y], places[x:y], [0, *shared[x + 1 : y]]))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(piece, pa.binary())], names=["part", "piece"])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        _, cut_grams = shared_borders.value
        tree = LoserTree([read_run(x.as_py()) for x in table.column("piece")])
        out: list[tuple] = []
        group: list[tuple[bytes, int, int]] = []
        last = b""
        for k, doc, place, shared in tree:
            if shared == len(k) == len(last):  # an equal key of another run: the earlier stays
                old = group[-1]
                keep, drop = ((doc, place), old[1:]) if (doc, place) < old[1:] else (old[1:], (doc, place))
                group[-1] = (k, *keep)
                out.append((*drop[:1], *_owned(k, drop[1], width), None))
                continue
            if shared < gram and group:
                _resolve(group, width, group[0][0][:gram] in cut_grams, out)
                group = []
            group.append((k, doc, place))
            last = k
        if group:
            _resolve(group, width, group[0][0][:gram] in cut_grams, out)
        cols = list(zip(*out)) if out else [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["key", "start", "end", "window"])

    pieces = runs.where("run IS NOT NULL").select("run").mapInArrow(cut, "part int, piece binary")
    decided = pieces.groupBy("part").applyInArrow(merge, "key long, start long, end long, window binary")
    if not cut_grams:
        return decided.select("key", "start", "end")
    decided = saved(decided, "suffix-merged")
    windows = decided.where("window IS NOT NULL")
    least = windows.groupBy("window").agg(F.min(F.struct("key", "start")).alias("least"))
    later = windows.join(least, "window").where(F.struct("key", "start") > F.col("least")).select("key", "start", "end")
    return decided.where("window IS NULL").select("key", "start", "end").unionByName(later)


def _owned(k: bytes, place: int, width: int) -> tuple[int, int]:
    """Bytes covered by the windows that a key's anchor at ``place`` owns."""
    right = k[-1]
    return place - (len(k) - 1 - right), place + right


def _resolve(group: list[tuple[bytes, int, int]], width: int, cut: bool, out: list[tuple]) -> None:
    """Windows shared by different keys of one gram: all but the earliest start are removed. For a
    gram that is cut between ranges the windows are handed on."""
    if len(group) == 1 and not cut:
        return
    texts = []
    earliest: dict[tuple[int, bytes], tuple[int, int]] = {}
    for k, doc, place in group:
        right = k[-1]
        before = len(k) - 1 - right
        text = k[right:-1][::-1] + k[:right]
        texts.append((text, before))
        if cut:
            for i in range(len(text) - width + 1):
                start = place - before + i
                out.append((doc, start, start + width, xxhash.xxh3_128_digest(text[i : i + width], seed=before - i)))
            continue
        for i in range(len(text) - width + 1):
            w = (before - i, text[i : i + width])
            if w not in earliest or (doc, place) < earliest[w]:
                earliest[w] = (doc, place)
    if cut:
        return
    for (k, doc, place), (text, before) in zip(group, texts):
        begin = end = -1
        for i in range(len(text) - width + 1):
            if earliest[before - i, text[i : i + width]] != (doc, place):
                if i > end:
                    if end >= 0:
                        out.append((doc, place - before + begin, place - before + end, None))
                    begin = i
                end = i + width
        if end >= 0:
            out.append((doc, place - before + begin, place - before + end, None))


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, keys_per_part: int = 40_000) -> tuple[DataFrame, DataFrame]:
    """(rows, removals): the chunked documents, and the (chunk, key, start, end) rows of all bytes to
    remove."""
    rows, n, bits, heavy = chunks_of(docs)
    samples = max(4, min(64, 65_536 // n))
    runs = saved(sorted_runs(rows.drop("row"), n, bits, width, gram, samples), "suffix-runs")
    parallel = docs.sparkSession.sparkContext.defaultParallelism
    gone = merged_removals(runs, width, gram, keys_per_part, parallel)
    return rows, _by_chunk(runs.where("run IS NULL").select("key", "start", "end").unionByName(gone), n, heavy)


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(what is left, removed bytes, maximal removed runs)."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, at = [], 0
    for a, b in merged:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    left = b"".join(out)
    return left, len(text) - len(left), len(merged)


def _with_spans(table: pa.Table, gone: pa.Table) -> Iterator[tuple[int, bytes, list[tuple[int, int]]]]:
    """(row, text, spans) of a chunk."""
    spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
    low = (1 << SUB) - 1
    for k, a, b in zip(*(gone.column(c).to_pylist() for c in ("key", "start", "end"))):
        spans.setdefault((k, a >> SUB), []).append((a & low, (a & low) + b - a))
    texts = table.column("text").to_pylist()
    for row, key, sub in numbered(table):
        yield row, texts[row].encode(), spans.get((key, sub), [])


def _by_chunk(gone: DataFrame, n: int, heavy: DataFrame | None) -> DataFrame:
    if heavy is None:
        return gone.select(chunk_of(n, "key"), "key", "start", "end")
    gone = gone.join(F.broadcast(heavy.withColumn("apart", F.lit(True))), "key", "left")
    chunk = F.when(F.col("apart"), chunk_of(n, "key", F.shiftright("start", SUB))).otherwise(chunk_of(n, "key"))
    return gone.select(chunk.alias("chunk"), "key", "start", "end")


def dedup_digest(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    rows, gone = repeated_spans(only(docs, "doc_id", "text"), width, gram)

    def finish(table: pa.Table, gone: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_pylist()
        out = []
        for row, text, spans in _with_spans(table, gone):
            left, removed, runs = kept_bytes(text, spans)
            out.append((ids[row], len(text), removed, runs, hashlib.sha256(left).hexdigest()))
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.drop("row").groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_documents(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text`` (bytes of characters that were cut in
    the middle go too) and ``n_chars``, if there, set to what is left. All rows and columns stay."""
    rows, gone = repeated_spans(docs, width, gram)
    rows = rows.select("chunk", "key", "sub", "text", "row")

    def finish(table: pa.Table, gone: pa.Table) -> pa.Table:
        left: list[str] = [""] * len(table)
        for row, text, spans in _with_spans(table, gone):
            left[row] = kept_bytes(text, spans)[0].decode("utf-8", "ignore") if spans else text.decode()
        return pa.table([pa.array(left, pa.string()), table.column("row")], names=["text", "row"])

    schema = T.StructType([T.StructField("text", T.StringType()), rows.schema["row"]])
    done = rows.groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(finish, schema)
    picked = {c: F.col("text") if c == "text" else F.col("row")[c] for c in docs.columns}
    if "n_chars" in picked:
        picked["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return done.select(*[v.alias(c) for c, v in picked.items()])
