"""Phrase collocations, counted exactly with weighted acyclic automata.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces into words.
All per language. A phrase of 2 to ``max_words`` words with at least ``min_count`` occurrences is a
candidate; its score is the least ``floor(scale a^2 / (l r))`` over the ways to cut it in two parts,
with a, l and r the occurrences of phrase and parts. A candidate inside a longer one that has at
least ``percent`` of its occurrences is dropped.

1. Each task turns slices of its documents into automata over (language, words...) that carry the
   counts of all n-grams (count_automata.py), built from the slice's sorted n-grams, and unites
   them up to ``SHARD_NODES`` nodes. A phrase leaves a shard once, however often it occurs there.
   Shards are written in segments of equal size.
2. Borders between prefix ranges are drawn from the segments' first paths, so ranges hold equal
   numbers of n-grams, whatever the languages and words; a border may lie inside the paths of one
   hot word or pair. Segments are cut at the borders; a range unites what it gets, sums the weights
   and keeps paths of ``min_count`` or more: then all counts are exact.
3. The parts of a range's candidates lie in other ranges. A range asks for them by an automaton of
   the paths it needs (each once, so no common word is asked for more than once a range), which
   carries the greatest count of the longer candidates that hold the path; it is cut at the borders,
   composed with the owners' automata, and comes back with their weights. The owners fold the
   requests by maximum to learn which of their candidates to drop.
4. Scores are computed with whole numbers of any size, and ranked in Spark.

Null language counts as ``und``, null text as empty. Empty texts and pieces have no words. Rows are
independent: null or repeated ids do not matter, repeated rows count again, other columns are
ignored, an empty table gives no rows. Ties in the ranking go by count, then by the phrase's
bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.llm.common import parts_for, saved, text_or_empty
from quarry.llm.count_automata import CountAutomaton, Key
from quarry.llm.lyndon_runs import slices

#: Bytes of text that are parsed at once, nodes of a shard, of a segment of it, and of a range
#: (before equal paths of different shards meet).
SLICE_BYTES, SHARD_NODES, SEGMENT_NODES, RANGE_NODES = 4 << 20, 1_500_000, 1 << 16, 1_200_000
#: Frequent paths of neighbouring ranges that answer and judge together.
GROUP_NODES = 400_000
#: At most so many first paths are drawn for borders, each word cut to so many bytes, and at least so
#: many stand for a range.
MOST_SAMPLES, BORDER_BYTES, SAMPLES_A_RANGE = 200_000, 64, 4
_BREAK = b"."
_TABLE = bytes(ord("." if chr(c) in ",.;:!?\n\x0b\x0c\r" else " " if c == 9 else chr(c).lower() if c < 128 else chr(c)) for c in range(256))
_SEGMENT = "first array<binary>, n long, data binary"


def count_words(texts: list[bytes], langs: list[bytes], max_words: int) -> CountAutomaton:
    """All n-grams of up to ``max_words`` words of the texts' pieces, under their language."""
    # pieces end at a break of their own; the last one of a text too
    parsed = pc.split_pattern(pa.array([t.translate(_TABLE).replace(_BREAK, b" . ") + b" ." for t in texts], pa.binary()), " ")
    coded = parsed.flatten().dictionary_encode()
    known = coded.dictionary.to_pylist()
    words = sorted({*known, *langs})
    at = dict(zip(words, range(len(words))))
    label = np.array([at[w] for w in known], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
    lang = np.repeat(np.array([at[x] for x in langs], np.int64), np.diff(parsed.offsets.to_numpy()))
    label, lang = (x[label != at.get(b"", -1)] for x in (label, lang))  # between two blanks
    word = label != at.get(_BREAK, -1)
    one = lambda n: np.ones(n, np.int64)
    row = np.flatnonzero(word)
    steps = [(np.zeros(len(row), np.int64), lang[row], one(len(row)))]  # a language weighs its words
    before = np.arange(len(row))
    for d in range(max_words):
        steps.append((before, label[row + d], one(len(row))))
        more = word[np.minimum(row + d + 1, len(word) - 1)] if len(row) else np.empty(0, bool)
        before, row = np.flatnonzero(more), row[more]
    return CountAutomaton.of_levels(words, steps)


def shard_segments(docs: DataFrame, max_words: int, shard_nodes: int = SHARD_NODES, segment_nodes: int = SEGMENT_NODES) -> DataFrame:
    """(first path, nodes, automaton) of the segments of all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[CountAutomaton] = []
        for b in batches:
            for i, j in slices(b.column(1), SLICE_BYTES):
                texts, langs = (b.column(c).slice(i, j - i).cast(pa.binary()).to_pylist() for c in (1, 0))
                held.append(count_words(texts, langs, max_words))
                if sum(a.n_nodes for a in held) >= shard_nodes:
                    yield segments(CountAutomaton.union(held))
                    held = []
        if held:
            yield segments(CountAutomaton.union(held))

    def segments(shard: CountAutomaton) -> pa.RecordBatch:
        deepest = max(range(shard.depth), key=lambda d: len(shard.label[d]))
        every = max(1, segment_nodes * len(shard.label[deepest]) // max(1, shard.n_nodes))
        borders = [shard.path(deepest, i) for i in range(every, len(shard.label[deepest]), every)]
        parts = shard.cut(borders)
        first = [[w[:BORDER_BYTES] for w in (borders[i - 1] if i else shard.path(0, 0))] for i, _ in parts]
        columns = [pa.array(first, pa.list_(pa.binary())), pa.array([a.n_nodes for _, a in parts], pa.int64()), pa.array([a.to_bytes() for _, a in parts], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["first", "n", "data"])

    rows = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), text_or_empty(docs["text"]).alias("text"))
    return rows.mapInArrow(run, _SEGMENT)


def range_borders(segments: DataFrame, range_nodes: int) -> list[Key]:
    """Ascending borders of ranges of about ``range_nodes`` nodes. The driver sees at most
    ``MOST_SAMPLES`` first paths, evenly drawn, so the borders are bounded whatever the corpus."""
    found = segments.agg(F.count("*").alias("segments"), F.coalesce(F.sum("n"), F.lit(0)).alias("nodes")).first()
    drawn = segments.select("first")
    if found["segments"] > MOST_SAMPLES:
        drawn = drawn.sample(MOST_SAMPLES / found["segments"], seed=13)
    keys = sorted(tuple(map(bytes, r["first"])) for r in drawn.toLocalIterator())
    n = min(parts_for(found["nodes"], range_nodes), max(1, len(keys) // SAMPLES_A_RANGE))
    return sorted({keys[len(keys) * i // n] for i in range(1, n)} - {*keys[:1]})


def _blobs(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.binary()]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["range", "asker", "data"])


_BLOBS = "range int, asker int, data binary"


def _automata(table: pa.Table) -> list[CountAutomaton]:
    return [CountAutomaton.from_bytes(x.as_py()) for x in table.column("data")]


def merged_ranges(segments: DataFrame, borders: list[Key], min_count: int) -> DataFrame:
    """(range, n, data): the automaton with the exact counts of the range's frequent paths."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                for i, a in CountAutomaton.from_bytes(x.as_py()).cut(borders):
                    yield from _blobs([(i, i, a.to_bytes())]).to_batches()

    def add(key: tuple, table: pa.Table) -> pa.Table:
        kept = CountAutomaton.union(_automata(table)).pruned(min_count)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([kept.n_nodes], pa.int64()), pa.array([kept.to_bytes()], pa.binary())], names=["range", "n", "data"])

    return segments.select("data").mapInArrow(cut, _BLOBS).groupBy("range").applyInArrow(add, "range int, n long, data binary")


def grouped(merged: DataFrame, borders: list[Key], nodes: int) -> tuple[DataFrame, list[Key]]:
    """``merged`` with wider ranges, of about ``nodes`` nodes, and their borders. Frequent paths are few,
    so far fewer ranges ask each other. The driver sees one number a range."""
    wide, kept, held = [], [], 0
    for r in merged.select("range", "n").orderBy("range").collect():
        if held and held + r["n"] > nodes:
            kept.append(borders[r["range"] - 1])
            held = 0
        held += r["n"]
        wide.append((r["range"], len(kept)))
    table = F.broadcast(merged.sparkSession.createDataFrame(wide, "range int, wide int"))  # a row a range
    return merged.join(table, "range").select(F.col("wide").alias("range"), "data"), kept


class Candidates:
    """The phrases of ``size`` words of an automaton with ``min_count`` occurrences: their labels
    (a column for the language and one a word) and counts."""

    def __init__(self, counts: CountAutomaton, size: int, min_count: int):
        at = np.flatnonzero(counts.weight[size] >= min_count) if counts.depth > size else np.empty(0, np.int64)
        self.counts = counts.weight[size][at] if len(at) else at
        columns = []
        for d in range(size, -1, -1):
            columns.append(counts.label[d][at] if len(at) else at)
            at = counts.parent[d][at] if len(at) else at
        self.columns = columns[::-1]

    def part(self, i: int, j: int) -> list[np.ndarray]:
        return [self.columns[0], *self.columns[1 + i : 1 + j]]


def requests(counts: CountAutomaton, min_count: int) -> CountAutomaton:
    """The parts of all candidates, weighing the greatest count of a longer candidate around them."""
    parts = []
    for size in range(2, counts.depth):
        c = Candidates(counts, size, min_count)
        for n in range(1, size):
            for i in range(size - n + 1):
                parts.append(CountAutomaton.of_paths(counts.words, c.part(i, i + n), c.counts, np.maximum))
    return CountAutomaton.union(parts, np.maximum)


def scored(counts: CountAutomaton, parts: CountAutomaton, longer: CountAutomaton, min_count: int, scale: int, percent: int) -> pa.Table:
    """lang, phrase, a, l, r, n, score of a range's candidates that no longer one covers."""
    columns: dict[str, list] = {x: [] for x in ("lang", "phrase", "a", "l", "r", "n", "score")}
    in_parts, in_longer = counts.labels_in(parts), counts.labels_in(longer)
    for size in range(2, counts.depth):
        c = Candidates(counts, size, min_count)
        if not len(c.counts):
            continue

        def weight(a: CountAutomaton, own: np.ndarray, i: int, j: int) -> np.ndarray:
            at = a.locate([own[x] for x in c.part(i, j)])
            return np.where(at >= 0, a.weight[j - i][at], 0) if a.depth > j - i and len(a.weight[j - i]) else np.zeros(len(at), np.int64)

        kept = np.flatnonzero(100 * weight(longer, in_longer, 0, size) < percent * c.counts)
        occurrences = c.counts[kept].tolist()
        cuts = [list(zip(weight(parts, in_parts, 0, k)[kept].tolist(), weight(parts, in_parts, k, size)[kept].tolist())) for k in range(1, size)]
        total = weight(parts, in_parts, 0, 0)[kept].tolist()
        text = [[counts.words[i] for i in x] for x in zip(*[col[kept].tolist() for col in c.columns])]
        for words, a, n, lr in zip(text, occurrences, total, zip(*cuts)):
            score, k = min((scale * a * a // (l * r), k) for k, (l, r) in enumerate(lr))
            for name, x in zip(columns, (words[0], b" ".join(words[1:]), a, *lr[k], n, score)):
                columns[name].append(x)
    return pa.table({k: pa.array(v, pa.binary()).cast(pa.string()) if k in ("lang", "phrase") else pa.array(v, pa.int64()) for k, v in columns.items()})


def phrase_scores(docs: DataFrame, max_words: int = 3, min_count: int = 10, scale: int = 1_000_000, percent: int = 50, shard_nodes: int = SHARD_NODES, segment_nodes: int = SEGMENT_NODES, range_nodes: int = RANGE_NODES, group_nodes: int = GROUP_NODES) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every candidate that is not dropped."""
    segments = saved(shard_segments(docs, max_words, shard_nodes, segment_nodes), "phrase-shards")
    borders = range_borders(segments, range_nodes)
    merged, borders = grouped(saved(merged_ranges(segments, borders, min_count), "phrase-counts"), borders, group_nodes)

    def ask(key: tuple, owned: pa.Table) -> pa.Table:
        wanted = requests(CountAutomaton.union(_automata(owned)), min_count)
        return _blobs([(i, key[0].as_py(), a.to_bytes()) for i, a in wanted.cut(borders)])

    def answer(key: tuple, asked: pa.Table, owned: pa.Table) -> pa.Table:
        k = key[0].as_py()
        counts = CountAutomaton.union(_automata(owned))
        wanted = _automata(asked)
        rows = [(i, k, a.composed(counts).to_bytes()) for i, a in zip(asked.column("asker").to_pylist(), wanted)]
        return _blobs([*rows, (k, -1, CountAutomaton.union(wanted, np.maximum).to_bytes())])

    def judge(key: tuple, told: pa.Table, owned: pa.Table) -> pa.Table:
        own = np.array(told.column("asker").to_pylist()) < 0  # what others said of this range's paths
        parts, longer = (CountAutomaton.union(_automata(told.filter(pa.array(x, pa.bool_())))) for x in (~own, own))
        return scored(CountAutomaton.union(_automata(owned)), parts, longer, min_count, scale, percent)

    asked = merged.groupBy("range").applyInArrow(ask, _BLOBS)
    told = asked.groupBy("range").cogroup(merged.groupBy("range")).applyInArrow(answer, _BLOBS)
    return told.groupBy("range").cogroup(merged.groupBy("range")).applyInArrow(judge, "lang string, phrase string, a long, l long, r long, n long, score long")


def top_phrases(docs: DataFrame, k: int = 2000, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``k`` by score, count, phrase."""
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = phrase_scores(docs, **options).withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
