"""op13: automata against dictionaries, mined phrases against a plain count."""

import re
from collections import Counter

import numpy as np
import pytest
from conftest import edge_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import phrases
from quarry.llm.count_automata import CountAutomaton
from quarry.llm.queries import op13_phrase_automata

PATHS = st.dictionaries(st.lists(st.sampled_from([b"a", b"ab", b"b", b"the", "é".encode()]), min_size=1, max_size=4).map(tuple), st.integers(1, 5), max_size=25)


def with_prefixes(paths):
    return {p[:i]: 0 for p in paths for i in range(1, len(p))} | paths


def automaton(paths):
    """By uniting one automaton a path length."""
    words = sorted({w for p in paths for w in p})
    parts = []
    for n in {len(p) for p in paths}:
        own = [p for p in paths if len(p) == n]
        columns = [np.array([words.index(p[d]) for p in own], np.int64) for d in range(n)]
        parts.append(CountAutomaton.of_paths(words, columns, np.array([paths[p] for p in own], np.int64)))
    return CountAutomaton.union(parts)


def listed(a):
    return {a.path(d, i): int(w) for d in range(a.depth) for i, w in enumerate(a.weight[d])}


@settings(max_examples=200, deadline=None)
@given(PATHS, PATHS, st.sampled_from([np.add, np.maximum]))
def test_union_and_bytes(one, two, fold):
    a, b = automaton(one), automaton(two)
    want = {p: int(fold(with_prefixes(one).get(p, 0), with_prefixes(two).get(p, 0))) for p in {*with_prefixes(one), *with_prefixes(two)}}
    both = CountAutomaton.union([a, b], fold)
    assert listed(both) == want
    if one:
        again = CountAutomaton.from_bytes(a.to_bytes())
        assert listed(again) == with_prefixes(one) and again.words == a.words
        assert [x.tolist() for x in again.parent] == [x.tolist() for x in a.parent]


def test_equal_ends_are_one_state():
    ends = {(bytes([97 + i % 26, 97 + i // 26]), b"x", y): 1 for i in range(600) for y in (b"p", b"q", b"r")}
    plain = {(*p[:2], bytes([97 + i % 26, 99 + i // 90])): 1 + i % 7 for i, p in enumerate(ends)}
    assert 2 * len(automaton(ends).to_bytes()) < len(automaton(plain).to_bytes())


@settings(max_examples=200, deadline=None)
@given(PATHS.filter(bool), st.lists(st.lists(st.sampled_from([b"a", b"aa", b"ab", b"b", b"t", b"the", b"z"]), min_size=1, max_size=5).map(tuple), max_size=5, unique=True))
def test_cut_at_borders(paths, borders):
    borders = sorted(borders)
    a, seen = automaton(paths), {}
    for i, part in a.cut(borders):
        for p, w in listed(part).items():
            if w:
                assert p not in seen and (not i or borders[i - 1] <= p) and (i == len(borders) or p < borders[i])
                seen[p] = w
        assert len({*part.words}) == len(part.words)
    assert seen == {p: w for p, w in paths.items() if w}
    whole = CountAutomaton.union([part for _, part in a.cut(borders)])
    assert listed(whole) == with_prefixes(paths)


@settings(max_examples=200, deadline=None)
@given(PATHS.filter(bool), PATHS.filter(bool), st.integers(1, 6))
def test_composition_and_pruning(asked, counts, least):
    c = automaton(counts)
    got = listed(automaton(asked).composed(c))
    assert got == {p: with_prefixes(counts).get(p, 0) for p in with_prefixes(asked)}
    kept = {p for p, w in counts.items() if w >= least}
    assert listed(c.pruned(least)) == {p: w for p, w in with_prefixes(counts).items() if len(p) == 1 or any(q[: len(p)] == p for q in kept)}


def plain(rows, k, max_words=3, min_count=10, percent=50):
    f, n, out = {}, Counter(), []
    for lang, text in rows:
        c = f.setdefault("und" if lang is None else lang, Counter())
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(w)
            c.update(tuple(w[i : i + m]) for m in range(1, max_words + 1) for i in range(len(w) - m + 1))
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        cover = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    cover[p[i : i + m]] = max(cover[p[i : i + m]], a)
        ranked = []
        for p, a in candidates.items():
            if 100 * cover[p] < percent * a:
                score, i = min((10**6 * a * a // (c[p[:i]] * c[p[i:]]), i) for i in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), c[p[:i]], c[p[i:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(ranked)[:k], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def mined(docs, **options):
    return sorted(map(tuple, phrases.top_phrases(docs, **options).collect()))


TINY = {"shard_nodes": 500, "segment_nodes": 20, "range_nodes": 60, "group_nodes": 30}


@pytest.mark.parametrize("size", [{}, TINY])
@pytest.mark.parametrize("rule", [{}, {"min_count": 2, "percent": 80, "max_words": 4}, {"min_count": 3, "max_words": 2}])
def test_edge_rows(edge_docs, size, rule):
    rows = [(r[3], r[1]) for r in edge_rows()]
    assert mined(edge_docs, k=50, **rule, **size) == plain(rows, 50, **rule)


def test_one_pair_holds_most_words(spark):
    """A hot word and pair with very many followers: ranges are cut inside its paths."""
    rows = [("en", "in the " + " in the ".join(f"w{(i * j) % 97}" for j in range(60))) for i in range(60)] + [(None, "a b. A B! a\tb, a\nb")] * 9
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    segments = phrases.shard_segments(docs, 3, 3000, 40).cache()
    borders = phrases.range_borders(segments, 80)
    inside = [b for b in borders if b[:3] in ((b"en", b"in", b"the"), (b"en", b"the"))]
    assert len(inside) > 3
    sizes = [r.n for r in phrases.merged_ranges(segments, borders, 1).selectExpr("length(data) AS n").collect()]
    assert len(sizes) == len(borders) + 1
    for size in ({}, TINY):
        assert mined(docs, k=2000, **size) == plain(rows, 2000)


def test_languages_that_look_like_words_or_null(spark):
    rows = [("und", "x y z. " * 5), (None, "x y z! " * 6), ("", "p q. " * 12), ("x y", "x y. " * 12), ("x", "y x. " * 12)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert mined(docs, k=5) == plain(rows, 5) and {r[0] for r in plain(rows, 5)} == {"und", "", "x y", "x"}


def test_empty_table(empty_docs):
    assert mined(empty_docs) == []


def test_counts_beyond_64_bits():
    a = CountAutomaton.of_paths([b"en", b"x", b"y"], [np.array([0]), np.array([1]), np.array([2])], np.array([3 * 10**12]))
    parts = CountAutomaton.union([CountAutomaton.of_paths(a.words, [np.array([0]), np.array([i])], np.array([4 * 10**12 + i])) for i in (1, 2)])
    none = CountAutomaton.of_paths(a.words, [np.array([0])], np.array([0]))
    got = phrases.scored(a, parts, none, 10, 10**6, 50).to_pylist()
    assert got[0]["score"] == 10**6 * 9 * 10**24 // ((4 * 10**12 + 1) * (4 * 10**12 + 2))


def test_op13_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text").collect()]
    assert sorted(map(tuple, op13_phrase_automata(spark, sf_dir).collect())) == plain(rows, 2000)
