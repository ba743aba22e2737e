"""op11: Lyndon arrays and runs against their definitions; the query against a plain scan."""

import hashlib
import re
import zlib

import numpy as np
from conftest import edge_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import lyndon_runs
from quarry.llm.queries import op11_lyndon_runs

SYMBOLS = st.integers(1, 4).flatmap(lambda k: st.lists(st.integers(0, k - 1), max_size=50))
LOOPED = st.tuples(SYMBOLS, st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 9), SYMBOLS).map(lambda x: x[0] + x[1] * x[2] + x[3][:5])


def longest_lyndon(s):
    return [max(j - i for j in range(i + 1, len(s) + 1) if all(s[i:j] < s[k:j] for k in range(i + 1, j))) for i in range(len(s))]


def plain_runs(s, min_words, min_periods):
    """Every maximal stretch of equal words q apart, for every q, with no smaller period."""
    found = []
    for q in range(1, len(s) // min_periods + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            w = s[i : j + q]
            if j > i and len(w) >= max(min_words, min_periods * q) and not any(w[d:] == w[:-d] for d in range(1, q)):
                found.append((i, len(w), q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(SYMBOLS.map(lambda s: s[:22]))
def test_lyndon_lengths(s):
    for x in (s, [-v for v in s]):
        assert lyndon_runs.lyndon_lengths(np.array(x, np.int64)) == longest_lyndon(x)


@settings(max_examples=300, deadline=None)
@given(st.lists(LOOPED, max_size=4), st.sampled_from([(24, 3), (1, 2), (4, 2), (1, 3), (10, 4)]))
def test_runs_of_many_documents(docs, least):
    codes = np.array([x for d in docs for x in d], np.int64)
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    want, at = [], 0
    for d in docs:
        want += [(at + a, n, q) for a, n, q in plain_runs(d, *least)]
        at += len(d)
    assert [tuple(r) for r in lyndon_runs.find_runs(codes, doc, *least).tolist()] == want


@settings(max_examples=60, deadline=None)
@given(LOOPED, st.integers(0, 60), st.integers(1, 20))
def test_extensions_beyond_the_longest_block(s, a, gap):
    top, lyndon_runs.TOP = lyndon_runs.TOP, 2
    try:
        t = np.array([8, *s * 3, 9], np.int64)
        a, b = 1 + a % max(1, len(t) - 2), min(len(t) - 1, 1 + a % max(1, len(t) - 2) + gap)
        ext = lyndon_runs.Extensions(t, len(t))
        f = next(k for k in range(len(t)) if a == b or t[a + k] != t[b + k]) if a < b else None
        if f is not None:
            g = next(k for k in range(a + 1) if t[a - k - 1] != t[b - k - 1])
            assert ext.forward(np.array([a]), np.array([b])) == [f] and ext.backward(np.array([a]), np.array([b])) == [g]
    finally:
        lyndon_runs.TOP = top


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a, old = g % n, list(words)
        p = 1 + (n - a) // (3 + g % 8)
        for i in range(a, n):
            words[i] = old[a + (i - a) % p]
    runs = plain_runs(words, 24, 3)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    milli = 1000 * best[1] // best[2] if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return doc_id, len(runs), *best, milli, sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)), sha(" ".join(kept))


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_edge_rows(edge_docs):
    got = lyndon_runs.run_digest(edge_docs).collect()
    assert ordered(got) == ordered(plain_digest(r[0], r[1]) for r in edge_rows())


def test_empty_table(empty_docs):
    assert lyndon_runs.run_digest(empty_docs).count() == 0


def test_small_slices_change_nothing(spark, edge_docs, monkeypatch):
    words = [(1, "a b " * 30 + "c"), (2, "x " * 40 + "y " * 40), (3, "k l m n o p q r s t " * 4), (4, None)]
    rows = lyndon_runs.word_runs(spark.createDataFrame(words, "doc_id long, text string").coalesce(1)).collect()
    assert [[tuple(x) for x in r.runs] for r in rows] == [[(0, 60, 2)], [(0, 40, 1), (40, 40, 1)], [(0, 40, 10)], []]
    assert [r.collapsed for r in rows] == ["a b c", "x y", "k l m n o p q r s t", ""]


def test_op11_whole_table(spark, sf_dir, small_docs):
    short = [(d, t) for d, t in small_docs if len(t or "") < 5_000]
    got = {r.doc_id: tuple(r) for r in op11_lyndon_runs(spark, sf_dir).collect()}
    assert len(got) == len(small_docs) and sum(r[1] for r in got.values()) > 0
    assert all(got[d] == plain_digest(d, t) for d, t in short)
