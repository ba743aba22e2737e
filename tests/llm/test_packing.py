"""op12: pieces against the tokenizers library, packing against its capacities and the optimum."""

import zlib

import numpy as np
import pytest
from conftest import edge_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import vector_packing as vp
from quarry.llm.queries import op12_vector_packing, tokenizer

WORD = tokenizer("word_bpe_49k.json")
CAPACITIES = [vp.Capacity(20), vp.Capacity(20, documents=3), vp.Capacity(20, attention=150), vp.Capacity(20, 4, 200)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


def plain_pieces(library, doc_id, text, seq_len):
    ids = library.encode(text or "", add_special_tokens=False).ids + [0]
    for k, at in enumerate(range(0, len(ids), seq_len)):
        part = ids[at : at + seq_len]
        yield doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())


def check_bins(lengths, bins, offsets, capacity):
    tokens, documents, attention = capacity.limits
    assert sorted(set(bins)) == list(range(len(set(bins))))
    for b in set(bins):
        own = sorted((o, n) for x, o, n in zip(bins, offsets, lengths) if x == b)
        at = 0
        for o, n in own:
            assert o == at
            at += n
        assert at <= tokens and len(own) <= documents and sum(n * n for _, n in own) <= attention


def fewest(lengths, capacity):
    """The least number of bins, by trying every placement."""
    tokens, documents, attention = capacity.limits
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k, (t, d, a) in enumerate(bins):
            n = lengths[i]
            if t + n <= tokens and d < documents and a + n * n <= attention and bins.index((t, d, a)) == k:
                place(i + 1, [*bins[:k], (t + n, d + 1, a + n * n), *bins[k + 1 :]])
        place(i + 1, [*bins, (lengths[i], 1, lengths[i] ** 2)])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9), st.sampled_from(CAPACITIES), st.sampled_from(["norm", "dot"]), st.sampled_from([None, (1.0, 1.0, 1.0), (1.0, 0.0, 0.0)]))
def test_best_fit_is_close_to_the_optimum(lengths, capacity, rule, weights):
    bins, offsets = vp.best_fit(np.array(lengths, np.int64), capacity, weights, rule)
    check_bins(lengths, bins.tolist(), offsets.tolist(), capacity)
    assert len(set(bins.tolist())) <= fewest(sorted(lengths, reverse=True), capacity) + 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_one_capacity_is_best_fit_decreasing(lengths):
    left, want = [], 0
    for n in sorted(lengths, reverse=True):
        room = [x for x in left if x >= n]
        if room:
            left[left.index(min(room))] -= n
        else:
            left.append(20 - n)
            want += 1
    bins, _ = vp.best_fit(np.array(lengths, np.int64), vp.Capacity(20), (1.0, 0.0, 0.0))
    assert len(set(bins.tolist())) == want


def test_too_large_a_piece_is_an_error():
    with pytest.raises(ValueError):
        vp.best_fit(np.array([5, 21]), vp.Capacity(20))
    with pytest.raises(ValueError):
        vp.best_fit(np.array([15]), vp.Capacity(20, attention=200))


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_edge_rows(spark, edge_docs, library, rule):
    pieces = vp.token_pieces(edge_docs, WORD, 0, seq_len=64, with_ids=True)
    packed = vp.pack(pieces, vp.Capacity(64, documents=5, attention=3000 + 64 * 64), rule=rule, group_pieces=40).cache()
    got = packed.collect()
    key = lambda r: repr(tuple(r))
    want = [p for r in edge_rows() for p in plain_pieces(library, r[0], r[1], 64)]
    assert sorted((r[:5] for r in got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for rows in by.values():
        check_bins([r.length for r in rows], [0] * len(rows), [r.offset for r in rows], vp.Capacity(64, documents=5, attention=3000 + 64 * 64))
    for s in vp.sequences(packed).collect():
        rows = sorted(by[s.sequence_id], key=lambda r: r.offset)
        assert s.ids == [i for r in rows for i in r.ids] and s.lengths == [r.length for r in rows]


def test_empty_table(empty_docs):
    assert vp.pack(vp.token_pieces(empty_docs, WORD, 0)).count() == 0


def test_rows_that_are_all_alike_are_dealt_evenly(spark):
    same = spark.createDataFrame([(None, "one two three")] * 3000, "doc_id long, text string").repartition(4)
    got = vp.pack(vp.token_pieces(same, WORD, 0, seq_len=40), vp.Capacity(40), group_pieces=500).selectExpr("sequence_id >> 32 AS g", "sequence_id").groupBy("g").count().collect()
    assert len(got) == 6 and max(r["count"] for r in got) < 700


def test_op12_whole_table(spark, sf_dir, small_docs, library):
    got = [tuple(r) for r in op12_vector_packing(spark, sf_dir).collect()]
    want = [p for d, t in small_docs for p in plain_pieces(library, d, t, 2048)]
    assert sorted(r[:5] for r in got) == sorted(want)
    names = {s: i for i, s in enumerate(sorted({r[5] for r in got}))}
    check_bins([r[3] for r in got], [names[r[5]] for r in got], [r[6] for r in got], vp.Capacity(2048))
    total = sum(r[3] for r in got)
    assert len(names) <= 1.01 * -(-total // 2048) + 1
