"""op2 and op4 against brute force."""

import hashlib
import random

import numpy as np
import pytest
from conftest import edge_rows, prose

from quarry.llm import common, ngram_join, repeats, suffix_dedup
from quarry.llm.queries import op2_suffix_dedup, op4_ngram_join


def test_packed_keys():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 4000):
        v = np.sort(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        assert np.array_equal(common.unpack_u64(common.pack_u64(v)), v)
        assert np.array_equal(common.unpack_small(common.pack_small(v[::-1])), v[::-1])


def test_anchor_of_each_window():
    r = random.Random(3)
    for case in range(120):
        n = r.randrange(90, 400)
        text = bytes(r.choice(b"ab") for _ in range(n)) if case % 2 else b"a" * n
        data = np.frombuffer(text, dtype=np.uint8)
        _, p, first, last = suffix_dedup.anchors(data, 100, 40)
        own = {i: a for a, f, l in zip(p.tolist(), first.tolist(), last.tolist()) for i in range(f, l + 1)}
        assert sorted(own) == list(range(max(0, n - 99)))
        if own:
            h = suffix_dedup.gram_hashes(data, 40)
            assert all(a == i + int(np.argmin(h[i : i + 61] >> np.uint64(24))) for i, a in own.items())


def test_loser_tree_merges_and_knows_prefixes():
    r = random.Random(4)
    for _ in range(150):
        every, runs = [], []
        for k in range(r.randrange(9)):
            keys = sorted({bytes(r.choice(b"ab") for _ in range(r.randrange(1, 14))) for _ in range(r.randrange(30))})
            every += keys
            runs.append(suffix_dedup.read_run(suffix_dedup.write_run(keys, list(range(len(keys))), [k] * len(keys))))
        got = list(suffix_dedup.LoserTree(runs))
        assert [g[0] for g in got] == sorted(every)
        assert all(b[3] == suffix_dedup.common_prefix(a[0], b[0]) for a, b in zip(got, got[1:]))


def brute_dedup(rows, width=100):
    """rows in order; per row (n_bytes, n_removed, n_spans, sha256)."""
    seen, out = set(), []
    for _, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if w in seen:
                gone[i : i + width] = True
            seen.add(w)
        left = bytes(np.frombuffer(b, dtype=np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (common.NULL_ID if r[0] is None else r[0], (r[1] or "").encode()))


def dedup(df, **options):
    return sorted(((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_digest(df).collect()))


def test_op2_whole_table(spark, sf_dir, small_docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op2_suffix_dedup(spark, sf_dir).collect()}
    assert got == {d: w for (d, _), w in zip(small_docs, brute_dedup(small_docs))}


@pytest.fixture
def tiny_parts(monkeypatch):
    """Many small chunks and ranges, so that common grams are cut between ranges."""
    chunks = repeats.chunks_of
    for module in (suffix_dedup, ngram_join):
        monkeypatch.setattr(module, "chunks_of", lambda docs: chunks(docs, 3000))
    monkeypatch.setattr(suffix_dedup.repeated_spans, "__defaults__", (100, 40, 20))


def passages(n):
    """A passage that all documents share, behind and before texts of their own, and part copies."""
    shared, r = prose(77, 60), random.Random(9)
    rows = []
    for i in range(n):
        cut = r.randrange(0, 120)
        rows.append((i * 3 % n, prose(100 + i, r.randrange(1, 30)) + shared[cut : len(shared) - r.randrange(0, 90)] + prose(300 + i, r.randrange(0, 25))))
    return rows


def test_op2_cut_grams(spark, tiny_parts, monkeypatch):
    cut = []
    split = suffix_dedup.splitters
    monkeypatch.setattr(suffix_dedup, "splitters", lambda *a: cut.append(split(*a)) or cut[-1])
    rows = passages(120)
    got = dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert cut[0][1]  # some gram is cut
    assert got == sorted(brute_dedup(in_order(rows)))


def test_few_samples_and_many_ranges():
    """A sampled key that stands for many ranges cuts no gram; one gram with many keys is cut."""
    few = [(1000, [bytes([65 + i]) * 40 for i in range(16)])]
    borders, cut = suffix_dedup.splitters(few, 100, 8)
    assert not cut and borders == [bytes([65 + i]) * 8 for i in range(16)]
    hot = [(1000, [b"g" * 8 + bytes([i]) * 30 for i in range(50)] + [b"a" * 38, b"z" * 38])]
    borders, cut = suffix_dedup.splitters(hot, 10, 8)
    assert cut == {b"g" * 8} and len(borders) >= 9 and borders == sorted(borders)


@pytest.mark.parametrize("most", [3, 12])
def test_op2_with_few_samples(spark, tiny_parts, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_SAMPLES", most)
    rows = passages(60)
    assert dedup(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(brute_dedup(in_order(rows)))


def test_op2_edges(edge_docs, empty_docs, tiny_parts):
    rows = in_order([(d, t) for d, t, _, _ in edge_rows()])
    assert dedup(edge_docs) == sorted(brute_dedup(rows))
    assert suffix_dedup.dedup_digest(empty_docs).count() == 0
    kept = suffix_dedup.dedup_documents(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == len(rows)
    assert suffix_dedup.dedup_documents(empty_docs).count() == 0


def test_one_id_makes_no_large_chunk(spark, tiny_parts):
    """A third of the rows without doc_id, a third with one doc_id, copies of one text among both."""
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else 1000 + i, prose(1 if i % 5 == 0 else 50 + i, 25)) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    chunks, n, *_ = suffix_dedup.chunks_of(df)
    sizes = [r.n for r in chunks.selectExpr("chunk", "octet_length(text) AS b").groupBy("chunk").agg({"b": "sum"}).toDF("chunk", "n").collect()]
    assert n > 8 and sum(sizes) == sum(len(t) for _, t in rows) and max(sizes) < 4 * 3000
    assert dedup(df) == sorted(brute_dedup(in_order(rows)))
    left = {r.kept_sha256 for r in suffix_dedup.dedup_digest(df).collect()}
    texts = [r.text for r in suffix_dedup.dedup_documents(df).collect()]
    assert len(texts) == len(rows) and {hashlib.sha256(t.encode()).hexdigest() for t in texts} == left
    got = ngram_join.similarity_components(df, 3, 90).select("n_shingles", "component_id", "n_links").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_components(rows, 3, 90)))
    kept = ngram_join.one_of_each_group(df, 3, 90).where("doc_id = 5").collect()
    assert len(kept) == len({r.text for r in kept}) == len({t for d, t in rows if d == 5})


def test_op2_keeps_columns_and_text(spark):
    long = prose(5, 100)
    df = spark.createDataFrame([(1, long, "s", 3), (2, long + "é tail", "t", 4)], "doc_id long, text string, source string, n_chars int")
    got = sorted(tuple(r) for r in suffix_dedup.dedup_documents(df).collect())
    assert got[0] == (1, long, "s", len(long))
    assert got[1] == (2, "é tail", "t", 6)


def brute_components(rows, k, percent):
    """(n_shingles, component_id, n_links) of each row."""
    sets = []
    for _, t in rows:
        w = [x.lower() for x in (t or "").encode().split()]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                root[top(i)] = top(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [(len(sets[i]), None if d is None else least[top(i)], links[i]) for i, (d, _) in enumerate(rows)]


def joined(df, k, percent, **options):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_join.similarity_components(df, k, percent, **options).collect()), key=str)


def test_op4_whole_table(spark, sf_dir, small_docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in op4_ngram_join(spark, sf_dir).collect()}
    assert got == {d: w for (d, _), w in zip(small_docs, brute_components(small_docs, 3, 90))}


def near_copies(n):
    """Chains and clusters around the threshold."""
    r, rows = random.Random(6), []
    for g in range(6):
        words = prose(500 + g, 120).split()
        for i in range(n):
            for _ in range(r.randrange(0, 5)):
                words[r.randrange(len(words))] = f"edit{r.randrange(10**6)}"
            rows.append((1000 - len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("k,percent,listed,block", [(3, 90, 48, 512), (5, 80, 48, 512), (3, 60, 1, 3), (3, 80, 6, 5), (5, 60, 0, 7)])
def test_op4_near_copies(spark, tiny_parts, k, percent, listed, block):
    rows = near_copies(14) + passages(40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(((d, *w) for (d, _), w in zip(rows, brute_components(rows, k, percent))), key=str)
    assert joined(df, k, percent, listed=listed, block=block) == want


def test_op4_edges(edge_docs, empty_docs, tiny_parts):
    rows = [(d, t) for d, t, _, _ in edge_rows()]
    want = sorted(((d, *w) for (d, _), w in zip(rows, brute_components(rows, 3, 90))), key=str)
    assert joined(edge_docs, 3, 90) == want
    assert ngram_join.similarity_components(empty_docs, 3, 90).count() == 0


def test_prefixes_share_a_token_under_every_order():
    r = random.Random(8)
    for _ in range(300):
        a = {r.randrange(1, 1 << 60) for _ in range(r.randrange(1, 80))}
        b = set(a)
        for _ in range(r.randrange(0, 9)):
            b.discard(r.choice(sorted(a)))
            b.add(r.randrange(1, 1 << 60))
        if not b or 100 * len(a & b) < 80 * len(a | b):
            continue
        df = {x: 1 + (x in a and x in b) + r.randrange(0, 5) * (x in a and x in b) for x in a | b}
        pa_, pb = (ngram_join.prefixes(s, np.array([df[int(x)] for x in s], dtype=np.uint64), 80) for s in (np.array(sorted(x), dtype=np.uint64) for x in (a, b)))
        assert all(set(x.tolist()) & set(y.tolist()) for x, y in zip(pa_, pb))


def first_of_each_group(rows, k, percent):
    """The rows (id, text) that stay: rows without id are documents like all others."""
    named = [(i, t) for i, (_, t) in enumerate(rows)]
    stay, found = [], brute_components(named, k, percent)
    for c in {x[1] for x in found}:
        group = [i for i, x in enumerate(found) if x[1] == c]
        stay.append(min(group, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, hashlib.md5((rows[i][1] or "").encode()).hexdigest() if len(group) > 1 else "")))
    return sorted(map(repr, (rows[i] for i in stay)))


def test_one_of_each_group(spark, edge_docs, empty_docs):
    kept = ngram_join.one_of_each_group(edge_docs)
    assert kept.columns == edge_docs.columns
    got = sorted(repr((r.doc_id, r.text)) for r in kept.collect())
    assert got == first_of_each_group([(d, t) for d, t, _, _ in edge_rows()], 5, 80)
    assert ngram_join.one_of_each_group(empty_docs).count() == 0


@pytest.mark.parametrize("listed,block", [(48, 512), (1, 3)])
def test_one_of_each_group_without_ids(spark, tiny_parts, listed, block):
    """A third of the rows without doc_id, a third with one, copies and near copies among all."""
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else d, t.upper() if i % 7 == 0 else t) for i, (d, t) in enumerate(near_copies(9) + [(0, t) for _, t in near_copies(3)])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(repr((r.doc_id, r.text)) for r in ngram_join.one_of_each_group(df, 5, 80, listed, block).collect())
    assert got == first_of_each_group(rows, 5, 80)


def test_copies_without_id_leave_the_one_with_it(spark):
    df = spark.createDataFrame([(None, prose(1, 60))] * 3 + [(9, prose(1, 60)), (None, None), (None, "")], "doc_id long, text string")
    assert sorted(repr(tuple(r)) for r in ngram_join.one_of_each_group(df).collect()) == sorted(map(repr, [(9, prose(1, 60)), (None, None), (None, "")]))


def test_size_classes_lose_no_link(spark):
    """Sets of very different sizes that share their words: blocks of a size class meet those of it and
    its neighbours only."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[: 4 + 3 * i])) for i in range(120)]
    nodes = spark.createDataFrame(rows, "doc_id long, text string")
    got = joined(nodes, 1, 90, listed=0, block=4)
    assert got == sorted(((d, *w) for (d, _), w in zip(rows, brute_components(rows, 1, 90))), key=str)
