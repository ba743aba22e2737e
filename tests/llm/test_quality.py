"""op6, op7, op8, op9 and the pipeline."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from conftest import edge_rows, prose
from oracle_check import compare, duck

import corpus_pipeline
from quarry.llm import divergence, docstats, mixing, quality_gbt, url_filter
from quarry.llm.queries import REGISTRY, op7_divergence_rules, op8_quality_trees

WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def base_figures(text):
    words = WORD.findall(text)
    n, hits, spans = len(words), Counter(), set()
    for i in range(n - 7):
        hits[tuple(words[i : i + 8])] += 1
    for i in range(n - 7):
        if hits[tuple(words[i : i + 8])] > 1:
            spans.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return n, sum(map(len, words)), len(regex.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(spans)


def test_op7_base_figures(spark, sf_dir, small_docs):
    got = {r.doc_id: r for r in op7_divergence_rules(spark, sf_dir).collect()}
    assert len(got) == len(small_docs)
    for d, t in small_docs:
        r, want = got[d], base_figures(t or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_repeated_words_by_brute_force():
    r = np.random.default_rng(2)
    for _ in range(200):
        words = [f"w{i}" for i in r.integers(0, 3, r.integers(0, 60))]
        assert docstats.repeated_words(docstats.word_ids([w.encode() for w in words])[0]) == base_figures(" ".join(words))[4]


def test_op7_verdict(spark, small_docs, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = [r for r in op7_divergence_rules(spark, sf_dir).collect() if not r.base_failed and r.doc_id in labels]
    good, bad = ([r.kept for r in got if labels[r.doc_id] == q] for q in (1, 0))
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.2


def test_js_distance():
    p, q = np.array([1.0, 0, 1]), np.array([[0.0, 5, 0], [3, 0, 3], [0, 0, 0]])
    assert divergence.js_distance(p, q)[:2] == pytest.approx([1.0, 0.0])


def test_op7_small_languages(spark, monkeypatch):
    """A language below 0.1 % of the words has its reference, also for a document whose lang is
    null, whether the references are held at once or in blocks."""
    words = {"en": "the of and to in river stone garden".split(), "xx": "ŝaĝa ĉevalo ĵaŭdo ĥoro ĝardeno ŭesto".split()}

    def text(lang, seed):
        r = np.random.default_rng(seed)
        return " ".join(r.choice(words[lang], 60))

    rows = [(i, " ".join(text("en", 100 * i + j) for j in range(20)), "en") for i in range(260)]
    rows += [(1000 + i, text("xx", i), "xx" if i < 4 else None) for i in range(5)]
    rows += [(2000 + i, text("en", 9000 + i), f"l{i}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").where("lang IS NOT NULL OR doc_id >= 1000").repartition(5)
    sizes = Counter()
    for _, t, lang in rows:
        sizes[lang] += len(t.split())
    assert sizes["xx"] < 0.001 * sum(sizes.values())
    at_once = sorted(map(tuple, divergence.judge_quality(docs).collect()))
    assert all(r[7] for r in at_once if 1000 <= r[0] < 2000)
    monkeypatch.setattr(divergence, "BLOCK", 2)
    in_blocks = sorted(map(tuple, divergence.judge_quality(docs).collect()))
    for a, b in zip(at_once, in_blocks, strict=True):
        assert a[:8] == b[:8] and a[8:] == pytest.approx(b[8:], abs=1e-12)


def test_op7_edges(edge_docs, empty_docs):
    got = divergence.judge_quality(edge_docs).collect()
    assert sorted((r.n_words, r.n_repeat_words) for r in got) == sorted((base_figures(t or "")[0], base_figures(t or "")[4]) for _, t, _, _ in edge_rows())
    assert divergence.judge_quality(empty_docs).count() == 0


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_equal_to_sql(spark, sf_dir, name):
    fn, sql = REGISTRY[name]
    assert compare(spark, duck(sf_dir), name, fn, sql, sf_dir)["ok"]


def brute_targets(sizes, weights=(3, 1, 2)):
    """Share, cap, share the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > 2 * sizes[s]}
        if not over:
            return target | {s: w[s] * level for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def check_mix(rows, sources):
    total = Counter()
    for r in rows:
        total[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    want = brute_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], abs=1e-6)
    for s, t in total.items():
        assert t == int(want[s] + 1e-9)


def test_op6_targets(spark, sf_dir, edge_docs, empty_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    check_mix(rows, docs)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7), buckets=3).collect()))
    rows = mixing.mix(edge_docs).collect()
    assert sorted(r.size for r in rows) == sorted(len(WORD.findall(t or "")) for _, t, _, _ in edge_rows())
    check_mix(rows, edge_docs)
    assert mixing.mix(empty_docs).count() == 0 and mixing.mixed_documents(empty_docs).count() == 0
    kept = mixing.mixed_documents(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() > 0
    blank = edge_docs.where("trim(coalesce(text, '')) = ''")
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix(blank).collect())


def test_op6_rows_without_an_id_of_their_own(spark):
    """A third of the rows without doc_id, a third with one: each is taken on its own."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else 100 + i, prose(i // 4, 20 + i % 9), "ab"[i % 2] if i % 5 else None, i) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").coalesce(1)
    taken = mixing.mix(df).collect()
    check_mix(taken, df)
    copies = Counter((r.doc_id, r.source, r.size, math.floor(r.taken / r.size + 0.5)) for r in taken)
    assert len({r.taken for r in taken if r.doc_id is None}) > 3  # not one draw for all
    stood = Counter(r.n for r in mixing.mixed_documents(df).collect())
    got = Counter((d, s, len(WORD.findall(t)), stood[n]) for d, t, s, n in rows)
    assert got == copies


def test_op6_prefers_quality(spark):
    rows = [(i, ("good words here " if i % 2 else "#### 1234 ---- ") * 20, "a" if i < 400 else "b") for i in range(440)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("source = 'a'").collect()
    share = lambda odd: sum(r.taken for r in got if r.doc_id % 2 == odd)
    assert share(1) > share(0)


def auc(score, label):
    order = np.argsort(np.argsort(score))
    pos = label == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_op8_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op8_quality_trees(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    s, y = np.array([x[0] for x in held]), np.array([x[1] for x in held])
    assert auc(s, y) > 0.95


def test_op8_flat_trees_equal_walked_trees():
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    m = quality_gbt.fit(x, y, n_trees=30)
    assert np.mean((m.score(x) >= 0.5) == y) > 0.97
    for i in range(20):
        total = m.base
        for f, t, v in zip(m.feature, m.threshold, m.leaf):
            node = 0
            for _ in range(m.depth):
                node = 2 * node + (2 if x[i, f[node]] > t[node] else 1)
            total += v[node - len(f)]
        assert m.margin(x[i : i + 1])[0] == pytest.approx(total)


def test_op8_edges(spark, edge_docs, empty_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_gbt.score_documents(edge_docs, quality_gbt.train(edge_docs, none)).collect()} == {0.5}
    odd = spark.createDataFrame([(7, 1), (3, 0), (None, 1), (5, None), (40, 1), (40, 0), (12, 0)], "doc_id long, quality int")
    model = quality_gbt.train(edge_docs, odd)
    assert quality_gbt.score_documents(edge_docs, model).count() == len(edge_rows())
    assert quality_gbt.score_documents(empty_docs, model).count() == 0
    assert quality_gbt.accepted_documents(edge_docs, model, 0.0).columns == edge_docs.columns
    assert quality_gbt.accepted_documents(edge_docs, model, 0.0).count() == len(edge_rows())
    assert quality_gbt.accepted_documents(edge_docs, model, 1.1).count() == 0


URLS = [None, "", "no scheme", "http://", "http://org/", "https://A.B.ORG/x?y=/z", "http://example.org/es/1", "http://x.Example.ORG/en/12?q", "http://notexample.org/es/", "http://example.org", "http://example.com/fr/", "http://example.com/de/#a", "http://a.com?u=/de/", "http://com/de/x", "ftp://x.com/DE/", "http://ÉX.org/", "http://a://b.org/", "http://example.org/en/1", "http://example.org/en/2"]


def plain_verdict(url):
    m = regex.search(r"://([^/?#]*)([^?#]*)", url or "", regex.S)
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    best = None
    for rule, action in url_filter.OP9_RULES.items():
        h, p = url_filter.split_rule(rule)
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[0])):
            best = rule, action
    return (host, path, *(best or (None, "allow")))


def test_op9_edges(spark):
    df = spark.createDataFrame([(i if i else None, u, "z") for i, u in enumerate(URLS)] + [(5, URLS[5], "z")], "page_id long, url string, host string")
    got = sorted((tuple(r)[1:] for r in url_filter.judge_urls(df, url_filter.OP9_RULES).collect()), key=str)
    assert got == sorted((plain_verdict(u) for u in [*URLS, URLS[5]]), key=str)
    assert url_filter.judge_urls(df.limit(0), url_filter.OP9_RULES).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(df, {}, default="block").collect()} == {"block"}


def test_op9_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda x: len(x))
    rules = {f"h{i}.org/": "block" for i in range(10)}
    url_filter.RuleArray.build(rules, str(tmp_path), "r")
    a = url_filter.RuleArray(str(tmp_path), "r")
    assert isinstance(a.keys, np.memmap)
    hit = a.find([b"h3.org/", b"h9.org/", b"hx.org/", b"h3.org"])
    assert [None if k < 0 else a.strings[a.offsets[k] : a.offsets[k + 1]].tobytes() for k in hit] == [b"h3.org/", b"h9.org/", None, None]


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality_gbt.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = {r.doc_id: r.predicted for r in quality_gbt.score_documents(docs, model).collect()}
    from test_dedup import brute_components, brute_dedup

    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if score[r.doc_id]]
    rows = [r for r, (_, c, _) in zip(rows, brute_components(rows, 5, 80)) if c == r[0]]
    left = {}
    for (d, t), (_, _, _, sha) in zip(rows, brute_dedup(rows)):
        left[d] = sha
    out = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, out, sf_dir)
        assert out.dtypes == docs.dtypes
    import hashlib

    got = {r.doc_id: r.text for r in out.collect()}
    assert sorted(got) == sorted(left)
    sure = [d for d in got if hashlib.sha256(got[d].encode()).hexdigest() == left[d]]
    assert len(sure) >= 0.95 * len(got)  # the others lost characters cut in the middle
    final = corpus_pipeline.run(spark, sf_dir).collect()
    counts = Counter(r.doc_id for r in final)
    assert set(counts) <= set(got) and max(counts.values()) <= 2 and all(r.lossless for r in final)


def test_pipeline_of_nothing(spark, empty_docs, sf_dir):
    out = empty_docs
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, sf_dir)
    assert out.count() == 0
