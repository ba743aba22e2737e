"""op1, op7 and op8 against plain re-implementations that share nothing with the operators but their
fixed values."""

import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import edge_rows

from quarry.llm import divergence, imatch, quality_gbt
from quarry.llm.queries import op1_imatch, op7_divergence_rules

BITS = (1 << 64) - 1
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- I-Match -------------------------------------------------------------------------------------

def plain_fingerprint(text, lexicon):
    """Slot 0: all lexicon terms; then eight slots each for a half, a quarter... of the lexicon."""
    terms = sorted(h for h in {xxhash.xxh3_64_intdigest(w) for w in text.lower().encode().split()} if h in lexicon)
    if not terms:
        return [xxhash.xxh32_intdigest(text.encode(), seed=7) or 1] + [0] * 96
    slots = []
    for k in range(97):
        factor = (0x9E3779B97F4A7C15 * (2 * k + 3) | 1) & BITS
        share = 1 << 32 if k == 0 else 1 << (31 - (k - 1) // 8)
        mine = []
        for h in terms:
            x = h * factor & BITS
            x = ((x ^ x >> 31) * 0xD6E8FEB86659FD93 & BITS) >> 32
            if x < share:
                mine.append(h)
        slots.append((xxhash.xxh32_intdigest(b"".join(h.to_bytes(8, "little") for h in mine), seed=k) or 1) if mine else 0)
    return slots


def plain_likeness(a, b):
    if a == b:
        return 1.0
    scales = [[(x, y) for x, y in zip(a[1 + 8 * s : 9 + 8 * s], b[1 + 8 * s : 9 + 8 * s]) if x or y] for s in range(12)]
    first = next((s for s in range(12) if len(scales[s]) <= 6), 0)
    if not any(scales[first:]):
        first = 0
    used = [p for s in scales[first:] for p in s]
    return sum(x == y for x, y in used) / len(used) if used else 0.0


def test_op1_by_hand(spark, sf_dir, small_docs):
    docs = [(d, t or "") for d, t in sorted(small_docs)]
    df = Counter(w for _, t in docs for w in set(t.lower().encode().split()))
    n = len(docs)
    lexicon = {xxhash.xxh3_64_intdigest(w) for w, c in df.items() if math.log(8) - 1e-9 <= math.log(n / c) <= math.log(1e4) + 1e-9}
    got = {r.doc_id: r for r in op1_imatch(spark, sf_dir).collect()}
    assert len(got) == n and imatch.SLOTS == 97
    prints = [plain_fingerprint(t, lexicon) for _, t in docs]
    for i, (d, t) in enumerate(docs):
        following = docs[(i + 1) % n][1]
        half = len(t) // 2
        edited = plain_fingerprint(t[: len(t) - half] + following[:half], lexicon)
        r = got[d]
        assert r.fingerprint == "".join(f"{x:08x}" for x in prints[i]) and r.edited_fingerprint == "".join(f"{x:08x}" for x in edited)
        assert r.near_edited == pytest.approx(plain_likeness(prints[i], edited)) and r.near_next == pytest.approx(plain_likeness(prints[i], prints[(i + 1) % n]))


# ---- divergence rules ------------------------------------------------------------------------------

def plain_histograms(text):
    chars = Counter()
    for c in text:
        if c >= "\x80":
            chars["other"] += 1
        elif c.islower():
            chars["lower"] += 1
        elif c.isupper():
            chars["upper"] += 1
        elif c.isdigit():
            chars["digit"] += 1
        elif c == "\n":
            chars["line"] += 1
        elif c in " \t\r\x0b\x0c":
            chars["blank"] += 1
        else:
            chars["stop" if c in ".,;:" else "bang" if c in "!?" else "symbol" if c in "#*$%&|<>" else "ascii"] += 1
    common, words = set(divergence.COMMON_WORDS), Counter()
    for w in WORD.findall(text):
        folded = "".join(c.lower() if c < "\x80" else c for c in w.rstrip(".,;:!?"))
        words[folded if len(w.encode()) <= 8 and folded in common else None] += 1
    return chars, words


def plain_distance(p, q):
    a, b = sum(p.values()), sum(q.values())
    total = 0.0
    for k in {*p, *q}:
        x, y = p[k] / a if a else 0.0, q[k] / b if b else 0.0
        m = (x + y) / 2
        total += (x * math.log2(x / m) if x else 0.0) / 2 + (y * math.log2(y / m) if y else 0.0) / 2
    return math.sqrt(min(1.0, max(0.0, total)))


def plain_base(text):
    words = WORD.findall(text)
    hits = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if hits[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words) < 20 or 100 * len(covered) > 30 * len(words), len(words)


def check_rules(rows, got):
    """``rows``: (doc_id, text, lang)."""
    references = {}
    for _, t, lang in rows:
        if not plain_base(t or "")[0]:
            pools = references.setdefault(lang or "", (Counter(), Counter()))
            for pool, h in zip(pools, plain_histograms(t or "")):
                pool.update(h)
    want = []
    for d, t, _ in rows:
        t = t or ""
        failed, n = plain_base(t)
        h = plain_histograms(t)
        by_char = min((plain_distance(h[0], r[0]) for r in references.values()), default=0.0) if len(t) >= 100 else 0.0
        by_word = min((plain_distance(h[1], r[1]) for r in references.values()), default=0.0) if n >= 40 else 0.0
        kept = not failed and by_char <= 0.17 + 1.0 / math.sqrt(max(1, n)) and by_word <= 0.15 + 1.5 / math.sqrt(max(1, n))
        want.append((d, n, failed, kept, round(by_char, 9), round(by_word, 9)))
    assert sorted(((r.doc_id, r.n_words, r.base_failed, r.kept, round(r.char_distance, 9), round(r.word_distance, 9)) for r in got), key=repr) == sorted(want, key=repr)


def test_op7_by_hand(spark, sf_dir, edge_docs):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    check_rules(rows, op7_divergence_rules(spark, sf_dir).collect())
    check_rules([(d, t, lang) for d, t, _, lang in edge_rows()], divergence.judge_quality(edge_docs).collect())


# ---- boosted trees ---------------------------------------------------------------------------------

def plain_score(model, text):
    """Every tree walked by itself, on features counted here."""
    data, words = text.encode(), [w.encode() for w in WORD.findall(text)]
    lines = [x for x in data.split(b"\n") if x.split()]
    n, chars = max(1, len(words)), max(1, sum(len(w.decode()) for w in words))
    count = lambda pattern: len(re.findall(pattern, text))
    share = lambda keep: sum(map(keep, words)) / n
    hits = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if hits[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    common = {w.encode() for w in divergence.COMMON_WORDS}
    upper, lower, digit = count("[A-Z]"), count("[a-z]"), count("[0-9]")
    x = [
        math.log1p(len(words)), math.log1p(len(data)), lower / chars, upper / chars, digit / chars, count(" ") / chars, count("\n") / n, count("[.,:;]") / n, count("[!?]") / n,
        count(r"[#*$%&|<>]") / chars, (count("[!-~]") - digit - upper - lower) / chars, count(r"[^\x00-\x7f]") / chars, count(r"\|") / n, chars / n,
        share(lambda w: len(w) > 14), len(set(words)) / n, max(Counter(words).values(), default=0) / n, share(lambda w: len(w) < 8 and w.rstrip(b".,;:!?").lower() in common),
        len(covered) / n, (len(lines) - len(set(lines))) / max(1, len(lines)), len(words) / max(1, len(lines)), count(r"\.") / n, share(lambda w: 65 <= w[0] <= 90),
        share(lambda w: w[-1:] in {bytes([c]) for c in b"#*$%&|<>!"}),
    ]
    margin = model.base
    for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
        node = 0
        while node < len(f):
            node = 2 * node + (2 if x[f[node]] > t[node] else 1)
        margin += leaf[node - len(f)]
    return 1 / (1 + math.exp(-margin))


def test_op8_by_hand(spark, sf_dir, edge_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality_gbt.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert len(model.feature) > 10
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    for r in quality_gbt.score_documents(docs, model).collect():
        assert r.score == pytest.approx(plain_score(model, texts[r.doc_id]), abs=1e-9)
    got = sorted(round(r.score, 9) for r in quality_gbt.score_documents(edge_docs, model).collect())
    assert got == pytest.approx(sorted(round(plain_score(model, t or ""), 9) for _, t, _, _ in edge_rows()), abs=1e-8)


def test_boosting_lowers_the_loss_by_the_best_split():
    """The first tree's root splits where the gain over all features and borders is greatest."""
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 3))
    y = ((x[:, 1] > 0.2) ^ (r.random(200) < 0.05)).astype(float)
    model = quality_gbt.fit(x, y, n_trees=1, depth=1)
    g, h = y.mean() - y, np.full(200, y.mean() * (1 - y.mean()))
    gain = lambda j, t: sum(g[m].sum() ** 2 / (h[m].sum() + 1.0) for m in (x[:, j] <= t, x[:, j] > t)) - g.sum() ** 2 / (h.sum() + 1.0)
    best = max((gain(j, t), -j, -t) for j in range(3) for t in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1])))
    assert (int(model.feature[0][0]), float(model.threshold[0][0])) == (-best[1], -best[2])
