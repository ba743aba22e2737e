"""Quality classifier: histogram gradient-boosted trees over document statistics.

Features are figures of the text alone (never labels, language, source or id). Training bins each
feature at quantiles, grows depth-wise trees on gradient and hessian histograms of the logistic
loss, and flattens them into arrays ``feature[t, node]``, ``threshold[t, node]`` and
``leaf[t, leaf]`` of complete binary trees; scoring walks all rows of a batch one level at a time.

The model is fitted in the driver on at most ``max_train_rows`` labelled rows (a documented bound:
20,000 rows of 24 numbers), those with the smallest hash of doc_id among the rows outside the
held-out fold. Everything else is a map over the documents.

Null text counts as empty and gets a score. Labels with null id or quality are left out; labels
that repeat an id with different values count as given. Without labels of both classes every
score is the share of label 1 (0.5 without labels). Rows map one to one; other columns are
ignored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import text_or_empty
from quarry.llm.docstats import base_stats
from quarry.llm.divergence import COMMON_WORDS

_COMMON = frozenset(w.encode() for w in COMMON_WORDS)
FEATURES = (
    "log_words", "log_chars", "lower", "upper", "digit", "blank", "newline", "stop", "bang", "symbol",
    "other_ascii", "non_ascii", "pipe", "mean_word", "long_words", "distinct_words", "top_word", "common_words",
    "repeated_words", "dup_lines", "words_per_line", "sentence_ends", "capital_words", "symbol_words",
)


def features(text: str) -> list[float]:
    data = text.encode()
    words, ids, seen, c, s = base_stats(data)
    n = max(1, len(words))
    chars = max(1, s["word_chars"])
    upper, lower = int(c[65:91].sum()), int(c[97:123].sum())
    per = np.bincount(ids) if len(ids) else np.zeros(1, np.int64)
    names = list(seen)
    common = sum(int(per[k]) for w, k in seen.items() if len(w) < 8 and w.rstrip(b".,;:!?").lower() in _COMMON)
    long = sum(int(per[k]) for w, k in seen.items() if len(w) > 14)
    capital = sum(int(per[k]) for w, k in seen.items() if 65 <= w[0] <= 90)
    marked = sum(int(per[k]) for w, k in seen.items() if w[-1] in b"#*$%&|<>!") if names else 0
    return [
        np.log1p(len(words)), np.log1p(len(data)), lower / chars, upper / chars, int(c[48:58].sum()) / chars,
        int(c[32]) / chars, int(c[10]) / n, int(c[46] + c[44] + c[58] + c[59]) / n, int(c[33] + c[63]) / n, s["n_symbols"] / chars,
        int(c[33:127].sum() - c[48:58].sum() - upper - lower) / chars, int(c[192:].sum()) / chars, int(c[124]) / n, chars / n, long / n, len(seen) / n, int(per.max()) / n, common / n,
        s["n_repeat_words"] / n, s["n_dup_lines"] / max(1, s["n_lines"]), len(words) / max(1, s["n_lines"]), int(c[46]) / n, capital / n, marked / n,
    ]


@dataclass
class TreeEnsemble:
    """Flattened trees: node k's children are 2k+1 and 2k+2; go right where x > threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - len(f)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 120, depth: int = 4, rate: float = 0.15, n_bins: int = 64, l2: float = 1.0, min_child: float = 3.0) -> TreeEnsemble:
    """Depth-wise boosting on feature histograms. Ties go to the lower feature, then lower bin."""
    inner = (1 << depth) - 1
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return TreeEnsemble(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), depth, base)
    m, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) for j in range(k)]
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    n_edges = np.array([len(e) for e in edges])
    valid = np.arange(n_bins)[None, :] < n_edges[:, None]  # split after bin b needs an edge there
    margin = np.full(m, base)
    all_f, all_t, all_v = [], [], []
    cell = np.arange(k) * n_bins + bins
    for _ in range(n_trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        f, t = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(m, dtype=np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (k * n_bins) + cell).ravel()
            gs = np.bincount(at, np.repeat(g, k), width * k * n_bins).reshape(width, k, n_bins).cumsum(axis=2)
            hs = np.bincount(at, np.repeat(h, k), width * k * n_bins).reshape(width, k, n_bins).cumsum(axis=2)
            gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
            gr, hr = gt - gs, ht - hs
            gain = gs**2 / (hs + l2) + gr**2 / (hr + l2) - gt**2 / (ht + l2)
            gain = np.where(valid[None] & (hs >= min_child) & (hr >= min_child), gain, -1.0).reshape(width, -1)
            best = gain.argmax(axis=1)
            for w in range(width):
                if gain[w, best[w]] > 1e-6:
                    j, b = divmod(int(best[w]), n_bins)
                    f[first + w], t[first + w] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(m), f[node]] > t[node])
        slot = node - inner
        v = -rate * np.bincount(slot, g, inner + 1) / (np.bincount(slot, h, inner + 1) + l2)
        margin += v[slot]
        all_f.append(f), all_t.append(t), all_v.append(v)
    return TreeEnsemble(np.array(all_f), np.array(all_t), np.array(all_v), depth, base)


def held_out(doc_id) -> F.Column:
    """The fold that is never learnt from: crc32 of the id as text, mod 5, is 0. Null ids are
    outside it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features_frame(rows: DataFrame) -> DataFrame:
    """doc_id, features, and any further columns of ``rows`` (doc_id, text, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64())), b.column(2)], names=["doc_id", "x", "quality"])

    return rows.mapInArrow(run, "doc_id long, x array<double>, quality int")


def train(docs: DataFrame, labels: DataFrame, max_train_rows: int = 20_000, **options) -> TreeEnsemble:
    ids = labels.select(labels["doc_id"].cast("long").alias("l_id"), labels["quality"].cast("int").alias("quality"))
    ids = ids.where(F.col("l_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("l_id")))
    sample = F.broadcast(ids.orderBy(F.xxhash64("l_id"), "l_id", "quality").limit(max_train_rows))  # bounded
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs["text"]).alias("text")).join(sample, F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "quality")
    got = _features_frame(rows).orderBy("doc_id", "quality", "x").limit(2 * max_train_rows).toArrow()  # repeated ids at most double it
    x = np.array(got.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array(got.column("quality").to_pylist(), dtype=np.float64), **options)


def score_documents(docs: DataFrame, model: TreeEnsemble, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each document: one map over the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column(1).to_pylist()], dtype=np.float64).reshape(-1, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs["text"]).alias("text"), held_out(docs["doc_id"].cast("long")).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted_documents(docs: DataFrame, model: TreeEnsemble, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, all columns kept: one map, no shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t or "") for t in b.column(at).to_pylist()], dtype=np.float64).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
