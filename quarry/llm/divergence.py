"""Quality rules by distribution divergence.

For each language the corpus gives two reference histograms, pooled over all its documents that
pass the base rule: character classes, and common (function) words with one bin for all others.
A document fails when the Jensen-Shannon distance (square root of the divergence in bits, 0 to 1)
to the nearest language reference exceeds a limit, for characters or for common words. A
histogram of n words is rough by about 1 / sqrt(n), so a limit is ``floor + noise / sqrt(n)``, and
each test has a minimum length under which it passes.

References are sums grouped by language: tasks add up bounded vectors, so nothing but a few rows
a language is shuffled. Every value of ``lang`` is a reference, however few words it has (null counts
as one value). The nearest of all references counts, since ``lang`` may be wrong or null. They stay a
table; its rows are broadcast in blocks of about ``BLOCK``, and each further block is one more map
over the written histograms that keeps the least distances.

Null and empty texts have no words and fail the base rule. Rows map one to one; repeated rows and
null ids stay; other columns are ignored. If no document passes the base rule there are no
references and the base rule alone decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import parts_for, saved, text_or_empty
from quarry.llm.docstats import CLASS_OF_BYTE, base_stats

#: Common words of four languages (fixed values; a parameter of the operator).
COMMON_WORDS = tuple(
    dict.fromkeys(
        (
            "the of and to in is was for that by with on as at be it this are or from an a not have has which "
            "der die das und ist von zu mit den ein eine nicht auf für im dem sich des auch es "
            "le la les de des et un une du que est dans en pour qui sur au pas plus par "
            "el los las y del una se por con para su al lo como más o pero sus no"
        ).split()
    )
)

#: Limits and guards (production values).
CHAR_LIMIT = (0.17, 1.0)
WORD_LIMIT = (0.15, 1.5)
MIN_CHARS = 100
MIN_WORDS = 40
#: References that a map holds at once (about 1 KB each).
BLOCK = 2048


def histograms(words: list[bytes], ids: np.ndarray, seen: dict[bytes, int], counts: np.ndarray, common: list[bytes]) -> np.ndarray:
    """Character classes, then common words (folded to lower case, marks at the end dropped) and
    all other words."""
    per_word = np.bincount(ids, minlength=len(seen)) if len(ids) else np.zeros(0, np.int64)
    folded: dict[bytes, int] = {}
    for w, k in seen.items():
        if len(w) <= 8:
            f = w.rstrip(b".,;:!?").lower()
            folded[f] = folded.get(f, 0) + int(per_word[k])
    got = np.array([folded.get(c, 0) for c in common], dtype=np.float64)
    return np.concatenate([counts @ CLASS_OF_BYTE, got, [len(words) - got.sum()]])


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance of histogram p to each row of q."""
    p = p / max(p.sum(), 1e-300)
    q = q / np.maximum(q.sum(axis=1, keepdims=True), 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0.0, 1.0))


def fails_base(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


def language_references(docs: DataFrame, common_words: tuple[str, ...] = COMMON_WORDS) -> DataFrame:
    """lang, bins, a row a language: the pooled histogram of its documents that pass the base rule."""
    common = [w.encode() for w in common_words]
    width = CLASS_OF_BYTE.shape[1] + len(common) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words, ids, seen, counts, s = base_stats(text.encode())
                if not fails_base(s["n_words"], s["n_repeat_words"]):
                    sums[lang] = sums.get(lang, 0) + histograms(words, ids, seen, counts, common).astype(np.int64)
                    if len(sums) >= 1000:
                        yield summed(sums)
                        sums = {}
        yield summed(sums)

    def summed(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([h.tolist() for h in sums.values()], pa.list_(pa.int64()))], names=["lang", "bins"])

    lang = F.coalesce(docs["lang"].cast("string"), F.lit(""))
    parts = docs.select(lang.alias("lang"), text_or_empty(docs["text"]).alias("text")).mapInArrow(run, "lang string, bins array<long>")
    bins = F.array(*[F.sum(F.col("bins")[i]) for i in range(width)])
    return saved(parts.groupBy("lang").agg(bins.alias("bins")), "language-sums")


def judge_quality(docs: DataFrame, common_words: tuple[str, ...] = COMMON_WORDS, char_limit: tuple[float, float] = CHAR_LIMIT, word_limit: tuple[float, float] = WORD_LIMIT, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    char_distance, word_distance of each document. Two maps over the text; no text is shuffled."""
    references = language_references(docs, common_words)
    blocks = parts_for(references.count(), BLOCK, 1)
    block = F.pmod(F.xxhash64("lang"), F.lit(blocks))
    common = [w.encode() for w in common_words]
    k = CLASS_OF_BYTE.shape[1]
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_chars", "bins", "by_char", "by_word"]
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_chars long, bins binary, by_char double, by_word double"

    def distances(h: np.ndarray, refs: np.ndarray, n_chars: int, n_words: int) -> tuple[float | None, float | None]:
        """To the nearest of some references; None where the text is too short or there are none."""
        by_char = float(js_distance(h[:k], refs[:, :k]).min()) if len(refs) and n_chars >= min_chars else None
        by_word = float(js_distance(h[k:], refs[:, k:]).min()) if len(refs) and n_words >= min_words else None
        return by_char, by_word

    def first(refs: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for text in b.column(1).to_pylist():
                    words, ids, seen, counts, s = base_stats(text.encode())
                    h = histograms(words, ids, seen, counts, common)
                    figures = [s[c] for c in names[1:6]]
                    rows.append((*figures, fails_base(s["n_words"], s["n_repeat_words"]), len(text), h.astype("<i8").tobytes() if blocks > 1 else None, *distances(h, refs, len(text), s["n_words"])))
                kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.binary()] + [pa.float64()] * 2
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], names=names)

        return run

    def nearer(refs: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = []
                for n_words, n_chars, bins, *old in zip(*(b.column(c).to_pylist() for c in ("n_words", "n_chars", "bins", "by_char", "by_word"))):
                    new = distances(np.frombuffer(bins, dtype="<i8").astype(np.float64), refs, n_chars, n_words)
                    found.append([min((x for x in pair if x is not None), default=None) for pair in zip(old, new)])
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], *[pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)]], names=names)

        return run

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs["text"]).alias("text"))
    for i in range(blocks):
        held = references.where(block == i).orderBy("lang").collect()  # about BLOCK rows
        refs = np.array([r["bins"] for r in held], dtype=np.float64).reshape(len(held), k + len(common) + 1)
        if i:
            rows = saved(rows, "language-distances")
        rows = rows.mapInArrow(nearer(refs) if i else first(refs), schema)
    by_char, by_word = F.coalesce("by_char", F.lit(0.0)), F.coalesce("by_word", F.lit(0.0))
    rough = 1 / F.sqrt(F.greatest("n_words", F.lit(1)))
    kept = ~F.col("base_failed") & (by_char <= char_limit[0] + char_limit[1] * rough) & (by_word <= word_limit[0] + word_limit[1] * rough)
    return rows.select(*names[:7], kept.alias("kept"), by_char.alias("char_distance"), by_word.alias("word_distance"))
