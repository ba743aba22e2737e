"""I-Match document fingerprints.

Terms (lower-cased words) whose document frequency lies in a band of inverse document frequency,
``min_idf <= ln(N / df) <= max_idf``, form the lexicon. A document's distinct lexicon terms are
sorted (by their 64-bit hashes) and hashed once whole and once for each of many random
sub-lexicons of several densities; membership is a hash of term and slot. The fingerprint is the
list of these hashes. Dense subsets break at the first changed term, sparse ones survive many
changes: where a subset meets about one term of two texts, it is equal with the probability of
their Jaccard similarity, so the share of equal sparse slots estimates it.

df counts all documents: tasks count words locally and send (hash, count) sorted in packed blobs,
a group by hash range adds them. A term in the lexicon has df >= N * exp(-max_idf), so there are at
most (mean distinct terms per document) * exp(max_idf) of them whatever N is (for 300 terms a
document 3 million, 24 MB): that proven bound is why the lexicon may be broadcast as one sorted
array.

A document without lexicon terms has the hash of its whole text in slot 0 and nothing else.

Order: ascending doc_id, rows without doc_id last, equal ids by text. Null text counts as empty.
Equal texts have equal fingerprints. An empty table gives no rows."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import NULL_ID, only, pack_small, pack_u64, parts_for, text_bytes, text_or_empty, unpack_small, unpack_u64

#: Slot 0 holds every lexicon term; then PER_SCALE slots with 1/2 of the lexicon, as many with
#: 1/4, and so on.
SCALES, PER_SCALE = 12, 8
SLOTS = 1 + SCALES * PER_SCALE
MIN_IDF, MAX_IDF = math.log(8), math.log(1e4)
_RANGES = 256
DENSITY = np.array([1 << 32] + [1 << (31 - k // PER_SCALE) for k in range(SLOTS - 1)], dtype=np.uint64)
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * k + 3) | 1) & (1 << 64) - 1 for k in range(SLOTS)], dtype=np.uint64)


def terms(text: str) -> set[bytes]:
    return set(text.lower().encode().split())


def term_hashes(words: set[bytes]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.sort(np.array([h(w) for w in words], dtype=np.uint64))


def document_frequencies(docs: DataFrame, flush_terms: int = 400_000) -> DataFrame:
    """(range, keys, counts): packed term hashes in ascending order with their df, a row a range."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: dict[bytes, int] = {}
        for b in batches:
            for text in b.column(0).to_pylist():
                for w in terms(text):
                    df[w] = df.get(w, 0) + 1
                if len(df) >= flush_terms:
                    yield packed(df)
                    df = {}
        if df:
            yield packed(df)

    def packed(df: dict[bytes, int]) -> pa.RecordBatch:
        h = xxhash.xxh3_64_intdigest
        keys = np.array([h(w) for w in df], dtype=np.uint64)
        n = np.array(list(df.values()), dtype=np.uint64)
        order = np.argsort(keys)
        return blobs(keys[order], n[order])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack_u64(x.as_py()) for x in table.column("keys")])
        n = np.concatenate([unpack_small(x.as_py()) for x in table.column("counts")])
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([pack_u64(keys[first])]), pa.array([pack_small(np.add.reduceat(n, first))])], names=["range", "keys", "counts"])])

    schema = "range int, keys binary, counts binary"
    return docs.select("text").mapInArrow(count, schema).groupBy("range").applyInArrow(add, schema)


def blobs(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Sorted keys cut at the borders of the hash ranges."""
    cuts = np.searchsorted(keys, np.arange(1, _RANGES, dtype=np.uint64) << np.uint64(64 - int(math.log2(_RANGES))))
    k, c = np.split(keys, cuts), np.split(n, cuts)
    at = [i for i in range(_RANGES) if len(k[i])]
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([pack_u64(k[i]) for i in at], pa.binary()), pa.array([pack_small(c[i]) for i in at], pa.binary())], names=["range", "keys", "counts"])


def lexicon(docs: DataFrame, n_docs: int, min_idf: float = MIN_IDF, max_idf: float = MAX_IDF) -> np.ndarray:
    """Ascending hashes of the terms in the band. df bounds are exact integers."""
    low, high = math.ceil(n_docs * math.exp(-max_idf) - 1e-9), math.floor(n_docs * math.exp(-min_idf) + 1e-9)

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, c in zip(b.column(1), b.column(2)):
                n = unpack_small(c.as_py())
                keep = unpack_u64(k.as_py())[(n >= max(1, low)) & (n <= high)]
                yield pa.RecordBatch.from_arrays([pa.array([len(keep)], pa.int64()), pa.array([pack_u64(keep)])], names=["n", "keys"])

    parts = document_frequencies(docs).mapInArrow(band, "n long, keys binary").where("n > 0")
    got = [unpack_u64(bytes(r["keys"])) for r in parts.select("keys").collect()]  # bounded: see the module's note
    return np.sort(np.concatenate(got)) if got else np.empty(0, np.uint64)


def fingerprint(text: str, band: np.ndarray) -> np.ndarray:
    """Slot hashes, 0 for an empty slot (a hash of 0 becomes 1)."""
    out = np.zeros(SLOTS, dtype=np.uint32)
    h = term_hashes(terms(text))
    if len(h) and len(band):
        at = np.searchsorted(band, h)
        at[at == len(band)] = 0
        h = h[band[at] == h]
    else:
        h = h[:0]
    if not len(h):
        out[0] = xxhash.xxh32_intdigest(text.encode(), seed=7) or 1
        return out
    mixed = h[None, :] * _ODD[:, None]
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)
    member = mixed < DENSITY[:, None]
    digest = xxhash.xxh32_intdigest
    for k in np.flatnonzero(member.any(axis=1)):
        out[k] = digest(h[member[k]].tobytes(), seed=int(k)) or 1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints. Else the share of equal slots among those not empty on both
    sides, over the scales sparse enough to tell part of a text: from the densest scale on in
    which a quarter of the slots is empty on both sides (all scales if there is none)."""
    if np.array_equal(a, b):
        return 1.0
    used = ((a != 0) | (b != 0))[1:].reshape(SCALES, PER_SCALE)
    same = (a == b)[1:].reshape(SCALES, PER_SCALE) & used
    sparse = np.flatnonzero(used.mean(axis=1) <= 0.75)
    first = int(sparse[0]) if len(sparse) and used[sparse[0] :].any() else 0
    n = np.count_nonzero(used[first:])
    return float(np.count_nonzero(same[first:]) / n) if n else 0.0


def as_text(fp: np.ndarray) -> str:
    return fp.astype(">u4").tobytes().hex()


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_successors(docs: DataFrame, bytes_per_bucket: int = 24 << 20, max_buckets: int = 4096) -> tuple[DataFrame, int]:
    """(bucket, ghost, key, doc_id, text) sorted within partitions, and the number of buckets.
    Buckets are doc_id ranges cut at quantiles; the first document of each range also goes to the
    range before it as a ghost (the very first one to the last), so that every document finds its
    successor in its own bucket. One shuffle of the texts."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("key"), text_or_empty(docs["text"]).alias("text"))
    n = min(max_buckets, parts_for(text_bytes(rows), bytes_per_bucket, 2))  # a range is streamed, not held
    cuts = rows.select(F.percentile_approx("key", [i / n for i in range(1, n)], 100 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    bucket = F.size(F.filter(F.lit(cuts).cast("array<long>"), lambda c: c < F.col("key"))) if cuts else F.lit(0)
    firsts = dict(rows.select(bucket.alias("bucket"), "key").groupBy("bucket").agg(F.min("key")).collect())  # a row a bucket
    order = sorted(firsts)
    before = {firsts[b]: order[i - 1] for i, b in enumerate(order)}  # i = 0: the last bucket
    also = F.lit(None).cast("int")
    if before:
        also = F.create_map(*[F.lit(x) for k, b in before.items() for x in (k, b)])[F.col("key")]
    own = F.struct(bucket.cast("int").alias("bucket"), F.lit(0).alias("ghost"))
    ghost = F.struct(also.cast("int").alias("bucket"), F.lit(1).alias("ghost"))
    placed = rows.withColumn("at", F.explode(F.when(also.isNull(), F.array(own)).otherwise(F.array(own, ghost)))).select("at.bucket", "at.ghost", "key", "doc_id", "text")
    return placed.repartition(len(cuts) + 1, "bucket").sortWithinPartitions("bucket", "ghost", "key", "text"), len(cuts) + 1


def fingerprint_documents(docs: DataFrame, min_idf: float = MIN_IDF, max_idf: float = MAX_IDF) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of
    every document; see the module's note."""
    spark = docs.sparkSession
    plain = only(docs, "doc_id", "text").select(docs["doc_id"], text_or_empty(docs["text"]).alias("text"))
    n_docs = docs.count()
    band = lexicon(plain, n_docs, min_idf, max_idf)
    shared = spark.sparkContext.broadcast(band)
    placed, _ = with_successors(plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = shared.value
        held = None  # (bucket, doc_id, text, fingerprint) that waits for its successor
        done: list[tuple] = []
        for b in batches:
            for bucket, ghost, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                if ghost and (held is None or held[0] != bucket):
                    continue  # a further ghost of the same id
                fp = fingerprint(text, band)
                if held is not None and held[0] == bucket:
                    done.append(finished(held, text, fp))
                held = None if ghost else (bucket, doc_id, text, fp)
                if len(done) >= 1000:
                    yield batch(done)
                    done = []
        if done:
            yield batch(done)

    def finished(held: tuple, following: str, following_fp: np.ndarray) -> tuple:
        _, doc_id, text, fp = held
        edited = edited_text(text, following)
        edited_fp = fingerprint(edited, shared.value)
        return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(fp), as_text(edited_fp), likeness(fp, edited_fp), likeness(fp, following_fp)

    def batch(done: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(kinds)], names=names)

    return placed.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
