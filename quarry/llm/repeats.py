"""Which keys of a chunk of documents occur elsewhere in the corpus, and how often.

Used by the n-gram join (keys: shingles) and the suffix-array dedup (keys: anchor grams). The
documents are dealt into chunks by a hash of doc_id; a chunk is what one task holds at a time. The
rows of an id that would fill much of a chunk (no id counts as one) are numbered by a distributed
sort and dealt by id and number, so no id makes a chunk large.

1. ``keys(chunk)`` gives its 64-bit keys. Their upper bits, as many as keep chance collisions under
   one key in a thousand for this much text, leave the chunk distinct, counted, sorted and cut at
   ranges, as packed blobs: a key costs a few bytes and a chunk names it once, however often it
   occurs there, so a hot key arrives at most once a chunk. A collision can only raise a total.
2. A range adds the counts and sends each chunk back those of its keys whose total is two or more.
3. ``use(chunk, keys, totals)`` goes through the same chunk again with that dictionary.

Steps 1 and 3 read the same exchange of the texts; Spark plans it once and reuses it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import NULL_ID, pack_small, pack_u64, parts_for, saved, text_or_empty, unpack_small, unpack_u64

_BLOBS = "range int, chunk int, keys binary, counts binary"


#: What a row weighs besides its text, and the bytes of a text that lead the order of an id's rows.
ROW_BYTES, HEAD = 64, 256


def chunk_of(n: int, *by: str | Column) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(n)).cast("int").alias("chunk")


def chunks_of(docs: DataFrame, chunk_bytes: int | None = None) -> tuple[DataFrame, int, int, DataFrame | None]:
    """(chunk, doc_id, key, sub, text, row), the number of chunks, the bits of a key that count, and
    the keys whose rows are dealt apart, if any: 8 MB of text a chunk, more (up to 256 MB) once there
    would be over 2048 of them. ``row`` has all columns but the text; ``sub`` numbers the rows of a
    key that is dealt apart and is null for others."""
    key, others = docs["doc_id"].cast("long"), [docs[c] for c in docs.columns if c != "text"]
    rows = docs.select(key.alias("doc_id"), F.coalesce(key, F.lit(NULL_ID)).alias("key"), text_or_empty(docs["text"]).alias("text"), F.struct(*others).alias("row"))
    sizes = rows.groupBy("key").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n"))
    weight = F.when(F.col("n") > 1, F.col("bytes") + ROW_BYTES * F.col("n"))
    found = sizes.agg(F.sum("bytes").alias("total"), F.max(weight).alias("most")).first()
    total = int(found["total"] or 0)
    each = chunk_bytes or min(256 << 20, max(8 << 20, total // 2048))
    n = parts_for(total, each)
    bits = min(64, max(32, total.bit_length() + 10))
    names = ["doc_id", "key", "sub", "text", "row"]
    whole = rows.withColumn("sub", F.lit(None).cast("long")).select(chunk_of(n, "key"), *names)
    if (found["most"] or 0) <= each // 4:
        return whole, n, bits, None
    heavy = saved(sizes.where(weight > each // 4).select("key"), "heavy-keys")  # a few a chunk
    apart = _numbered_rows(rows.join(F.broadcast(heavy), "key", "left_semi"), n).select(chunk_of(n, "key", "sub"), *names)
    return whole.join(F.broadcast(heavy), "key", "left_anti").select("chunk", *names).unionByName(apart), n, bits, heavy


def _numbered_rows(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` with ``sub``: the number of rows of the same key that come before by the head of the
    text, its md5, and the row's place. Neither a key nor copies of a text make a range large."""
    rows = saved(rows.withColumn("place", F.monotonically_increasing_id()), "heavy-rows")
    data = F.col("text").cast("binary")
    order = ["key", "head", "digest", "place"]
    small = rows.select("key", F.substring(data, 1, HEAD).alias("head"), F.md5(data).alias("digest"), "place")
    small = small.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranked = saved(small.select("key", "place", F.monotonically_increasing_id().alias("rank")), "heavy-order").withColumn("part", F.shiftright("rank", 33))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranked.groupBy("key", "part").agg(F.min("rank").alias("least"), F.count("*").alias("n"))
    starts = starts.select("key", "part", (F.col("least") - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("least"))
    subs = ranked.join(F.broadcast(starts), ["key", "part"]).select("place", (F.col("rank") - F.col("least")).alias("sub"))  # starts: a row a key and range
    return rows.join(subs, "place")


def with_repeats(rows: DataFrame, n_chunks: int, bits: int, keys: Callable[[pa.Table], np.ndarray], use: Callable[[pa.Table, "Totals"], pa.Table], schema: str) -> DataFrame:
    cut = max(5, (n_chunks - 1).bit_length())
    borders = np.arange(1, 1 << cut, dtype=np.uint64) << np.uint64(bits - cut)

    def blobs(chunk: np.ndarray, key: list[np.ndarray], n: list[np.ndarray], at: np.ndarray) -> pa.Table:
        return pa.table(
            [pa.array(at, pa.int32()), pa.array(chunk, pa.int32()), pa.array([pack_u64(k) for k in key], pa.binary()), pa.array([pack_small(c) for c in n], pa.binary())],
            names=["range", "chunk", "keys", "counts"],
        )

    def out(key: tuple, table: pa.Table) -> pa.Table:
        k, n = np.unique(keys(table) >> np.uint64(64 - bits), return_counts=True)
        cuts = np.searchsorted(k, borders)
        ks, ns = np.split(k, cuts), np.split(n, cuts)
        at = [i for i, x in enumerate(ks) if len(x)]
        return blobs(np.full(len(at), key[0].as_py()), [ks[i] for i in at], [ns[i] for i in at], np.array(at))

    def total(key: tuple, table: pa.Table) -> pa.Table:
        chunk = table.column("chunk").to_pylist()
        parts = [unpack_u64(x.as_py()) for x in table.column("keys")]
        counts = [unpack_small(x.as_py()) for x in table.column("counts")]
        every, n = np.concatenate(parts), np.concatenate(counts)
        order = np.argsort(every)
        every, n = every[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        sums = np.add.reduceat(n, first)
        known, sums = every[first][sums > 1], sums[sums > 1]
        back: list[tuple] = []
        for c, part in zip(chunk, parts):
            if len(known):
                at = np.searchsorted(known, part)
                at[at == len(known)] = 0
                hit = known[at] == part
                if hit.any():
                    back.append((c, part[hit], sums[at[hit]]))
        return blobs(np.array([b[0] for b in back]), [b[1] for b in back], [b[2] for b in back], np.full(len(back), key[0].as_py()))

    def again(key: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
        blobs = sorted(zip(known.column("range").to_pylist(), known.column("keys").to_pylist(), known.column("counts").to_pylist()))
        k = np.concatenate([np.empty(0, np.uint64), *[unpack_u64(b[1]) for b in blobs]])
        n = np.concatenate([np.empty(0, np.uint64), *[unpack_small(b[2]) for b in blobs]])
        return use(table, Totals(k, n, 64 - bits))

    found = rows.groupBy("chunk").applyInArrow(out, _BLOBS).groupBy("range").applyInArrow(total, _BLOBS)
    return rows.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(again, schema)


class Totals:
    """How often keys occur in the corpus, for a chunk's keys."""

    def __init__(self, known: np.ndarray, totals: np.ndarray, shift: int):
        self.known, self.totals, self.shift = known, totals, np.uint64(shift)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Total of each key, 1 for keys that occur once."""
        if not len(self.known) or not len(keys):
            return np.ones(len(keys), dtype=np.uint64)
        keys = keys >> self.shift
        at = np.searchsorted(self.known, keys)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == keys, self.totals[at], np.uint64(1))
