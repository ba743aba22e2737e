"""Packing documents into training sequences by vector best-fit.

A document's ids, followed by an end id, are one piece; a document longer than a sequence is cut
into pieces of the sequence's length. A piece demands three things of a sequence: tokens, one
document, and attention cost (the square of its length, as attention stays inside a document). A
sequence has a capacity of each. Pieces go in descending order of their weighted demand; each goes
to the open sequence that can take it under EVERY capacity and fits best:

* ``norm``: the one whose weighted residuals after the piece have the least Euclidean norm;
* ``dot``: the one whose weighted residuals have the greatest dot product with the demand;

ties to the sequence opened first; if none can take it, a new one opens. Demands and residuals are
shares of the capacities. Without weights, a capacity weighs as much as the pieces demand of it on
average; one that cannot bind before the tokens do (``documents`` and ``attention`` unset) weighs
nothing unless weights are given.

Packing is global in kind but needs no global state: pieces are written once (narrow rows), dealt
evenly into groups of about ``group_pieces`` by their place in the written table, whatever their
ids, and each group is packed by one task. A group loses at most its last, partly filled
sequences, a few of thousands. Groups see the same mix of lengths, since dealing is by hash.

Null and empty texts are their end id alone. Rows map one to one to documents: null ids and repeated
rows are packed again. Other columns are ignored; an empty table gives no rows. Reruns on the same
files agree. A demand above a capacity is an error, as no sequence could take it."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import parts_for, saved, text_or_empty, unused
from quarry.llm.token_store import encoder


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds. Unset: as much as its tokens allow."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None

    @property
    def limits(self) -> np.ndarray:
        documents = self.tokens if self.documents is None else self.documents
        attention = self.tokens**2 if self.attention is None else self.attention
        return np.array([self.tokens, documents, attention], np.int64)


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, seq_len: int = 2048, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece. A map; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer_path)
        for b in batches:
            at = 0
            for ids, ends in e.encode_slices(b.column(1)):
                n = len(ends) - 1
                yield cut(b.column(0).slice(at, n), ids, ends)
                at += n

    def cut(doc_ids: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        # the end id behind each document
        ids = np.insert(ids.astype("<u4"), ends[1:], end_id)
        ends = ends + np.arange(len(ends))
        n_pieces = -(-np.diff(ends) // seq_len)
        doc = np.repeat(np.arange(len(n_pieces)), n_pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
        start = piece * seq_len
        first = ends[doc] + start
        last = np.minimum(first + seq_len, ends[doc + 1])
        data = ids.view(np.uint8)
        crc = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(first.tolist(), last.tolist())]
        columns = [doc_ids.take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(last - first, pa.int64()), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs["text"]).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def best_fit(length: np.ndarray, capacity: Capacity, weights: tuple[float, float, float] | None = None, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; bins are numbered from 0 in the order they open."""
    limits = capacity.limits
    demand = np.stack([length, np.ones(len(length), np.int64), length**2])
    if (demand > limits[:, None]).any():
        raise ValueError("a piece demands more than a sequence holds")
    share = demand / limits[:, None]
    if weights is None:
        binds = np.array([True, capacity.documents is not None, capacity.attention is not None])
        weights = tuple(share.mean(axis=1) * binds) if len(length) else (1.0, 1.0, 1.0)
    w = np.array(weights)
    order = np.argsort(-(w @ share), kind="stable")
    least = demand.min(axis=1, initial=1 << 62)
    room = np.empty((3, len(length)), np.int64)  # what is left in the open bins, in order of opening
    opened = np.empty(len(length), np.int64)  # their numbers
    used = np.zeros(len(length), np.int64)
    out, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    n_open = n_bins = 0
    for item in order.tolist():
        d = demand[:, item]
        r = room[:, :n_open]
        fits = np.flatnonzero((r[0] >= d[0]) & (r[1] >= d[1]) & (r[2] >= d[2]))
        if len(fits) and rule == "norm":
            left = (r[:, fits] - d[:, None]) / limits[:, None]
            k = fits[np.argmin(w @ (left * left))]
        elif len(fits):
            k = fits[np.argmax((w * share[:, item] / limits) @ r[:, fits])]
        else:
            k = n_open
            room[:, k], opened[k] = limits, n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
        room[:, k] -= d
        at = opened[k]
        out[item], offset[item] = at, used[at]
        used[at] += length[item]
        if (room[:, k] < least).any():  # no piece can follow: the bin closes
            room[:, k : n_open - 1] = room[:, k + 1 : n_open].copy()
            opened[k : n_open - 1] = opened[k + 1 : n_open].copy()
            n_open -= 1
    return out, offset


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), weights: tuple[float, float, float] | None = None, rule: str = "norm", group_pieces: int = 20_000) -> DataFrame:
    """``pieces`` (any columns, ``length`` among them) with sequence_id and offset: each sequence's
    pieces lie gapless from 0."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule!r}")
    names = pieces.columns
    pieces = saved(pieces, "pieces")
    groups = parts_for(pieces.count(), group_pieces)
    group = unused(pieces, "pack_group")
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bins, offset = best_fit(table.column("length").to_numpy(), capacity, weights, rule)
        return table.select(names).append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offset))

    dealt = pieces.withColumn(group, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy(group).applyInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids and lengths (of the pieces, in order) of each sequence, from packed pieces
    with ids. A sequence is bounded by its capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.length").alias("lengths"))
