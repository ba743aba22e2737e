"""Token ids as Arrow IPC files of fixed-size-list batches.

Documents are range-partitioned by doc_id, encoded, each followed by the end id, and packed end
to end into sequences of ``seq_len`` ids. Each task streams its sorted documents into one Arrow
file whose record batches have two columns, ``ids`` FixedSizeList<uint16|uint32> and ``mask``
FixedSizeList<bool> (false on the padding of the last sequence). The IPC file footer lists the
batches and every batch but the last has ``batch_rows`` sequences, so sequence ``i`` is batch
``i // batch_rows``, row ``i % batch_rows``: two slices of the mapped file, no copy. A side file
lists the documents of the part (doc_id, n_tokens).

Files are written under a temporary name and renamed, so a retried or speculative task replaces
its own file with the same content; a lost executor loses nothing once the rename is done. The
folder is the shared one that ``spark.checkpoint.dir`` names.

Null text counts as empty: the document is its end id alone. Rows without doc_id come first; rows
of one id go by a digest of the text; repeated rows are stored again; other columns are ignored; an empty table writes empty parts."""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import only, open_fs, parts_for, text_bytes, text_or_empty

_MANIFEST = "part long, path string, n_docs long, n_tokens long"
#: Marks that may end a word and are tokens of their own there.
_TAIL = ".,;:!?#$%&*"
# ---- fixed values: the rules of a tokenizer file that encodes a text word by word ---------------
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def encodes_wordwise(path: str) -> bool:
    """Whether the file's normaliser and pre-tokenizer are the ones that ``WordwiseEncoder`` may work
    word by word under, and no added token reaches across a blank."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    same = rules["normalizer"] == _NORMALIZER and rules["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}
    return same and all(t["content"].startswith("<") and not re.search(r"\s", t["content"]) for t in rules["added_tokens"])


class WordwiseEncoder:
    """Ids by the tokenizers library. A file whose rules are not those of ``encodes_wordwise`` is left to
    the library text by text. For the others, vocabularies that drop white space: no token and no
    normalisation step reaches across a blank, so the ids of a text are those of its words in
    turn. ``word`` is what stands between blanks or line ends; other white space stays inside and
    the library sees it. Arrow numbers the distinct words of a slice, folds ASCII words, and parts
    them from marks at their end, which are a token of their own after a letter; each distinct
    part is encoded once and kept in a bounded cache."""

    def __init__(self, path: str, cache_entries: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.wordwise = encodes_wordwise(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.limit = cache_entries
        self.parts: dict[str, bytes] = {}
        suffix = self.tok.model.end_of_word_suffix or ""
        self.ends_word = np.zeros(size, bool)
        if suffix:
            self.ends_word[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def _encode_each(self, parts: list[str]) -> None:
        for p, e in zip(parts, self.tok.encode_batch_fast(parts, add_special_tokens=False)):
            self.parts[p] = array(self.code, e.ids).tobytes()

    def _learn(self, parts: list[str]) -> None:
        """Encode new parts. ASCII letters alone are one word to the vocabulary, so many of them go
        through the library as one text, whose ids are cut where a word ends."""
        if len(self.parts) >= self.limit:
            self.parts.clear()
        plain = [p for p in parts if p.isalpha() and p.isascii()] if self.ends_word.any() else []
        self._encode_each(list(set(parts).difference(plain)))
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            ids = np.array(self.tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            cuts = (np.flatnonzero(self.ends_word[ids]) + 1) * self.dtype.itemsize
            if len(cuts) != len(some):
                self._encode_each(some)
                continue
            data, start = ids.tobytes(), 0
            for p, stop in zip(some, cuts.tolist()):
                self.parts[p] = data[start:stop]
                start = stop

    def _ids_of(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all distinct parts end to end, number of ids of each)."""
        names = parts.to_pylist()
        got = list(map(self.parts.get, names))
        if None in got:
            old = {p: x for p, x in zip(names, got) if x is not None} if len(self.parts) >= self.limit else {}
            self._learn([p for p, x in zip(names, got) if x is None])
            self.parts |= old
            have = self.parts
            got = [have[p] if x is None else x for p, x in zip(names, got)]
        n = np.fromiter(map(len, got), np.int32, len(got)) // self.dtype.itemsize
        return np.frombuffer(b"".join(got), dtype=self.dtype), n

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all distinct words end to end, number of ids of each)."""
        ascii_ = pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring(words, "<")))
        head = pc.utf8_rtrim(words, characters=_TAIL)
        parted = pc.and_(ascii_, pc.match_substring_regex(head, "[A-Za-z]$"))
        tail = pc.if_else(parted, pc.extract_regex(words, f"(?P<t>[{_TAIL}]*)$").field("t"), "")
        head = pc.if_else(ascii_, pc.ascii_lower(pc.if_else(parted, head, words)), words)
        heads, tails = head.dictionary_encode(), tail.dictionary_encode()
        return _joined([(*self._ids_of(x.dictionary), x.indices.to_numpy()) for x in (heads, tails)])

    def encode_slices(self, texts: pa.Array, slice_bytes: int = 8 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``encode_batch`` of consecutive slices of about so many bytes (a longer text alone)."""
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // slice_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for i, j in zip(cuts, cuts[1:]):
            if i < j:
                yield self.encode_batch(texts.slice(i, j - i))

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, borders): text i has ids[borders[i]:borders[i + 1]].
        Words are numbered by Arrow, so Python sees each distinct word of the batch once."""
        if not len(texts):
            return np.empty(0, self.dtype), np.zeros(1, np.int64)
        if not self.wordwise:
            got = [np.array(e.ids, self.dtype) for e in self.tok.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate(got), np.cumsum([0, *map(len, got)], dtype=np.int64)
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = pieces.flatten().dictionary_encode()
        ids, n = _joined([(*self._word_ids(coded.dictionary), coded.indices.to_numpy())])
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        return ids, ends[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()]


def _joined(columns: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows made of one entry of each column: (values of all rows end to end, number of values of
    each). A column is (values of its entries end to end, their numbers, the entry of each row)."""
    counts = [n[row] for _, n, row in columns]
    total = np.sum(counts, axis=0, dtype=np.int32)
    at = np.cumsum(total, dtype=np.int64) - total
    out = np.empty(int(total.sum()), columns[0][0].dtype)
    for (values, n, row), count in zip(columns, counts):
        start = np.cumsum(n, dtype=np.int64) - n
        step = np.arange(int(count.sum()), dtype=np.int64) - np.repeat(np.cumsum(count, dtype=np.int64) - count, count)
        out[np.repeat(at, count) + step] = values[np.repeat(start[row], count) + step]
        at = at + count
    return out, total


_ENCODERS: dict[str, WordwiseEncoder] = {}


def encoder(path: str) -> WordwiseEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordwiseEncoder(path)
    return _ENCODERS[path]


class SequenceWriter:
    """Packs documents into the fixed-size-list batches of one Arrow file."""

    def __init__(self, sink, dtype: np.dtype, seq_len: int, batch_rows: int):
        self.dtype, self.seq_len, self.room = np.dtype(dtype), seq_len, seq_len * batch_rows
        self.kind = pa.uint16() if self.dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(self.kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))], metadata={"seq_len": str(seq_len), "batch_rows": str(batch_rows)})
        self.out = ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.n_tokens = 0

    def add(self, ids: np.ndarray) -> None:
        self.n_tokens += len(ids)
        while len(ids):
            take = ids[: self.room - self.n_held]
            self.held.append(take)
            self.n_held += len(take)
            ids = ids[len(take) :]
            if self.n_held == self.room:
                self._flush()

    def _flush(self) -> None:
        rows = -(-self.n_held // self.seq_len)
        flat = np.zeros(rows * self.seq_len, dtype=self.dtype)
        flat[: self.n_held] = np.concatenate(self.held)
        mask = np.arange(len(flat)) < self.n_held
        self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(flat, self.kind), self.seq_len), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.seq_len)], schema=self.schema))
        self.held, self.n_held = [], 0

    def close(self) -> None:
        if self.n_held:
            self._flush()
        self.out.close()


class TokenFile:
    """Random access to one file: ``file[i]`` is (ids, mask) of sequence i, views of the map."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
        self.reader = ipc.open_file(self.source)
        meta = self.reader.schema.metadata
        self.seq_len, self.batch_rows = int(meta[b"seq_len"]), int(meta[b"batch_rows"])

    def __len__(self) -> int:
        n = self.reader.num_record_batches
        return 0 if not n else (n - 1) * self.batch_rows + self.reader.get_batch(n - 1).num_rows

    def batch(self, k: int) -> tuple[np.ndarray, pa.Array]:
        b = self.reader.get_batch(k)
        return b.column(0).flatten().to_numpy().reshape(-1, self.seq_len), b.column(1)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        ids, mask = self.batch(i // self.batch_rows)
        row = i % self.batch_rows
        return ids[row], mask[row].values.to_numpy(zero_copy_only=False)

    def stream(self) -> Iterator[np.ndarray]:
        """The ids that the masks keep, batch by batch."""
        for k in range(self.reader.num_record_batches):
            ids, mask = self.batch(k)
            n = mask.flatten().true_count
            yield ids.reshape(-1)[:n]


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, seq_len: int = 2048, batch_rows: int = 128, text_bytes_per_file: int = 64 << 20) -> DataFrame:
    """Write the files and return their manifest (part, path, n_docs, n_tokens), one row a file
    in ascending doc_id order. The one shuffle moves the texts, sorted by doc_id; encoding comes
    after it, since drawing the range borders runs what comes before it once more."""
    spark = docs.sparkSession
    rows = only(docs, "doc_id", "text").select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs["text"]).alias("text"))
    n_files = parts_for(text_bytes(rows), text_bytes_per_file, spark.sparkContext.defaultParallelism)
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        e = encoder(tokenizer_path)
        end = np.array([end_id], dtype=e.dtype)
        fs, base = open_fs(folder)
        name, tmp = f"{base}/part-{part:06d}.arrow", f"{base}/.{uuid.uuid4().hex}"
        n_docs = 0
        with fs.open_output_stream(f"{tmp}.ids") as sink, fs.open_output_stream(f"{tmp}.docs") as side:
            out = SequenceWriter(sink, e.dtype, seq_len, batch_rows)
            index = ipc.new_file(side, index_schema())
            for b in batches:
                sizes = []
                for ids, ends in e.encode_slices(b.column(1)):
                    for i, j in zip(ends.tolist(), ends[1:].tolist()):
                        out.add(ids[i:j])
                        out.add(end)
                    sizes.append(np.diff(ends) + 1)
                n_tokens = np.concatenate([np.empty(0, np.int64), *sizes])
                index.write_batch(pa.RecordBatch.from_arrays([b.column(0), pa.array(n_tokens, pa.int64())], schema=index_schema()))
                n_docs += b.num_rows
            out.close()
            index.close()
        fs.move(f"{tmp}.docs", f"{name}.docs")
        fs.move(f"{tmp}.ids", name)
        prefix = folder.rstrip("/")
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([f"{prefix}/part-{part:06d}.arrow"]), pa.array([n_docs]), pa.array([out.n_tokens])], names=["part", "path", "n_docs", "n_tokens"])

    # equal ids go by the digest of the text, equal texts by their place: no id and no text fills a file
    order = ["doc_id", "digest", "place"]
    placed = rows.withColumn("digest", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    files = placed.repartitionByRange(n_files, *order).sortWithinPartitions(*order).drop("digest", "place").mapInArrow(write, _MANIFEST)
    return spark.createDataFrame(sorted(map(tuple, files.collect())), _MANIFEST)  # a row a file


def index_schema() -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


def read_token_digests(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files. A task reads one file
    batch by batch; a document's ids are never gathered across files."""
    rows = [tuple(r) for r in manifest.orderBy("part").collect()]  # a row a file
    start, placed = 0, []
    for part, path, n_docs, n_tokens in rows:
        placed.append((path, start))
        start += n_tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield from digests(path, first)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not placed:
        return spark.createDataFrame([], schema)
    table = spark.createDataFrame(placed, "path string, first long").repartition(len(placed))
    return table.mapInArrow(read, schema)


def digests(path: str, first: int) -> Iterator[pa.RecordBatch]:
    data = TokenFile(path)
    fs, plain = open_fs(f"{path}.docs")
    side = ipc.open_file(pa.memory_map(plain) if fs.type_name == "local" else fs.open_input_file(plain))
    blocks, block = data.stream(), np.empty(0, np.uint16)
    for k in range(side.num_record_batches):
        b = side.get_batch(k)
        starts, crcs = [], []
        for n in b.column(1).to_pylist():
            starts.append(first)
            first += n
            crc = 0
            while n:
                if not len(block):
                    block = next(blocks)
                crc = zlib.crc32(block[:n].astype("<u4").tobytes(), crc)
                block, n = block[n:], n - min(n, len(block))
            crcs.append(crc)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(starts, pa.int64()), b.column(1), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
