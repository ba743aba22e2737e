"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

For one pre-token the tree's leaf ``i`` holds ``(rank, i)`` of the pair that starts at symbol
``i`` (infinity where no merge exists); inner nodes hold the least of their children. The root is
therefore the leftmost merge of the lowest rank. Applying it changes at most three leaves (the
pair itself, the one before, the one that vanished), each a logarithmic point update, until the
root is infinite. A pre-token of n bytes costs O(n log n) even when it is one very long run.

Texts are cut into pre-tokens by the byte-level pattern. A text is first split at single blanks:
a piece that ends in a non-space is a unit whose tokens do not depend on its neighbours (the
pattern has no look-behind, and non-space to space is always a boundary), so its ids are cached.
Caches are bounded and hold only pure functions of their key.

Null text counts as empty; empty text has no tokens. Rows keep their doc_id (null included) and
repeated rows give repeated results; other columns are ignored."""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from quarry.llm.common import only, text_or_empty

#: The byte-level pre-token pattern of the rank files (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_INF = 1 << 62
_POS = (1 << 31) - 1


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable
    Latin-1 characters stand for themselves, the others are moved up from U+0100 in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(moved)) for b in range(256)]


def merge_pretoken(ids: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply merges to the symbols of one pre-token. ``pairs``: (left, right) -> (rank, merged)."""
    n = len(ids)
    if n < 2:
        return ids
    get = pairs.get
    if n == 2:
        hit = get((ids[0], ids[1]))
        return ids if hit is None else [hit[1]]
    size = 1 << (n - 2).bit_length()
    tree = [_INF] * (2 * size)
    for i in range(n - 1):
        hit = get((ids[i], ids[i + 1]))
        if hit is not None:
            tree[size + i] = hit[0] << 31 | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    nxt = list(range(1, n + 1))
    prv = list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        i += size
        if tree[i] == value:
            return
        tree[i] = value
        while i > 1:
            a, b = tree[i], tree[i ^ 1]
            i >>= 1
            least = a if a < b else b
            if tree[i] == least:
                return
            tree[i] = least

    while (top := tree[1]) != _INF:
        i = top & _POS
        j = nxt[i]
        ids[i] = pairs[ids[i], ids[j]][1]
        k = nxt[i] = nxt[j]
        if j < n - 1:
            put(j, _INF)
        if k < n:
            prv[k] = i
            hit = get((ids[i], ids[k]))
            put(i, _INF if hit is None else hit[0] << 31 | i)
        else:
            put(i, _INF)
        p = prv[i]
        if p >= 0:
            hit = get((ids[p], ids[i]))
            put(p, _INF if hit is None else hit[0] << 31 | p)
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = nxt[i]
    return out


class _ByteTable:
    """Byte strings by number; ``of`` joins those of an array of numbers in one gather."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(x) for x in strings], dtype=np.int32)
        self.start = np.cumsum(self.size, dtype=np.int32) - self.size
        self.data = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def of(self, numbers: np.ndarray) -> bytes:
        n = self.size[numbers]
        ends = np.cumsum(n, dtype=np.int64)
        if not len(ends):
            return b""
        at = np.repeat(self.start[numbers] - (ends - n), n)
        at += np.arange(ends[-1])
        return self.data[at].tobytes()


class BytePairCodec:
    """Encoder and decoder of a byte-level BPE vocabulary file (the tokenizers JSON layout)."""

    def __init__(self, path: str, cache_entries: int = 500_000, special: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        self.byte_id = [vocab[c] for c in alphabet]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        of_char = {c: b for b, c in enumerate(alphabet)}
        size = max([*vocab.values(), *added.values()]) + 1
        self.piece = [b""] * size
        for token, i in [*vocab.items(), *added.items()]:
            self.piece[i] = bytes(of_char[c] for c in token) if all(c in of_char for c in token) else token.encode()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.code = "H" if size <= 1 << 16 else "I"
        self.pieces = _ByteTable(self.piece)
        self.comma_decimals = _ByteTable([b",%d" % i for i in range(size)])
        self.pretokens = regex.compile(PATTERN).findall
        self.added = added if special else {}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.limit = cache_entries
        self.units: dict[str, bytes | bool] = {}
        self.words: dict[str, bytes] = {}

    def pretoken_ids(self, token: str) -> bytes:
        """Ids of one pre-token, packed."""
        got = self.words.get(token)
        if got is None:
            ids = merge_pretoken(list(map(self.byte_id.__getitem__, token.encode("utf-8"))), self.pairs)
            got = array(self.code, ids).tobytes()
            if len(self.words) >= self.limit:
                self.words.clear()
            if len(token) < 256:
                self.words[token] = got
        return got

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pretoken_ids, self.pretokens(text)))

    def _region(self, text: str) -> bytes:
        """Ids of a stretch of text; added tokens are found before anything else."""
        if self.cut is None or "<" not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.added[m.group()]], dtype=self.dtype).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _unit(self, piece: str) -> bytes | bool:
        """Ids of a blank and ``piece``; False if the piece ends in a space, so that its tokens
        depend on what follows."""
        got = False if not piece or piece[-1].isspace() else self._region(" " + piece)
        if len(self.units) >= self.limit:
            self.units.clear()
        if len(piece) < 256:
            self.units[piece] = got
        return got

    def encode_packed(self, text: str) -> bytes:
        if not text:
            return b""
        pieces = text.split(" ")
        found = list(map(self.units.get, pieces))
        if None in found:
            found = [self._unit(p) if x is None else x for p, x in zip(pieces, found)]
        out, i, n = [], 0, len(pieces)
        while i < n:
            got = found[i]
            if i and got is not False:
                out.append(got)
                i += 1
                continue
            j = i
            while j < n - 1 and (not pieces[j] or pieces[j][-1].isspace()):
                j += 1
            out.append(self._region((" " if i else "") + " ".join(pieces[i : j + 1])))
            i = j + 1
        return b"".join(out)

    def encode_many(self, texts: pa.Array, slice_bytes: int = 8 << 20) -> Iterator[bytes]:
        """Packed ids of each text. Arrow numbers the distinct pieces of a slice of the texts, so that
        Python looks each of them up once."""
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // slice_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            some = texts.slice(i, j - i)
            pieces = pc.split_pattern(some, " ")
            coded = pieces.flatten().dictionary_encode()
            names = coded.dictionary.to_pylist()
            units = [self._unit(p) if (u := self.units.get(p)) is None else u for p in names]
            index = coded.indices.to_numpy()
            open_end = np.concatenate([[0], np.cumsum(np.array([u is False for u in units])[index])])
            ends = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
            clean = open_end[ends[1:]] == open_end[ends[:-1]]
            for k, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
                if not clean[k]:  # white space beside a blank: tokens there reach across pieces
                    yield self.encode_packed(some[k].as_py())
                    continue
                first, *rest = index[a:b].tolist()
                yield b"".join([self._region(names[first]), *map(units.__getitem__, rest)])

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_packed(text), dtype=self.dtype)

    def decode(self, ids) -> str:
        """Text of the ids, special tokens kept; broken UTF-8 becomes U+FFFD."""
        return self.pieces.of(np.asarray(ids, dtype=np.int64)).decode("utf-8", "replace")

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return self.comma_decimals.of(ids)[1:]


_CODECS: dict[tuple, BytePairCodec] = {}


def codec(path: str, special: bool = True) -> BytePairCodec:
    """One codec a Python worker."""
    key = (path, special)
    if key not in _CODECS:
        _CODECS[key] = BytePairCodec(path, special=special)
    return _CODECS[key]


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids ARRAY<INT>: the ids of every whole text. A map over the rows, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for b in batches:
            ids = [np.frombuffer(x, c.dtype) for x in c.encode_many(b.column(1))]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], names=["doc_id", "ids"])

    return only(docs, "doc_id", "text").select("doc_id", text_or_empty(docs["text"]).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, text of doc_id, ids ARRAY<INT>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, lossless of every whole text, encoded and
    decoded again in the same task; ids never leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        sha = hashlib.sha256
        for b in batches:
            n, ids_sha, text_sha, same = [], [], [], []
            for packed, text in zip(c.encode_many(b.column(1)), b.column(1)):
                ids = np.frombuffer(packed, c.dtype)
                back = c.decode(ids)
                n.append(len(ids))
                ids_sha.append(sha(c.decimals(ids)).hexdigest())
                text_sha.append(sha(back.encode()).hexdigest())
                same.append(back == text.as_py())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(same, pa.bool_())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "lossless"],
            )

    return only(docs, "doc_id", "text").select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs["text"]).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean"
    )
