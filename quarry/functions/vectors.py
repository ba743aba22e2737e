"""Dense-vector helpers as Column expressions, and the pluggable embedder slot."""

from __future__ import annotations

import hashlib
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import bucket
from .text import sampler_tokens

DEFAULT_DIM = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sq_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def cosine(a: Column, b: Column) -> Column:
    """dot / sqrt(|a|^2 |b|^2); 0 when either vector is zero or missing. An Arrow UDF over whole
    batches; sums run from the first element to the last, as in ``dot``."""

    @F.arrow_udf(T.DoubleType())
    def _cosine(x: pa.Array, y: pa.Array) -> pa.Array:
        return cosines(x, y)

    return _cosine(a.cast("array<double>"), b.cast("array<double>"))


def cosines(a: pa.Array, b: pa.Array) -> pa.Array:
    """Cosine of each pair of lists: 0 where one is zero, null or holds a null, null where the
    lengths differ."""
    x, n = rows_of(a)
    y, m = rows_of(b)
    width = max(x.shape[0], y.shape[0])
    x, y = (np.pad(v, ((0, width - v.shape[0]), (0, 0))) for v in (x, y))
    dot, xx, yy = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for u, v in zip(x, y):
        dot, xx, yy = dot + u * v, xx + u * u, yy + v * v
    den = np.sqrt(xx * yy)
    some = (den > 0) | np.isnan(den)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(some, dot / den, 0.0)
    return pa.array(out, mask=some & (n != m))


def rows_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, lengths): the lists as columns of a matrix, filled up by zeros. A null list, or one with
    a null in it, is all zeros."""
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    width = int(size.max(initial=0))
    out = np.zeros((len(size), width))
    at = np.arange(width) < size[:, None]
    out[at] = flat.to_numpy(zero_copy_only=False)
    if flat.null_count:
        missing = np.zeros_like(at)
        missing[at] = flat.is_null().to_numpy(zero_copy_only=False)
        out[missing.any(axis=1)] = 0.0
    return np.ascontiguousarray(out.T), size


def hashed_tf(text, dim: int = DEFAULT_DIM) -> Column:
    """Default in-repo embedder: term counts of the sampler tokens hashed into ``dim``
    buckets by md5. Deterministic, needs no model, and any SQL engine can recompute it."""
    ids = F.transform(sampler_tokens(text), lambda t: bucket(t, dim))
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.size(F.filter(ids, lambda b: b == i)).cast("double"),
    )


# An embedder maps a text Column to an array<double> Column; models plug in with
# ``pandas_embedder``. Its ``factory`` builds ``encode(list[str]) -> list of vectors`` once per
# Python worker, which the map-only retrieval kernels call directly.
Embedder = Callable[[Column], Column]


def hashed_encoder(dim: int = DEFAULT_DIM) -> Callable[[list[str]], np.ndarray]:
    """The counts of ``hashed_tf`` in numpy, one md5 per distinct token."""
    bucket_of = _Buckets(dim).__getitem__

    def encode(texts: list[str]) -> np.ndarray:
        ids: list[int] = []
        ends = []
        for text in texts:
            ids.extend(map(bucket_of, _tokens(text)))
            ends.append(len(ids))
        row = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        flat = np.bincount(row * dim + np.array(ids, dtype=np.int64), minlength=len(texts) * dim)
        return flat.reshape(len(texts), dim).astype(float)

    return encode


class _Buckets(dict):
    """The bucket of each token met; forgets all at a million."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        self[token] = found = int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16) % self.dim
        return found


_SEPARATORS = regex.compile(r"[^\p{L}\p{N}]+")
_ASCII = {i: chr(i).lower() if chr(i).isalnum() else " " for i in range(128)}


def _tokens(text: str) -> list[str]:
    if text.isascii():
        return text.translate(_ASCII).split()
    return [t for t in _SEPARATORS.sub(" ", text).lower().split(" ") if t]


def pandas_embedder(factory: Callable[[], Callable[[list[str]], list]]) -> Embedder:
    """Wrap ``factory() -> encode(list[str]) -> list of vectors`` as an iterator UDF over Arrow
    batches."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def _embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = factory()
        for s in batches:
            yield _lists(encode(["" if x is None else str(x) for x in s.to_pylist()]))

    def embedder(c: Column) -> Column:
        return _embed(c)

    embedder.factory = factory
    return embedder


def _lists(vectors) -> pa.Array:
    rows = [np.asarray(v, dtype=float).ravel() for v in vectors]
    flat = np.concatenate([np.empty(0), *rows])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(flat))


EMBEDDERS: dict[str, Embedder] = {}


def register_embedder(name: str, embedder: Embedder) -> None:
    """Make an embedder usable by name wherever one is accepted."""
    EMBEDDERS[name] = embedder


def default_embedder(dim: int = DEFAULT_DIM) -> Embedder:
    """Hashed term counts in an Arrow UDF (the embedder slot real models use);
    ``hashed_tf`` is the equivalent pure-JVM expression."""
    return pandas_embedder(lambda: hashed_encoder(dim))


def as_embedder(embedder: Embedder | str | None) -> Embedder:
    return default_embedder() if embedder is None else EMBEDDERS[embedder] if isinstance(embedder, str) else embedder
