"""Helpers shared by the training-data operators: safe column access, packed key blobs, files in
the shared folder, and planning numbers taken from the data."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import saved  # noqa: F401  the operators' way to cut lineage

#: Rows without a doc_id sort after all others in every operator that needs an order.
NULL_ID = (1 << 63) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so extra columns of any name never meet the operator's own."""
    return df.select(*[df[n] for n in names])


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts: one scan of one column, used to choose partition counts."""
    row = docs.agg(F.sum(F.octet_length(F.col(text_col))).alias("b")).first()
    return int(row["b"] or 0)


def parts_for(total_bytes: int, bytes_per_part: int, least: int = 1) -> int:
    return max(least, -(-total_bytes // bytes_per_part))


# ---- packed sorted keys -------------------------------------------------------------------------

def pack_u64(values: np.ndarray) -> bytes:
    """Ascending uint64 values as zstd-compressed byte planes of their differences: sorted hashes
    cost about 64 - log2(n) bits each instead of 64."""
    v = np.ascontiguousarray(values, dtype="<u8")
    d = np.diff(v, prepend=np.uint64(0))
    planes = np.ascontiguousarray(d).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(len(v).to_bytes(8, "little") + planes.tobytes())


def unpack_u64(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(raw, dtype=np.uint8, offset=8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_small(values: np.ndarray) -> bytes:
    """Non-negative integers in any order, zstd-compressed byte planes."""
    v = np.ascontiguousarray(values, dtype="<u8")
    planes = v.view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(len(v).to_bytes(8, "little") + planes.tobytes())


def unpack_small(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(raw, dtype=np.uint8, offset=8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


# ---- files in the shared folder -----------------------------------------------------------------

def open_fs(uri: str):
    """(pyarrow filesystem, path) of a URI or plain path; works on executors for any file system
    pyarrow knows (file, hdfs, s3, gs)."""
    import pyarrow.fs as pafs

    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


# ---- joins --------------------------------------------------------------------------------------

def sized_broadcast(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """Hint a broadcast if the table has at most ``most_rows`` rows (counted); beyond that the
    join is left to shuffle. For tables of narrow rows that are cheap to count."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
