"""Reproducible randomness as a pure column function.

``u(seed, salt, id)`` = (first 13 hex digits of md5(seed:salt:id) as an integer + 0.5) / 2^52,
uniform in (0, 1). It depends only on the row's id, so a sample does not change with the
number of partitions, the input order or executor loss, and any SQL engine with md5 can
recompute it. "Shuffle" means order by u; "n at random" means the n smallest u.
A different salt per use keeps draws independent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(2**52)


def u(seed, salt: str, id_col) -> Column:
    idc = F.col(id_col) if isinstance(id_col, str) else id_col
    seed_c = seed if isinstance(seed, Column) else F.lit(str(seed))
    key = F.concat_ws(":", seed_c.cast("string"), F.lit(salt), idc.cast("string"))
    hi = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double")
    return (hi + F.lit(0.5)) / F.lit(TWO_52)


def bucket(token: Column, dim: int) -> Column:
    """Stable hash bucket of a string in [0, dim) (first 8 hex digits of md5)."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint"), F.lit(dim))
