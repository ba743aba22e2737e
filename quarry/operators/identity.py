"""Row identity, and keys that may be NULL.

Samplers, trials and token metrics pick rows and join them back, so a row needs a key of its own. That
is (dataset, entry_id, copy): ``copy`` numbers the rows of equal dataset and id from 0, by ``pos`` where
there is one, then by content, so it does not depend on partitioning. NULL is a value like any other
in a key: all joins here treat it so.

``running`` gives row numbers and running sums per group without bringing a group into one task: rows are
range-partitioned by (group, order); totals of the ranges are summed along the ranges, rows only within
one. A group may hold any share of all rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved

COPY = "_copy"


def match(left: DataFrame, right: DataFrame, columns, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` on equal ``columns``, NULL equal to NULL; left's columns stay."""
    names = {c: f"_on_{c}" for c in columns}
    rest = [F.col(f"`{c}`") for c in right.columns if c not in names]
    right = right.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], *rest)
    on = reduce(and_, [F.col(f"`{c}`").eqNullSafe(F.col(f"`{n}`")) for c, n in names.items()])
    return left.join(right, on, how).drop(*names.values())


def running(df: DataFrame, part, order: list[Column], sums: dict[str, Column] | None = None, name: str = "_row") -> DataFrame:
    """``df`` with ``name``, each row's number from 0 in its group in that order, and a column for each
    of ``sums``: the sum over the rows before it. The order must be total."""
    part, sums = list(part), dict(sums or {})
    keys = [F.col(f"`{c}`") for c in part]
    ranged = df.select("*", *[c.alias(f"_run_add_{k}") for k, c in sums.items()])
    ranged = ranged.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = saved(ranged.withColumn("_run_at", F.monotonically_increasing_id()), "ranges").withColumn("_run_range", F.shiftright("_run_at", 33))
    within = Window.partitionBy(*part, "_run_range").orderBy("_run_at")
    before = Window.partitionBy(*part).orderBy("_run_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = rows.groupBy(*part, "_run_range").agg(F.count(F.lit(1)).alias("_run_n"), *[F.sum(f"_run_add_{k}").alias(f"_run_add_{k}") for k in sums])
    starts = totals.select(*part, "_run_range", zero(F.sum("_run_n").over(before)).alias("_run_first"), *[zero(F.sum(f"_run_add_{k}").over(before)).alias(f"_run_first_{k}") for k in sums])
    rows = rows.withColumn(name, F.row_number().over(within) - 1)
    for k in sums:
        rows = rows.withColumn(k, zero(F.sum(f"_run_add_{k}").over(within.rowsBetween(Window.unboundedPreceding, -1))))
    out = match(rows, starts, [*part, "_run_range"])
    out = out.withColumn(name, (F.col(name) + F.col("_run_first")).cast("bigint"))
    for k in sums:
        out = out.withColumn(k, F.col(k) + F.col(f"_run_first_{k}"))
    return out.drop("_run_at", "_run_range", "_run_first", *[f"_run_add_{k}" for k in sums], *[f"_run_first_{k}" for k in sums])


def identified(df: DataFrame, part=("dataset",), id_col: str = "entry_id") -> DataFrame:
    """``df`` with ``COPY``, so that (part..., id, COPY) is unique. Ids that do not repeat cost one
    aggregate of the ids; only rows of repeated ids are sorted and numbered."""
    keys = [*part, id_col]
    again = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)
    if again.isEmpty():
        return df.withColumn(COPY, F.lit(0).cast("bigint"))
    again = saved(again, "repeated-ids")
    place = "_place"
    rows = saved(match(df, again, keys, "left_semi").withColumn(place, F.monotonically_increasing_id()), "repeated-rows")
    content = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))
    order = [F.col("pos")] if "pos" in df.columns else []
    small = rows.select(*keys, *order, content.alias("_content"), place)
    numbers = running(small, keys, [*order, F.col("_content"), F.col(place)], name=COPY).select(place, COPY)
    numbered = rows.join(numbers, place).select(*df.columns, COPY)
    return match(df, again, keys, "left_anti").withColumn(COPY, F.lit(0).cast("bigint")).unionByName(numbered)
