"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources in code-point order (null last) weigh ``weights`` in turn and share ``share`` times all
words. A target stops at ``max_epochs`` times its source's words; the excess is shared again by
weight until no target is above. A source first gives whole epochs of all its documents, then a
fraction of one: its documents are sorted by the exponential key ``-ln(u) / q`` (``q`` the
document's quality weight, ``u`` a hash of seed and doc_id, so reruns agree), sizes are summed
along that order, and documents are taken until the budget is spent; the last one gives the words
that still fit. ``taken`` therefore sums to the whole part of the target.

The prefix sums never gather a source in one task: the key's exponential distribution, scaled by
the source's mean quality, cuts each source into buckets of about a million rows or less (at
least 256, and ever finer ones for the tail that low weights make); bucket totals are summed
along the buckets and rows only within a bucket. The result does not depend on the buckets.

Null or empty text has size 0 and takes 0. A null source is a source of its own. Documents with
equal keys go by doc_id, then size. Rows that lack or repeat a doc_id are documents of their own: they
are written once and numbered by their place there, and draw by that number. An empty table gives
no rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.functions.hashing import u as u_key
from quarry.llm.common import only, saved, sized_broadcast, text_or_empty, unused

WORD = r"[^\x20\x09-\x0D]+"


def quality_weight(text: Column) -> Column:
    """Share of ASCII letters among the characters, at least 0.05: markup, numbers and symbol
    noise lower a document's chance."""
    return F.greatest(F.lit(0.05), F.round(F.length(F.regexp_replace(text, "[^A-Za-z]", "")) / F.greatest(F.length(text), F.lit(1)), 6))


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """(source, source_size, mean_quality, target): one row a source. Filling to a common level: in the order
    of ``cap / weight``, a source is capped while its ratio lies under the level that the rest
    would get; the level over all prefixes is greatest exactly there."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg("quality").alias("mean_quality"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())  # one row a source
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ratio = max_epochs * F.col("source_size") / F.col("weight")
    before = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).orderBy(F.lit(1))
    level = (share * F.sum("source_size").over(everything) - max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    return (
        weighed.withColumn("ratio", ratio)
        .withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .select("source", "source_size", "mean_quality", F.when(F.col("ratio") <= F.col("level"), (max_epochs * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("level")).alias("target"))
    )


def _bucket(z: Column, n: int) -> Column:
    """n equal slices of the unit exponential distribution up to its 1 / n tail, then slices of a
    sixteenth; grows with z."""
    tail = math.log(n)
    return F.when(z < tail, F.floor(n * (1 - F.exp(-z)))).otherwise(n + F.floor(F.least((z - tail) * 16, F.lit(1e6)))).cast("int")


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with ``name``: null for rows with a doc_id of their own, else a number that only this row
    has. Only rows that lack or repeat an id are written."""
    key = docs["doc_id"].cast("long")
    id_name = unused(docs, "again_id")
    again = docs.groupBy(key.alias(id_name)).agg(F.count("*").alias("rows")).where(F.col(id_name).isNull() | (F.col("rows") > 1)).select(id_name)
    again = saved(again, "mix-repeated")
    if again.isEmpty():
        return docs.withColumn(name, F.lit(None).cast("long"))
    again, same = sized_broadcast(again), key.eqNullSafe(F.col(id_name))
    others = saved(docs.join(again, same, "left_semi").withColumn(name, F.monotonically_increasing_id()), "mix-others")
    return docs.join(again, same, "left_anti").withColumn(name, F.lit(None).cast("long")).unionByName(others)


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, taken: one row a document. ``options`` as in
    ``_mix``."""
    return _mix(_numbered(only(docs, "doc_id", "source", "text"), "mix_row"), "mix_row", **options).drop("mix_row")


def _mix(docs: DataFrame, row: str, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, seed: int = 6, buckets: int | None = None) -> DataFrame:
    text = text_or_empty(docs["text"])
    sized = saved(
        docs.select(
            docs["doc_id"].cast("long").alias("doc_id"),
            docs[row].alias("mix_row"),
            docs["source"].cast("string").alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            quality_weight(text).alias("quality"),
        ),
        "mix-sizes",
    )
    targets = saved(source_targets(sized, weights, share, max_epochs), "mix-targets")
    buckets = buckets or max(256, sized.count() // 1_000_000)
    # a row without an id of its own draws by its number
    drawn = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("mix_row").cast("string"))
    key = -F.log(u_key(seed, "mix", drawn)) / F.col("quality")
    t = sized_broadcast(targets.withColumnRenamed("source", "t_source"))
    keyed = (
        sized.join(t, F.col("source").eqNullSafe(F.col("t_source")))
        .drop("t_source")
        .withColumn("key", key)
        .withColumn("bucket", _bucket(F.col("key") * F.col("mean_quality"), buckets))
    )
    per_bucket = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    earlier = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = saved(per_bucket.select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")), "mix-offsets")
    within = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "mix_row", "size").rowsBetween(W.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return (
        keyed.join(sized_broadcast(offsets), F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")))
        .withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0)))
        .withColumn("epochs", epochs)
        .withColumn("rest", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size"))
        .select(
            "doc_id", "mix_row", "source", "size", "source_size", "target", "epochs",
            (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before")))).alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows: a document stands once for each whole epoch, and once more if the fraction
    takes at least half of it. Keeps the columns of ``docs``. Documents without words take no
    words and go; rows that lack or repeat a doc_id are taken each on its own."""
    row = unused(docs, "mix_row")
    docs = _numbered(docs, row)
    taken = _mix(docs, row, **options)
    name, number, copies = unused(docs, "mix_id"), unused(docs, "mix_number"), unused(docs, "mix_copies")
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    picked = taken.select(F.col("doc_id").alias(name), F.col("mix_row").alias(number), times.alias(copies)).where(F.col(copies) > 0)
    out = docs.join(picked, docs["doc_id"].cast("long").eqNullSafe(F.col(name)) & docs[row].eqNullSafe(F.col(number)))
    return out.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[out[c] for c in docs.columns if c != row])


#: The same rows in DuckDB SQL.
OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         greatest(0.05, round(length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) / greatest(length(coalesce(text, '')), 1), 6)) AS quality
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM totals),
leveled AS (
  SELECT source, source_size, weight, 2 * source_size / weight AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER b, 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM weighed
  WINDOW b AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         CASE WHEN ratio <= max(level) OVER () THEN CAST(2 * source_size AS DOUBLE) ELSE weight * max(level) OVER () END AS target
  FROM leveled),
keyed AS (
  SELECT s.doc_id, s.size, t.source, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
         -ln((('0x' || substr(md5('6:mix:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / s.quality AS key
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
summed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keyed)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken
FROM summed"""
