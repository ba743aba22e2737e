"""Roll-ups of scored rows: per dataset, overall, across seeded trials, pivot for display."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALL_LABEL = "__ALL__"


def long_metrics(scored: DataFrame) -> DataFrame:
    """(dataset, metric, value) of a ``metrics`` map whose keys are not known."""
    return scored.select("dataset", F.explode("metrics").alias("metric", "value"))


def metric_sums(scored: DataFrame, keys: list[str] | None = None, part=("dataset",)) -> DataFrame:
    """(part..., metric, total, n) over the rows that HAVE the metric. With ``keys`` (metric
    columns, or keys of the ``metrics`` map) one wide aggregate folds the rows map-side and only
    its few rows are unpivoted; without them the map is exploded."""
    if not keys:
        long = scored.select(*part, F.explode("metrics").alias("metric", "value"))
        return long.groupBy(*part, "metric").agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    value = (lambda k: F.col(f"`{k}`")) if set(keys) <= set(scored.columns) else (lambda k: F.col("metrics")[k])
    aggs = [a for i, k in enumerate(keys) for a in (F.sum(value(k)).alias(f"_t{i}"), F.count(value(k)).alias(f"_n{i}"))]
    wide = scored.groupBy(*part).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(f"_t{i}").alias("total"), F.col(f"_n{i}").alias("n")) for i, k in enumerate(keys)])
    return wide.select(*part, F.inline(rows)).where("n > 0")


def _means(sums: DataFrame, part=("dataset",)) -> DataFrame:
    return sums.select(*part, "metric", (F.col("total") / F.col("n")).alias("mean"), "n")


def summarise(scored: DataFrame, metric_cols: list[str] | None = None, datasets: DataFrame | None = None) -> DataFrame:
    """Mean of each metric per dataset over the rows that HAVE it: (dataset, metric, mean, n).
    ``datasets`` (a ``dataset`` column) adds a row of n = 0 per metric for sets without rows."""
    out = _means(metric_sums(scored, metric_cols))
    if datasets is None or not metric_cols:
        return out
    every = datasets.select("dataset").distinct().withColumn("metric", F.explode(F.array(*map(F.lit, metric_cols))))
    return every.join(out, ["dataset", "metric"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def summarise_with_overall(scored: DataFrame, metric_cols: list[str] | None = None) -> DataFrame:
    """Per dataset plus an overall ``__ALL__`` row per metric, folded from the per-dataset sums."""
    sums = metric_sums(scored, metric_cols)
    both = sums.withColumn("dataset", F.explode(F.array(F.col("dataset"), F.lit(ALL_LABEL))))
    return _means(both.groupBy("dataset", "metric").agg(F.sum("total").alias("total"), F.sum("n").alias("n")))


def dataset_row_counts(df: DataFrame) -> DataFrame:
    """(dataset, n) plus the overall row, as the summary table shows beside the means."""
    per = df.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    tot = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(ALL_LABEL).alias("dataset"), "n")
    return per.unionByName(tot)


def trial_stats(trial_summaries: DataFrame) -> DataFrame:
    """Mean and population std over trials of (trial, dataset, metric, mean), with the
    display string: 'm ± s' (3 decimals), std hidden when it rounds to 0."""
    agg = trial_summaries.groupBy("dataset", "metric").agg(
        F.avg("mean").alias("trial_mean"), F.stddev_pop("mean").alias("trial_std"),
        F.count("mean").alias("trials"),
    )
    txt = F.when(
        F.round(F.col("trial_std"), 3) == 0, F.format_string("%.3f", F.col("trial_mean"))
    ).otherwise(F.format_string("%.3f ± %.3f", F.col("trial_mean"), F.col("trial_std")))
    return agg.withColumn("display", txt)


def pivot_table(stats: DataFrame, value_col: str = "display", datasets: list[str] | None = None,
                missing: str = "—") -> DataFrame:
    """Metric rows x dataset columns. Pass ``datasets`` to avoid a distinct-values job."""
    if datasets is None:
        datasets = sorted(r[0] for r in stats.select("dataset").distinct().collect())
    p = stats.groupBy("metric").pivot("dataset", datasets).agg(F.first(value_col))
    return p.select("metric", *[F.coalesce(F.col(f"`{d}`"), F.lit(missing)).alias(d) for d in datasets])
