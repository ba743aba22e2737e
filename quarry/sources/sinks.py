"""Writers for the pipeline artifacts: JSON Lines / Parquet partitioned by dataset, CSV
summaries and a JSON trials report. All writes are distributed (no driver gather)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARTIFACTS = ("sampled", "predictions", "enriched", "metrics_summary", "sampling_audit")


def _jsonable(df: DataFrame) -> DataFrame:
    cols = []
    for name, typ in df.dtypes:
        if typ == "variant":
            cols.append(F.to_json(F.col(name)).alias(name))
        else:
            cols.append(F.col(f"`{name}`"))
    return df.select(*cols)


def write_jsonl(df: DataFrame, path: str, partition_by: str | None = "dataset", mode: str = "overwrite") -> str:
    w = _jsonable(df).write.mode(mode)
    if partition_by and partition_by in df.columns:
        w = w.partitionBy(partition_by)
    w.json(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by: str | None = "dataset", mode: str = "overwrite") -> str:
    w = df.write.mode(mode)
    if partition_by and partition_by in df.columns:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    flat = df.select(*[
        (F.to_json(F.col(n)) if t.startswith(("map", "array", "struct")) or t == "variant" else F.col(f"`{n}`")).alias(n)
        for n, t in df.dtypes
    ])
    flat.write.mode(mode).option("header", True).csv(path)
    return path


def write_artifacts(artifacts: dict[str, DataFrame], out_dir: str, fmt: str = "jsonl") -> dict[str, str]:
    """Write each artifact DataFrame under ``out_dir``; returns name -> location."""
    out = {}
    for name, df in artifacts.items():
        if df is None:
            continue
        path = f"{out_dir.rstrip('/')}/{name}"
        out[name] = write_parquet(df, path) if fmt == "parquet" else write_jsonl(df, path)
    return out


def write_trials_report(per_trial: DataFrame, stats: DataFrame, path: str, mode: str = "overwrite") -> str:
    """One JSON line per (dataset, metric): the mean and n of every trial, and their mean, spread
    and display text. ``per_trial`` and ``stats`` come from ``run_trials``."""
    runs = per_trial.groupBy("dataset", "metric").agg(F.sort_array(F.collect_list(F.struct("trial", "mean", "n"))).alias("trials_run"))
    stats.join(runs, ["dataset", "metric"], "left").write.mode(mode).json(path)
    return path
