"""Scoring on Structured Streaming.

All metrics are row-local, so they run unchanged on a streaming DataFrame. ``foreach_batch_scorer``
also writes a per-dataset summary of each micro-batch; every batch is written under its epoch id,
so a retried batch overwrites its own output (idempotent sink), and is scored once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.report import summarise
from ..operators.scoring import MetricSpec, score, score_columns

ROW_LOCAL_DEFAULT = ["em", "levenshtein", "support_gold", "support_pred", "hit@1", "hit@3", "mrr", "ndcg@3",
                     "first_support_rank"]


def score_stream(stream_df: DataFrame, metrics=None, k_values=None) -> DataFrame:
    """Metric columns on a streaming DataFrame (no state, no shuffle)."""
    return score_columns(stream_df, metrics or ROW_LOCAL_DEFAULT, k_values)[0]


def foreach_batch_scorer(out_path: str, metrics=None, k_values=None):
    """``writeStream.foreachBatch(fn)`` callback: full scoring + per-dataset summary of each
    micro-batch, written to ``out_path/{enriched,summary}/epoch=<id>``."""

    def fn(batch: DataFrame, epoch_id: int) -> None:
        path = f"{out_path}/enriched/epoch={epoch_id}"
        score(batch, metrics, k_values).write.mode("overwrite").parquet(path)
        keys = MetricSpec.resolve(metrics, k_values).output_keys()
        summarise(batch.sparkSession.read.parquet(path), keys).write.mode("overwrite").parquet(f"{out_path}/summary/epoch={epoch_id}")

    return fn
