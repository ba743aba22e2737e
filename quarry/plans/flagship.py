"""Flagship evaluation: QA rows -> prepare (filter, first-wins dedupe) -> score the
JVM-side metric set -> per-dataset and overall means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prep import load_and_normalize
from ..operators.report import summarise_with_overall
from ..operators.scoring import score_columns
from .fixtures import qa_view

FLAGSHIP_METRICS = [
    "em", "f1", "jaccard", "tfidf_cos", "jsd", "levenshtein",
    "support_gold", "support_pred", "coverage_precision", "coverage_recall", "coverage_f1",
    "hit@1", "hit@3", "hit@5", "hit@10", "mrr", "ndcg@1", "ndcg@3", "ndcg@5", "ndcg@10",
    "first_support_rank",
]


def flagship(spark: SparkSession, sf_dir: str, metrics=None) -> DataFrame:
    qa = qa_view(spark, sf_dir, labels=False)
    rows = load_and_normalize(qa)
    scored, keys = score_columns(rows, metrics or FLAGSHIP_METRICS)
    summ = summarise_with_overall(scored, keys)
    return summ.select("dataset", "metric", F.round("mean", 6).alias("mean"), "n")
