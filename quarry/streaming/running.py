"""Samples and summaries that run along a stream.

``running_sample`` keeps, for each dataset, the n rows with the least uniform numbers among all seen so
far: the number depends on seed and id alone, so after any split of the rows into micro-batches the
sample is what the batch sampler draws from all of them. Tasks first keep n rows a dataset of a
micro-batch, so a hot dataset sends few rows to its state. ``running_summary`` keeps metric sums and
counts, which add up over micro-batches.

State lives in Spark's state store under the query's checkpoint. Rows that repeat an id have the same
number and count as rows of their own; a NULL dataset is a dataset."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.report import metric_sums
from ..operators.sampling import _seed_col, uid
from ..operators.scoring import score_columns

_ROW = "dataset string, entry_id string, u double, n_seen long"


def _least(rows: pd.DataFrame, n: int) -> pd.DataFrame:
    return rows.sort_values(["u", "entry_id"], kind="stable", na_position="first").head(n)


def running_sample(stream: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(dataset, entry_id, u, n_seen): the current sample of each dataset that a micro-batch touched, and
    how many rows of it had been seen then. Write in update mode; of a dataset's rows those of the
    greatest ``n_seen`` are its sample."""
    rows = stream.select("dataset", F.col("entry_id").cast("string").alias("entry_id"), uid(_seed_col(seed), "pick").alias("u"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = {}, {}
        for b in batches:
            for key, part in b.to_pandas().groupby("dataset", dropna=False):
                key = None if pd.isna(key) else key
                seen[key] = seen.get(key, 0) + len(part)
                held[key] = _least(pd.concat([held[key], part]) if key in held else part, n)
        for key, part in held.items():
            counts = np.zeros(len(part), np.int64)
            counts[:1] = seen[key]  # the task's rows, on one of them
            columns = [pa.array([key] * len(part), pa.string()), pa.array(part["entry_id"].tolist(), pa.string()), pa.array(part["u"].to_numpy()), pa.array(counts)]
            yield pa.RecordBatch.from_arrays(columns, names=["dataset", "entry_id", "u", "n_seen"])

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, us, seen = state.get if state.exists else ([], [], 0)
        held = pd.DataFrame({"entry_id": pd.Series(list(ids), dtype=object), "u": pd.Series(list(us), dtype=float)})
        for f in frames:
            seen += int(f["n_seen"].sum())
            held = _least(pd.concat([held, f[["entry_id", "u"]]]), n)
        state.update((held["entry_id"].tolist(), held["u"].tolist(), seen))
        yield pd.DataFrame({"dataset": [key[0]] * len(held), "entry_id": held["entry_id"].tolist(), "u": held["u"].tolist(), "n_seen": seen})

    if n < 1:
        raise ValueError("n must be at least 1")
    return rows.mapInArrow(partial, _ROW).groupBy("dataset").applyInPandasWithState(
        update, _ROW, "ids array<string>, us array<double>, seen long", "update", GroupStateTimeout.NoTimeout
    )


def running_summary(stream: DataFrame, metrics=None, k_values=None) -> DataFrame:
    """(dataset, metric, total, n) over all rows seen; the mean is total / n. Write in complete or update
    mode. Sums are folded in each task before they reach the state."""
    scored, keys = score_columns(stream, metrics, k_values)
    return metric_sums(scored, keys)
