"""End-to-end pipeline and seeded trials.

load + normalise + dedupe + cap -> sample (per dataset) -> [retrieve + generate] -> score
-> summarise. Every stage is computed once: samples, predictions and scored rows are written
(under ``artifacts_dir`` if given, else in the shared checkpoint folder) and read back by what
follows, so a generator sees each sampled row once and all artifacts agree.

Trials run as ONE job: narrow ids are drawn per trial (with the trial's seed; uniform trials read the
rows once, see ``uniform_trials``), the distinct union of drawn entries goes through retrieval and scoring once, and the scores
are joined back to the draws.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sampling as S
from ..operators.identity import COPY, identified, match
from ..operators.prep import load_and_normalize
from ..operators.report import metric_sums, summarise, summarise_with_overall, trial_stats
from ..operators.retrieval import missing_predictions, run_retrieval
from ..operators.scoring import MetricSpec, score, score_columns
from ..session import saved
from ..sources.sinks import write_artifacts

DEFAULT_CONFIG = {
    "mode": "api",
    "dataset_name": "uploaded",
    "max_items_per_dataset": None,
    "max_context_chars": None,
    "dedupe": True,
    "keep_only_keys": None,
    "subsampling": {"method": "uniform_random"},
    "retrieval": {"technique": "rag"},
    "evals": {"metrics": None, "k_values": None},
    "artifacts_dir": None,
}


def _merged(cfg: dict | None) -> dict:
    out = {k: (dict(v) if isinstance(v, dict) else v) for k, v in DEFAULT_CONFIG.items()}
    for k, v in (cfg or {}).items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k].update(v)
        else:
            out[k] = v
    sub = out["subsampling"]
    for key in ("max_items_per_dataset", "dedupe"):  # accepted nested too
        if key in sub and (cfg or {}).get(key) is None:
            out[key] = sub.pop(key)
    return out


def sampling_step(df: DataFrame, method: str | None, params: dict | None, as_of=None):
    if method in (None, "no_sampling"):
        sampled, audit = S.run_sampler(df, "no_sampling", params)
        return sampled, audit
    return S.run_sampler(df, method, params, as_of=as_of)


def evaluation_step(df: DataFrame, metrics=None, k_values=None, datasets=None):
    """(scored rows, summary). Write the scored rows and summarise those where scoring is dear;
    ``run_pipeline`` does."""
    enriched = score(df, metrics, k_values)
    return enriched, summarise(enriched, MetricSpec.resolve(metrics, k_values).output_keys(), datasets)


def _retrieved(rows: DataFrame, c: dict, generator, embedder) -> DataFrame:
    if str(c["mode"]).lower() == "dataset":
        return rows
    r = dict(c["retrieval"])
    tech = r.pop("technique", "rag")
    r = {k: v for k, v in r.items() if k in ("chunk_size", "top_k", "num_clusters", "edge_threshold", "excerpts_as_contexts")}
    if tech != "rag":
        r["embedder"] = embedder
    return run_retrieval(rows, tech, generator=generator, **r)


def _prepared(rows: DataFrame, c: dict) -> DataFrame:
    return load_and_normalize(
        rows, max_items_per_dataset=c["max_items_per_dataset"], max_context_chars=c["max_context_chars"],
        dedupe_rows=c["dedupe"], keep_only_keys=c["keep_only_keys"],
    )


def run_pipeline(rows: DataFrame, cfg: dict | None = None, *, as_of=None, generator=None, embedder=None, datasets: DataFrame | None = None) -> dict[str, DataFrame]:
    """``rows`` is any canonical QA DataFrame (see ``sources``). Returns the five artifacts
    as DataFrames (also written under ``artifacts_dir`` when it is set). ``datasets`` names sets
    that may have no rows; they appear in audit and summary."""
    c = _merged(cfg)
    sub = dict(c["subsampling"])
    method = sub.pop("method", "uniform_random")
    sampled, audit = S.run_sampler(_prepared(rows, c), method or "no_sampling", sub, as_of=as_of, datasets=datasets)
    sampled = saved(sampled, "sampled")
    preds = sampled if str(c["mode"]).lower() == "dataset" else saved(_retrieved(sampled, c, generator, embedder), "predictions")
    ev = c["evals"]
    enriched = saved(score(preds, ev.get("metrics"), ev.get("k_values")), "enriched")
    summary = summarise(enriched, MetricSpec.resolve(ev.get("metrics"), ev.get("k_values")).output_keys(), datasets)
    out = {
        "sampled": sampled, "predictions": preds, "enriched": enriched, "metrics_summary": summary,
        "sampling_audit": audit, "missing_predicted": missing_predictions(preds),
    }
    if c.get("artifacts_dir"):
        write_artifacts({k: v for k, v in out.items() if k != "missing_predicted"}, c["artifacts_dir"])
    return out


def run_trials(rows: DataFrame, method: str, params: dict | None, *, trials: int = 1, seed_step: int = 1,
               metrics=None, k_values=None, as_of=None, cfg: dict | None = None, generator=None, embedder=None) -> tuple[DataFrame, DataFrame]:
    """Seeded trials in one job. Returns (per-trial summary, mean/std over trials). With ``cfg`` the
    rows are prepared and retrieved as ``run_pipeline`` does; without it stored predictions count."""
    c = _merged({"mode": "dataset", "dedupe": False} | (cfg or {}))
    if cfg is not None:
        rows = saved(_prepared(rows, c), "prepared")
    key = ["dataset", "entry_id", COPY]
    rows = identified(rows)
    merged = S.merge_params(method, params)
    seeds = [str(int(merged.get("seed", 42)) + t * int(seed_step)) for t in range(int(trials))]
    if method == "uniform_random":
        drawn = S.uniform_trials(rows, merged["n"], seeds)
    else:
        rep = rows.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(len(seeds) - 1))))
        seed_col = F.element_at(F.array(*map(F.lit, seeds)), F.col("trial") + 1)
        drawn = S.run_sampler(rep, method, params, as_of=as_of, seed_col=seed_col, part=("trial", "dataset"))[0]
    drawn = saved(drawn.select("trial", *key), "drawn")
    entries = match(rows, drawn.select(*key).distinct(), key, "left_semi")
    if str(c["mode"]).lower() != "dataset":
        entries = saved(_retrieved(entries, c, generator, embedder), "trial-predictions")
    scored, keys = score_columns(entries, metrics, k_values)
    per_trial = match(drawn, scored.select(*key, *[f"`{k}`" for k in keys]), key)
    sums = metric_sums(per_trial, keys, part=("trial", "dataset"))
    summ = saved(sums.select(F.col("trial").cast("int").alias("trial"), "dataset", "metric", (F.col("total") / F.col("n")).alias("mean"), "n"), "trial-summary")
    return summ, trial_stats(summ)


__all__ = ["run_pipeline", "run_trials", "sampling_step", "evaluation_step", "summarise_with_overall"]
