"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Every query reads the driver tables (or data Spark derives from them) in full. Keys follow
the operator IDs of the blueprint (a.. sources, b.. samplers, c.. retrieval, d.. metrics,
e.. reports). Floating results are rounded to 6 digits in both engines.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators.scoring import score_columns
from . import oracle_sql as O
from .fixtures import qa_view

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, sql)
        return fn

    return deco


def safe_name(key: str) -> str:
    return key.replace("@", "_at_").replace("-", "_")


def r6(c):
    return F.round(c.cast("double"), 6)


# ---------------------------------------------------------------- metrics (per row) ----

def _metric_query(name: str, metrics: list[str], keys: list[str], k_values=None, ids="lang", engine="arrow"):
    def spark_fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        qa = qa_view(spark, sf_dir, labels=False, shared_ids=ids == "shared", repeated_ids=ids == "repeated")
        scored, _ = score_columns(qa, metrics, k_values, engine=engine)
        return scored.select("dataset", "entry_id", *[r6(F.col(f"`{k}`")).alias(safe_name(k)) for k in keys])

    ex = O.metric_exprs(tuple(k_values) if k_values else (1, 3, 5, 10))
    sel = ", ".join(f"round({ex[k]}, 6) AS \"{safe_name(k)}\"" for k in keys)
    sql = O.with_qa(f"SELECT dataset, entry_id, {sel} FROM prep", O.PREP_CTE, ids=ids)
    if ids == "repeated":
        sql = O.repeated(sql, "dataset", "entry_id", *[f'"{safe_name(k)}"' for k in keys])
    REGISTRY[name] = (spark_fn, sql)


_metric_query("d03_em", ["em"], ["EM"])
_metric_query("d04_f1", ["f1"], ["F1"])
_metric_query("d04b_f1_shared_ids", ["f1"], ["F1"], ids="shared")
_metric_query("d04c_bags_by_token", ["f1", "jaccard", "tfidf_cos", "jsd", "coverage_f1"],
              ["F1", "jaccard", "tfidf_cos", "jsd", "CoverageF1"], ids="shared", engine="tokens")
_metric_query("d04d_bags_repeated_ids", ["f1", "jaccard", "jsd", "coverage_f1"], ["F1", "jaccard", "jsd", "CoverageF1"], ids="repeated", engine="tokens")
_metric_query("d06_jaccard", ["jaccard"], ["jaccard"])
_metric_query("d09_tfidf_cos", ["tfidf_cos"], ["tfidf_cos"])
_metric_query("d10_jsd", ["jsd"], ["jsd"])
_metric_query("d18_support_gold", ["support_gold"], ["SupportGoldInContexts"])
_metric_query("d19_support_pred", ["support_pred"], ["SupportPredInContexts"])
_metric_query(
    "d20_coverage", ["coverage_precision", "coverage_recall", "coverage_f1"],
    ["CoveragePrecision", "CoverageRecall", "CoverageF1"],
)
_metric_query("d22_hit_at_k", ["hit@1", "hit@3", "hit@5", "hit@10"], ["hit@1", "hit@3", "hit@5", "hit@10"])
_metric_query("d23_mrr", ["mrr"], ["MRR"])
_metric_query("d24_ndcg_at_k", ["ndcg@1", "ndcg@3", "ndcg@5", "ndcg@10"], ["ndcg@1", "ndcg@3", "ndcg@5", "ndcg@10"])
_metric_query("d25_first_support_rank", ["first_support_rank"], ["first_support_rank"])
_metric_query(
    "d27_score_local",
    ["em", "f1", "jaccard", "tfidf_cos", "jsd", "support_gold", "support_pred", "coverage_precision",
     "coverage_recall", "coverage_f1", "hit@1", "hit@5", "mrr", "ndcg@3", "first_support_rank"],
    ["EM", "F1", "jaccard", "tfidf_cos", "jsd", "SupportGoldInContexts", "SupportPredInContexts",
     "CoveragePrecision", "CoverageRecall", "CoverageF1", "hit@1", "hit@5", "MRR", "ndcg@3", "first_support_rank"],
    k_values=[1, 3, 5],
)


@register(
    "d01_normalise",
    O.with_qa(
        f"SELECT dataset, entry_id, {O.normalize('Predicted')} AS pred_norm, {O.normalize('Response')} AS gold_norm FROM qa"
    ),
)
def d01_normalise(spark, sf_dir):
    qa = qa_view(spark, sf_dir, labels=False)
    return qa.select("dataset", "entry_id", TX.normalize("Predicted").alias("pred_norm"),
                     TX.normalize("Response").alias("gold_norm"))


@register(
    "d02_tokens",
    O.with_qa(
        f"SELECT dataset, entry_id, len({O.norm_tokens('Context')}) AS n_tokens, "
        f"array_to_string(list_sort(list_distinct({O.norm_tokens('Question')})), '|') AS q_vocab FROM qa"
    ),
)
def d02_tokens(spark, sf_dir):
    qa = qa_view(spark, sf_dir, labels=False)
    return qa.select(
        "dataset", "entry_id", F.size(TX.norm_tokens("Context")).cast("bigint").alias("n_tokens"),
        F.array_join(F.array_sort(F.array_distinct(TX.norm_tokens("Question"))), "|").alias("q_vocab"),
    )


@register(
    "d17_contexts",
    O.with_qa(
        f"SELECT dataset, entry_id, CAST(len({O.contexts()}) AS BIGINT) AS n_ctx, "
        f"array_to_string({O.contexts()}, '||') AS ctx_joined FROM qa"
    ),
)
def d17_contexts(spark, sf_dir):
    from ..operators.scoring import contexts_column

    qa = qa_view(spark, sf_dir, labels=False)
    c = contexts_column(qa)
    return qa.select("dataset", "entry_id", F.size(c).cast("bigint").alias("n_ctx"),
                     F.array_join(c, "||").alias("ctx_joined"))


@register(
    "d21_support_rank",
    O.with_qa(f"SELECT dataset, entry_id, CAST({O.metric_exprs()['_rank']} AS BIGINT) AS rank FROM prep", O.PREP_CTE),
)
def d21_support_rank(spark, sf_dir):
    from ..operators.scoring import retrieval_rank

    qa = qa_view(spark, sf_dir, labels=False)
    return qa.select("dataset", "entry_id", retrieval_rank(qa).cast("bigint").alias("rank"))


# ---------------------------------------------------------------- reports ----------

_SUMMARY_KEYS = ["EM", "F1", "jaccard", "tfidf_cos", "jsd", "SupportGoldInContexts", "CoverageF1",
                 "hit@1", "hit@5", "MRR", "ndcg@3", "first_support_rank"]
_SUMMARY_METRICS = ["em", "f1", "jaccard", "tfidf_cos", "jsd", "support_gold", "coverage_f1",
                    "hit@1", "hit@5", "mrr", "ndcg@3", "first_support_rank"]


def _summary_source_sql() -> str:
    ex = O.metric_exprs((1, 3, 5))
    sel = ", ".join(f"{ex[k]} AS \"{k}\"" for k in _SUMMARY_KEYS)
    return f"scored AS (SELECT dataset, entry_id, {sel} FROM prep),\nlm AS (UNPIVOT scored ON {', '.join(chr(34) + k + chr(34) for k in _SUMMARY_KEYS)} INTO NAME metric VALUE value)"


@register(
    "e01_summary",
    O.with_qa(
        "SELECT dataset, metric, round(avg(value), 6) AS mean, count(value) AS n FROM lm GROUP BY dataset, metric",
        O.PREP_CTE, _summary_source_sql(),
    ),
)
def e01_summary(spark, sf_dir):
    from ..operators.report import summarise

    qa = qa_view(spark, sf_dir, labels=False)
    scored, keys = score_columns(qa, _SUMMARY_METRICS, [1, 3, 5])
    s = summarise(scored, keys)
    return s.select("dataset", "metric", F.round("mean", 6).alias("mean"), "n")


@register(
    "e02_overall",
    O.with_qa(
        "SELECT CASE WHEN grouping(dataset) = 1 THEN '__ALL__' ELSE dataset END AS dataset, metric, "
        "round(avg(value), 6) AS mean, count(value) AS n FROM lm GROUP BY GROUPING SETS ((dataset, metric), (metric))",
        O.PREP_CTE, _summary_source_sql(),
    ),
)
def e02_overall(spark, sf_dir):
    from ..operators.report import summarise_with_overall

    qa = qa_view(spark, sf_dir, labels=False)
    scored, keys = score_columns(qa, _SUMMARY_METRICS, [1, 3, 5])
    s = summarise_with_overall(scored, keys)
    return s.select("dataset", "metric", F.round("mean", 6).alias("mean"), "n")


# ---------------------------------------------------------------- samplers ---------
from ..operators import sampling as S  # noqa: E402
from ..session import saved, scratch_path  # noqa: E402
from ..sources import readers as RD  # noqa: E402

SAMPLE_N = 20
AS_OF = "2024-01-03 00:00:00"


def _rank_sql(select_from: str, order: str, n: int, part: str = "dataset") -> str:
    return (f"SELECT dataset, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS rn "
            f"FROM {select_from}) WHERE rn <= {n}")


def _sampler_query(name, method, params, sql, view_kw=None, as_of=None, source=qa_view):
    def fn(spark, sf_dir):
        qa = source(spark, sf_dir, **(view_kw or {}))
        out, _audit = S.run_sampler(qa, method, params, as_of=as_of)
        return out.select("dataset", "entry_id")

    REGISTRY[name] = (fn, sql)


_sampler_query("b01_no_sampling", "no_sampling", {}, O.with_qa("SELECT dataset, entry_id FROM qa"))
_sampler_query(
    "b02_uniform", "uniform_random", {"n": SAMPLE_N},
    O.with_qa(_rank_sql("qa", f"{O.u(42, 'pick', O.ID)}, entry_id", SAMPLE_N)),
)


def _strat_sql(n: int, allocation: str, min_per: int = 0, vf: str | None = None, ids: str = "lang") -> str:
    qtok = f"len({O.sampler_tokens('Question')})::DOUBLE"
    val = qtok if vf in (None, "length") else f"coalesce(CAST({vf} AS DOUBLE), {qtok})"
    if allocation == "equal":
        alloc = (f"least(Nh, (CAST(floor({n} / k) AS BIGINT)) + CASE WHEN (row_number() OVER (PARTITION BY dataset ORDER BY first, stratum) - 1) "
                 f"< {n} - CAST(floor({n} / k) AS BIGINT) * k THEN 1 ELSE 0 END)")
    elif allocation == "neyman":
        alloc = f"least(Nh, CAST(round_even({float(n)} * (wgt / CASE WHEN tot = 0 THEN 1.0 ELSE tot END), 0) AS BIGINT))"
    else:
        alloc = f"least(Nh, CAST(round_even({float(n)} * (Nh / N), 0) AS BIGINT))"
    ctes = [
        f"rows AS (SELECT dataset, entry_id, coalesce(CAST(topic AS VARCHAR), 'None') || '||' || coalesce(CAST(answer_type AS VARCHAR), 'None') AS stratum, "
        f"{O.u(42, 'shuffle', O.ID)} AS u0, {val} AS val, {O.u(42, 'stratum', O.ID)} AS u2 FROM qa)",
        "st AS (SELECT dataset, stratum, count(*) AS Nh, min(u0) AS first, stddev_samp(val) AS sd FROM rows GROUP BY dataset, stratum)",
        "st1 AS (SELECT *, sum(Nh) OVER (PARTITION BY dataset) AS N, count(*) OVER (PARTITION BY dataset) AS k, "
        "greatest(Nh, 1) * (CASE WHEN Nh <= 1 THEN 1.0 WHEN coalesce(sd, 0) = 0 THEN 1.0 ELSE sd END) AS wgt FROM st)",
        "st2 AS (SELECT *, sum(wgt) OVER (PARTITION BY dataset) AS tot FROM st1)",
        f"st3 AS (SELECT *, {alloc} AS alloc FROM st2)",
        f"st4 AS (SELECT *, least(greatest(alloc, {max(min_per, 0)}), Nh) AS fl FROM st3)",
        f"st5 AS (SELECT *, alloc - fl AS frac, Nh - fl AS cap, greatest({n} - sum(fl) OVER (PARTITION BY dataset), 0) AS R, "
        "row_number() OVER (PARTITION BY dataset ORDER BY alloc - fl DESC, stratum DESC) AS srank FROM st4)",
        "slots AS (SELECT dataset, stratum, srank, R, unnest(range(1, CAST(least(cap, R) AS BIGINT) + 1)) AS j FROM st5)",
        "ex AS (SELECT dataset, stratum, count(*) AS extra FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY j, srank) AS o FROM slots) WHERE o <= R GROUP BY dataset, stratum)",
        f"m AS (SELECT st5.dataset, st5.stratum, CASE WHEN N <= {n} THEN Nh ELSE fl + coalesce(extra, 0) END AS m FROM st5 LEFT JOIN ex USING (dataset, stratum))",
    ]
    body = ("SELECT r.dataset, r.entry_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset, stratum ORDER BY u2, entry_id) AS rh FROM rows) r "
            "JOIN m USING (dataset, stratum) WHERE r.rh <= m.m")
    return O.with_qa(body, *ctes, ids=ids)


_sampler_query("b03a_stratified_proportional", "stratified", {"n": 30}, _strat_sql(30, "proportional"))
_sampler_query("b03b_stratified_equal", "stratified", {"n": 30, "allocation": "equal"}, _strat_sql(30, "equal"))
_sampler_query(
    "b03c_stratified_neyman", "stratified", {"n": 30, "allocation": "neyman", "variability_field": "difficulty"},
    _strat_sql(30, "neyman", vf="difficulty"),
)
_sampler_query(
    "b03d_stratified_min_floor", "stratified", {"n": 60, "min_per_stratum": 2}, _strat_sql(60, "proportional", min_per=2),
)

def _imp_sql(ids: str = "lang", weight: str = "weight") -> str:
  return O.with_qa(
    _rank_sql("k", "key, entry_id", SAMPLE_N),
    f"r AS (SELECT dataset, entry_id, CASE WHEN isnan(coalesce({weight}, 0.0)) THEN 0.0 ELSE greatest(coalesce({weight}, 0.0), 0.0) END AS w FROM qa)",
    "s AS (SELECT dataset, sum(w) AS wsum, count(*) AS N FROM r GROUP BY dataset)",
    "r2 AS (SELECT r.*, s.wsum, s.N, least((w / nullif(wsum, 0) + 1e-09) / (1.0 + N * 1e-09), (1.0 / N) * 5.0) AS p3 FROM r JOIN s USING (dataset))",
    "s3 AS (SELECT dataset, sum(p3) AS S3 FROM r2 GROUP BY dataset)",
    f"k AS (SELECT r2.dataset, entry_id, CASE WHEN wsum > 0 THEN -ln({O.u(42, 'es', O.ID)}) / greatest(p3 / S3, 1e-12) "
    f"ELSE {O.u(42, 'pick', O.ID)} END AS key FROM r2 JOIN s3 USING (dataset))", ids=ids,
  )


_sampler_query("b05_importance_weighted", "importance_weighted", {"n": SAMPLE_N}, _imp_sql())


def _some_weightless(spark, sf_dir):
    """Dataset ``fr`` has only zero weights, ``de`` has none."""
    weight = F.when(F.col("dataset") == "fr", 0.0).when(F.col("dataset") != "de", F.col("weight"))
    return qa_view(spark, sf_dir).withColumn("weight", weight)


_sampler_query("b05c_zero_weights", "importance_weighted", {"n": SAMPLE_N},
               _imp_sql(weight="(CASE WHEN dataset = 'fr' THEN 0.0 WHEN dataset <> 'de' THEN weight END)"), source=_some_weightless)


def _al_sql(mode: str, ids: str = "lang") -> str:
    ps = "list_transform(probs, lambda x: greatest(1e-12, least(1 - 1e-12, x)))"
    pn = f"list_transform({ps}, lambda x: x / list_sum({ps}))"
    ok = "(probs IS NOT NULL AND len(probs) >= 2)"
    qlen = f"len({O.sampler_tokens('Question')})::DOUBLE"
    if mode == "entropy":
        sc = f"CASE WHEN {ok} THEN -list_sum(list_transform({pn}, lambda x: greatest(1e-12, x) * ln(greatest(1e-12, x)))) END"
    elif mode == "margin":
        srt = f"list_sort({pn}, 'DESC')"
        sc = f"CASE WHEN {ok} THEN 1.0 - ({srt}[1] - {srt}[2]) END"
    else:
        vals = "list_transform(map_values(MAP {'a': CAST(label % 2 AS VARCHAR), 'b': CAST(quality AS VARCHAR), 'c': CAST(toxic AS VARCHAR)}), lambda x: coalesce(x, chr(0) || 'None'))"
        top = f"list_max(list_transform(list_distinct({vals}), lambda d: len(list_filter({vals}, lambda x: x = d))))"
        sc = f"1.0 - {top} / len({vals})"
    return O.with_qa(
        _rank_sql("sc", f"score DESC, {O.u(42, 'shuffle', O.ID)}, entry_id", SAMPLE_N),
        f"sc AS (SELECT dataset, entry_id, coalesce({sc}, {qlen}) AS score FROM qa)", ids=ids,
    )


for _mode, _key in (("entropy", "b06a_active_entropy"), ("margin", "b06b_active_margin"), ("disagreement", "b06c_active_disagreement")):
    _sampler_query(_key, "active_learning", {"n": SAMPLE_N, "mode": _mode}, _al_sql(_mode), view_kw={"embeddings": True})


def _diff_sql(hard_frac: float, ids: str = "lang", difficulty: str = "difficulty", answer: str = "''") -> str:
    qt = O.sampler_tokens("Question")
    ents = (f"len(list_filter(regexp_split_to_array(coalesce(Question, ''), '{O.WS_RUN}'), lambda t: t <> '' AND "
            "upper(substr(t, 1, 1)) = substr(t, 1, 1) AND lower(substr(t, 1, 1)) <> substr(t, 1, 1)))")
    ct = O.sampler_tokens("CASE WHEN RetrievedContexts IS NOT NULL THEN array_to_string(RetrievedContexts, ' ') ELSE '' END")

    def jac(a, b):
        da, db = f"list_distinct({a})", f"list_distinct({b})"
        return (f"(CASE WHEN len({da}) = 0 OR len({db}) = 0 THEN 0.0 ELSE len(list_intersect({da}, {db}))::DOUBLE / "
                f"len(list_distinct(list_concat({da}, {db}))) END)")

    score = f"coalesce({difficulty}, 1.0 * len({qt}) + 0.5 * {ents} - 1.0 * greatest({jac(qt, O.sampler_tokens(answer))}, {jac(qt, ct)}))"
    sc = f"sc AS (SELECT dataset, entry_id, {score} AS score FROM qa)"
    order = f"score DESC, {O.u(42, 'shuffle', O.ID)}, entry_id"
    if hard_frac >= 1.0:
        return O.with_qa(_rank_sql("sc", order, SAMPLE_N), sc, ids=ids)
    k_hard = int(round(SAMPLE_N * hard_frac))
    hr = f"hr AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {order}) AS h FROM sc)"
    order2 = f"CASE WHEN h <= {k_hard} THEN 0 ELSE 1 END, CASE WHEN h <= {k_hard} THEN h END, {O.u(42, 'rest', O.ID)}, entry_id"
    return O.with_qa(_rank_sql("hr", order2, SAMPLE_N), sc, hr, ids=ids)


_sampler_query("b07_difficulty_aware", "difficulty_aware", {"n": SAMPLE_N}, _diff_sql(1.0))
_sampler_query("b07b_difficulty_hard_frac", "difficulty_aware", {"n": SAMPLE_N, "hard_frac": 0.5}, _diff_sql(0.5))

def _window_sql(ids: str = "lang") -> str:
    return O.with_qa(_rank_sql(
        "qa", f"CASE WHEN date >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY THEN 0 ELSE 1 END, {O.u(42, 'pick', O.ID)}, entry_id",
        SAMPLE_N), ids=ids)


_sampler_query("b08_temporal_window", "temporal_recent", {"n": SAMPLE_N, "days": 1}, _window_sql(), view_kw={"events": True}, as_of=AS_OF)
def _decay_sql(ids: str = "lang") -> str:
    return O.with_qa(
        _rank_sql("k", "key, entry_id", SAMPLE_N),
        f"w AS (SELECT dataset, entry_id, CASE WHEN date IS NULL THEN 0.1 ELSE exp(-{__import__('math').log(2)!r} * "
        f"greatest(0.0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(date)) / 1000000.0 / 86400.0) / 1.0) END AS w FROM qa)",
        "t AS (SELECT dataset, sum(w) AS T FROM w GROUP BY dataset)",
        f"k AS (SELECT w.dataset, entry_id, -ln({O.u(42, 'es', O.ID)}) / greatest(w / CASE WHEN T = 0 THEN 1.0 ELSE T END, 1e-12) AS key FROM w JOIN t USING (dataset))",
        ids=ids,
    )


_sampler_query("b08a_temporal_decay", "temporal_recent", {"n": SAMPLE_N, "mode": "decay", "half_life_days": 1}, _decay_sql(),
               view_kw={"events": True}, as_of=AS_OF)


def _mix_sql(ids: str = "lang") -> str:
    return O.with_qa(
        "SELECT dataset, entry_id FROM rk JOIN st USING (dataset) WHERE CASE WHEN flag THEN rf <= wpos + fill ELSE rf <= wneg END",
        f"rk AS (SELECT dataset, entry_id, is_unanswerable AS flag, row_number() OVER (PARTITION BY dataset, is_unanswerable "
        f"ORDER BY {O.u(42, 'pick', O.ID)}, entry_id) AS rf FROM qa)",
        "st0 AS (SELECT dataset, sum(CASE WHEN is_unanswerable THEN 1 ELSE 0 END) AS npos, sum(CASE WHEN is_unanswerable THEN 0 ELSE 1 END) AS nneg FROM qa GROUP BY dataset)",
        f"st1 AS (SELECT *, least(npos, {int(round(SAMPLE_N * 0.2))}) AS wpos FROM st0)",
        f"st2 AS (SELECT *, least(nneg, {SAMPLE_N} - wpos) AS wneg FROM st1)",
        f"st AS (SELECT *, greatest({SAMPLE_N} - wpos - wneg, 0) AS fill FROM st2)", ids=ids,
    )


_sampler_query("b09_unanswerable_mix", "unanswerable_mix", {"n": SAMPLE_N}, _mix_sql())


# The same samplers over rows that repeat ids, a third of them without a dataset.

_REPEATED = {
    "b02c_uniform_repeated_ids": ("uniform_random", {}, O.with_qa(_rank_sql("qa", f"{O.u(42, 'pick', O.ID)}, entry_id", SAMPLE_N), ids="repeated")),
    "b03e_stratified_repeated_ids": ("stratified", {"n": 30}, _strat_sql(30, "proportional", ids="repeated")),
    "b05d_importance_repeated_ids": ("importance_weighted", {}, _imp_sql(ids="repeated")),
    "b07d_difficulty_repeated_ids": ("difficulty_aware", {"hard_frac": 0.5}, _diff_sql(0.5, ids="repeated")),
    "b08d_decay_repeated_ids": ("temporal_recent", {"mode": "decay", "half_life_days": 1}, _decay_sql(ids="repeated")),
    "b09c_unanswerable_repeated_ids": ("unanswerable_mix", {}, _mix_sql(ids="repeated")),
}
for _key, (_method, _params, _sql) in _REPEATED.items():
    _sampler_query(_key, _method, {"n": SAMPLE_N} | _params, O.repeated(_sql, "dataset", "entry_id"),
                   view_kw={"events": _method == "temporal_recent", "repeated_ids": True}, as_of=AS_OF)


# The same samplers over JSON Lines: fields are keys and dotted paths of the rows.

def _jsonl_rows(spark, sf_dir, **view):
    qa = qa_view(spark, sf_dir, **view)
    have = set(qa.columns)
    nested = {"stats": ["weight", "difficulty"], "metadata": ["topic", "date"], "model": ["probs", "committee_votes"], "flags": ["is_unanswerable"]}
    if "date" in have:
        qa = qa.withColumn("date", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    cols = [F.struct(*[c for c in cs if c in have]).alias(k) for k, cs in nested.items() if have & set(cs)]
    if "answer_type" in have:
        cols.append(F.col("answer_type"))
    raw = qa.select(
        F.col("entry_id").alias("id"), F.col("Question").alias("question"), F.col("RetrievedContexts").alias("contexts"),
        F.struct(F.array("Response").alias("text")).alias("answers"), *cols,
    )
    path = scratch_path(spark, "jsonl-rows")
    raw.write.json(path)
    return RD.read_jsonl(spark, path)


_sampler_query("b03f_stratified_jsonl", "stratified", {"n": 30, "strata_keys": ["metadata.topic", "answer_type"]}, _strat_sql(30, "proportional", ids="uploaded"), source=_jsonl_rows)
_sampler_query("b05b_importance_jsonl", "importance_weighted", {"n": SAMPLE_N, "weight_field": "stats.weight"}, _imp_sql("uploaded"), source=_jsonl_rows)
_sampler_query("b06d_active_jsonl", "active_learning", {"n": SAMPLE_N, "probs_field": "model.probs"}, _al_sql("entropy", "uploaded"), {"embeddings": True}, source=_jsonl_rows)
_sampler_query("b06e_committee_jsonl", "active_learning", {"n": SAMPLE_N, "mode": "disagreement", "committee_votes_field": "model.committee_votes"},
               _al_sql("disagreement", "uploaded"), {"embeddings": True}, source=_jsonl_rows)
_sampler_query("b07c_difficulty_answers_jsonl", "difficulty_aware", {"n": SAMPLE_N, "difficulty_field": "stats.difficulty", "hard_frac": 0.5},
               _diff_sql(0.5, "uploaded", answer="Response"), source=_jsonl_rows)
_sampler_query("b08c_temporal_jsonl", "temporal_recent", {"n": SAMPLE_N, "days": 1, "date_field": "metadata.date"}, _window_sql("uploaded"), {"events": True}, AS_OF, _jsonl_rows)
_sampler_query("b09b_unanswerable_jsonl", "unanswerable_mix", {"n": SAMPLE_N, "flag_field": "flags.is_unanswerable"}, _mix_sql("uploaded"), source=_jsonl_rows)
_sampler_query("b02b_uniform_shared_ids", "uniform_random", {"n": SAMPLE_N},
               O.with_qa(_rank_sql("qa", f"{O.u(42, 'pick', O.ID)}, entry_id", SAMPLE_N), ids="shared"), {"shared_ids": True})


@register(
    "b10_weighted_es",
    O.with_qa(
        _rank_sql("k", "key, entry_id", SAMPLE_N),
        "t AS (SELECT dataset, sum(CAST(n_chars AS DOUBLE)) AS T FROM documents d JOIN (SELECT DISTINCT dataset FROM qa) q ON q.dataset = d.lang GROUP BY dataset)",
        f"k AS (SELECT qa.dataset, entry_id, -ln({O.u(7, 'es', O.ID)}) / greatest(CAST(d.n_chars AS DOUBLE) / T, 1e-12) AS key "
        "FROM qa JOIN documents d ON CAST(d.doc_id AS VARCHAR) = qa.entry_id JOIN t USING (dataset))",
    ),
)
def b10_weighted_es(spark, sf_dir):
    from .fixtures import _read

    qa = qa_view(spark, sf_dir, labels=False)
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("entry_id"), F.col("n_chars").cast("double").alias("w"))
    return S.weighted_sample(qa.join(docs, "entry_id"), F.col("w"), SAMPLE_N, 7).select("dataset", "entry_id")


@register(
    "b11_audit",
    O.with_qa("SELECT dataset, 'uniform_random' AS method, CAST(200 AS BIGINT) AS requested_n, "
              "CAST(least(count(*), 200) AS BIGINT) AS actual_n FROM qa GROUP BY dataset"),
)
def b11_audit(spark, sf_dir):
    qa = qa_view(spark, sf_dir, labels=False)
    _out, audit = S.run_sampler(qa, "uniform_random", {"n": 200})
    return audit.select("dataset", "method", "requested_n", "actual_n")


@register(
    "b13_sampler_tokens",
    O.with_qa(f"SELECT dataset, entry_id, CAST(len({O.sampler_tokens('Question')}) AS BIGINT) AS n_tok, "
              f"array_to_string({O.sampler_tokens('Question')}, '|') AS toks FROM qa"),
)
def b13_sampler_tokens(spark, sf_dir):
    qa = qa_view(spark, sf_dir, labels=False)
    t = TX.sampler_tokens("Question")
    return qa.select("dataset", "entry_id", F.size(t).cast("bigint").alias("n_tok"), F.array_join(t, "|").alias("toks"))


_TFIDF_CTES = (
    f"tk AS (SELECT dataset, entry_id, {O.sampler_tokens('Question')} AS t FROM qa)",
    "ex AS (SELECT dataset, entry_id, unnest(t) AS term FROM tk)",
    "tf AS (SELECT dataset, entry_id, term, count(*) AS c FROM ex GROUP BY ALL)",
    "nd AS (SELECT dataset, count(*) AS N FROM qa GROUP BY dataset)",
    "dfq AS (SELECT dataset, term, count(*) AS dfreq FROM tf GROUP BY ALL)",
    "post AS (SELECT tf.dataset, tf.entry_id, tf.term, c / greatest(len(tk.t), 1)::DOUBLE * (ln((N + 1.0) / (dfreq + 1.0)) + 1.0) AS w "
    "FROM tf JOIN tk USING (dataset, entry_id) JOIN dfq USING (dataset, term) JOIN nd USING (dataset))",
)


@register("b14_tfidf_postings", O.with_qa("SELECT dataset, entry_id, term, round(w, 6) AS w FROM post", *_TFIDF_CTES))
def b14_tfidf_postings(spark, sf_dir):
    from ..operators.vectors import tfidf_postings

    qa = qa_view(spark, sf_dir, labels=False)
    p = tfidf_postings(qa, F.col("Question"))
    return p.select("dataset", "entry_id", "term", F.round("w", 6).alias("w"))


@register(
    "b15_sparse_cosine",
    O.with_qa(
        "SELECT p.dataset, p.entry_id, round(CASE WHEN nr.nrm = 0 OR c.cnorm = 0 THEN 0.0 ELSE coalesce(d.dot, 0.0) / (nr.nrm * c.cnorm) END, 6) AS cos "
        "FROM (SELECT DISTINCT dataset, entry_id FROM qa) p JOIN nr USING (dataset, entry_id) JOIN cn c USING (dataset) "
        "LEFT JOIN d USING (dataset, entry_id)",
        *_TFIDF_CTES,
        f"ctr AS (SELECT dataset, arg_min(entry_id, {O.u(42, 'first', O.ID)}) AS cid FROM qa GROUP BY dataset)",
        "nr AS (SELECT q.dataset, q.entry_id, coalesce(sqrt(sum(w * w)), 0.0) AS nrm FROM qa q LEFT JOIN post USING (dataset, entry_id) GROUP BY ALL)",
        "cp AS (SELECT post.dataset, term, w AS wc FROM post JOIN ctr ON post.dataset = ctr.dataset AND post.entry_id = ctr.cid)",
        "cn AS (SELECT ctr.dataset, nr.nrm AS cnorm FROM ctr JOIN nr ON nr.dataset = ctr.dataset AND nr.entry_id = ctr.cid)",
        "d AS (SELECT post.dataset, post.entry_id, sum(w * wc) AS dot FROM post JOIN cp USING (dataset, term) GROUP BY ALL)",
    ),
)
def b15_sparse_cosine(spark, sf_dir):
    from ..operators.vectors import cosine_to, norms, tfidf_postings

    qa = qa_view(spark, sf_dir, labels=False)
    post = saved(tfidf_postings(qa, F.col("Question")), "postings")
    nrm = norms(post)
    ctr = qa.groupBy("dataset").agg(F.min_by("entry_id", S.uid(S._seed_col(42), "first")).alias("cid"))
    of_center = lambda df: df.join(ctr.withColumnRenamed("cid", "entry_id"), ["dataset", "entry_id"])
    center = of_center(post).join(of_center(nrm).select("dataset", F.col("norm").alias("cnorm")), "dataset")
    cos = cosine_to(post, nrm, center.select("dataset", "term", F.col("w").alias("wc"), "cnorm"))
    out = qa.select("dataset", "entry_id").join(cos, ["dataset", "entry_id"], "left")
    return out.select("dataset", "entry_id", F.round(F.coalesce("cos", F.lit(0.0)), 6).alias("cos"))


@register(
    "b17_embedding_validator",
    O.with_qa("SELECT dataset, CAST(sum(CASE WHEN embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x))) "
              "THEN 1 ELSE 0 END) AS BIGINT) AS n_valid, bool_and(embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x)))) AS all_valid FROM qa GROUP BY dataset"),
)
def b17_embedding_validator(spark, sf_dir):
    from ..operators.vectors import embedding_valid

    qa = qa_view(spark, sf_dir, labels=False, embeddings=True)
    ok = embedding_valid(F.col("embedding"))
    return qa.groupBy("dataset").agg(F.sum(F.when(ok, 1).otherwise(0)).cast("bigint").alias("n_valid"), F.bool_and(ok).alias("all_valid"))


KCENTER_N = 8


def _kcenter_sql(vector: str, body: str, ids: str = "lang") -> str:
    """Greedy farthest-first, one pair of CTEs a round: the distances after k picks, then the next."""
    norm = f"sqrt(list_sum(list_transform({vector}, lambda x: x * x)))"
    ctes = [
        f"v AS (SELECT dataset, entry_id, list_transform({vector}, lambda x: x / {norm}) AS e, {O.u(42, 'shuffle', O.ID)} AS u0, {O.u(42, 'first', O.ID)} AS u1 FROM qa)",
        "c0 AS (SELECT dataset, arg_min(entry_id, u1) AS entry_id FROM v GROUP BY dataset)",
        "s0 AS (SELECT v.*, 2.0::DOUBLE AS md, false AS taken FROM v)",
    ]
    for k in range(KCENTER_N - 1):
        ctes.append(f"s{k + 1} AS (SELECT s.dataset, s.entry_id, s.e, s.u0, s.u1, least(s.md, round(greatest(0.0, 1.0 - list_dot_product(s.e, c.e)), 12)) AS md, "
                    f"s.taken OR s.entry_id = c.entry_id AS taken FROM s{k} s JOIN (SELECT v.dataset, v.entry_id, v.e FROM v JOIN c{k} USING (dataset, entry_id)) c ON c.dataset = s.dataset)")
        ctes.append(f"c{k + 1} AS (SELECT dataset, arg_max(entry_id, (md, -u0)) AS entry_id FROM s{k + 1} WHERE NOT taken GROUP BY dataset)")
    ctes.append("picks AS (" + " UNION ALL ".join(f"SELECT dataset, entry_id FROM c{k}" for k in range(KCENTER_N)) + ")")
    return O.with_qa(body, *ctes, ids=ids)


@register("b04_kcenter", _kcenter_sql("embedding", "SELECT dataset, entry_id FROM picks"))
def b04_kcenter(spark, sf_dir):
    qa = qa_view(spark, sf_dir, labels=False, embeddings=True)
    out, _ = S.run_sampler(qa, "diversity_kcenter", {"n": KCENTER_N})
    return out.select("dataset", "entry_id")


_FIVE = "list_transform([0, 1, 2, 3, 4], lambda i: CASE WHEN pos % 5 = i THEN 1.0 ELSE 0.0 END)"


@register("b04c_kcenter_duplicates", _kcenter_sql(_FIVE, "SELECT dataset, entry_id FROM picks", ids="shared"))
def b04c_kcenter_duplicates(spark, sf_dir):
    """Five distinct vectors and eight to choose: copies fill the rest in shuffled order."""
    qa = qa_view(spark, sf_dir, labels=False, shared_ids=True)
    qa = qa.withColumn("embedding", F.transform(F.array(*map(F.lit, range(5))), lambda i: F.when(F.col("pos") % 5 == i, 1.0).otherwise(0.0)))
    out, _ = S.run_sampler(qa, "diversity_kcenter", {"n": KCENTER_N})
    return out.select("dataset", "entry_id")


def b04b_kcenter_tfidf(spark, sf_dir):
    qa = qa_view(spark, sf_dir, labels=False)
    out, _ = S.run_sampler(qa, "diversity_kcenter", {"n": KCENTER_N})
    return out.select("dataset", "entry_id")


REGISTRY["b04b_kcenter_tfidf"] = (b04b_kcenter_tfidf, None)


@register("b04a_avg_pairwise_cosine", _kcenter_sql("embedding", f"""SELECT dataset, CAST({KCENTER_N} AS BIGINT) AS actual_n, round(c, 4) AS avg_pairwise_cosine, 'used provided embeddings' AS note FROM (
  SELECT a.dataset, avg(list_dot_product(a.e, b.e)) AS c FROM v a JOIN v b ON a.dataset = b.dataset AND a.entry_id < b.entry_id
  WHERE (a.dataset, a.entry_id) IN (SELECT (dataset, entry_id) FROM picks) AND (b.dataset, b.entry_id) IN (SELECT (dataset, entry_id) FROM picks) GROUP BY a.dataset)"""))
def b04a_avg_pairwise_cosine(spark, sf_dir):
    qa = qa_view(spark, sf_dir, labels=False, embeddings=True)
    _out, audit = S.run_sampler(qa, "diversity_kcenter", {"n": KCENTER_N})
    return audit.select("dataset", "actual_n", "avg_pairwise_cosine", "note")


# ---------------------------------------------------------------- sources / prep ----
from ..operators import prep as PR  # noqa: E402
from ..sources import readers as RD  # noqa: E402
from ..sources import sinks as SK  # noqa: E402
from ..session import scratch_path  # noqa: E402
from .fixtures import _read, conversation_pairs  # noqa: E402

WS_SQL_STRIP = f"regexp_replace(%s, '^{O.WS_CLASS}+|{O.WS_CLASS}+$', '', 'g')"


def _conversation_docs(spark, sf_dir) -> str:
    """Write one JSON document per conversation, one line each (three shapes); return the folder."""
    c = _read(spark, sf_dir, "conversations")
    rows = c.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    items = F.transform("turns", lambda t: F.struct(t["text"].alias("question"), t["role"].alias("Role"), t["turn"].alias("turn")))
    m3 = F.pmod(F.col("conv_id"), F.lit(3))
    doc = (
        F.when(m3 == 0, F.to_json(items))
        .when(m3 == 1, F.to_json(F.struct(items.alias("data"))))
        .otherwise(F.to_json(F.create_map(F.concat(F.lit("c"), F.pmod(F.col("conv_id"), F.lit(5)).cast("string")), items)))
    )
    path = scratch_path(spark, "convdocs")
    rows.select(doc.alias("value")).write.text(path)
    return path


@register(
    "a01_read_json",
    "SELECT CASE WHEN conv_id % 3 = 2 THEN 'c' || CAST(conv_id % 5 AS VARCHAR) ELSE 'uploaded' END AS dataset, "
    "CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS pos, coalesce(text, '') AS Question, "
    "turn, role FROM conversations",
)
def a01_read_json(spark, sf_dir):
    path = _conversation_docs(spark, sf_dir)
    df = RD.read_json(spark, path, one_per_line=True)
    return df.select("dataset", "pos", "Question", F.try_variant_get("extra", "$.turn", "bigint").alias("turn"),
                     F.try_variant_get("extra", "$.Role", "string").alias("role"))


#: Bytes of questions in a document of a03.
A03_BYTES = 4 << 20


@register(
    "a03_read_many",
    "SELECT CASE WHEN rank = 1 THEN 'g' || conv_id % 3 ELSE 'g' || conv_id % 3 || '_' || rank END AS dataset, pos, Question FROM ("
    "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id % 6 ORDER BY conv_id, turn) - 1 AS BIGINT) AS pos, coalesce(text, '') AS Question, "
    "1 + (conv_id % 6) // 3 AS rank FROM conversations)",
)
def a03_read_many(spark, sf_dir):
    """Conversations with id % 6 = i make documents of about ``A03_BYTES`` under the set name
    g<i % 3>, in order of i, conversation and turn, a file each, so names are taken again by later
    files. The names that ``read_many`` gives lead back to i and the turns before the document."""
    c = _read(spark, sf_dir, "conversations").withColumn("part", F.pmod("conv_id", F.lit(6)).cast("int")).where("part IS NOT NULL")
    order = ["part", "conv_id", "turn"]
    turns = c.select(*order, F.coalesce(c["text"], F.lit("")).alias("question"))
    total = turns.agg(F.sum(F.octet_length("question"))).first()[0] or 0
    ranges = turns.repartitionByRange(total // (16 * A03_BYTES) + 1, *order).sortWithinPartitions(*order, "question")
    placed = saved(ranges.withColumn("place", F.monotonically_increasing_id()), "six-turns").withColumn("range", F.shiftright("place", 33))
    size = F.sum(F.octet_length("question") + 20).over(Window.partitionBy("part", "range").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("piece", F.floor(size / A03_BYTES))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("place", "question"))), lambda t: F.struct(t["question"]))
    name = F.concat(F.lit("g"), (F.col("part") % 3).cast("string"))
    docs = saved(placed.groupBy("part", "range", "piece").agg(F.to_json(F.create_map(F.first(name), rows)).alias("value"), F.count("*").alias("n")), "six-documents")
    base, at, taken, before = scratch_path(spark, "six"), [], {}, {}
    docs.select("value", F.concat_ws("_", F.lit("d"), "part", "range", "piece").alias("at")).write.partitionBy("at").text(base)
    for d in docs.select("part", "range", "piece", "n").orderBy("part", "range", "piece").collect():  # a row a document
        k, i = d["part"] % 3, d["part"]
        taken[k] = taken.get(k, 0) + 1
        given = f"g{k}" if taken[k] == 1 else f"g{k}_{taken[k]}"
        at.append((f"d_{i}_{d['range']}_{d['piece']}", given, f"g{k}" if i < 3 else f"g{k}_2", before.get(i, 0)))
        before[i] = before.get(i, 0) + d["n"]
    if not at:
        return spark.createDataFrame([], "dataset string, pos long, Question string")
    files = {f.split("/at=")[1].split("/")[0]: f for f in spark.read.text(base).inputFiles()}
    df = RD.read_many(spark, [files[x[0]] for x in at])
    sets = spark.createDataFrame([x[1:] for x in at], "dataset string, six string, before long")
    return df.join(sets, "dataset").select(F.col("six").alias("dataset"), (F.col("pos") + F.col("before")).alias("pos"), "Question")


@register(
    "a02_read_jsonl",
    O.with_qa("SELECT 'uploaded' AS dataset, entry_id, Question, Context, Response, Predicted, "
              "array_to_string(RetrievedContexts, '||') AS ctx_joined, CAST(len(RetrievedContexts) AS INTEGER) AS n_ctx, GoldDocId, "
              "array_to_string(RetrievedDocIds, ',') AS doc_ids, topic FROM qa"),
)
def a02_read_jsonl(spark, sf_dir):
    qa = qa_view(spark, sf_dir, labels=False)
    raw = qa.select(
        F.col("entry_id").alias("id"), F.col("Question").alias("query"), F.col("Context").alias("passage"),
        F.col("Response").alias("ANSWER"), F.col("Predicted").alias("prediction"), F.col("RetrievedContexts").alias("contexts"),
        F.col("RetrievedDocIds").alias("retrieved_docs"), F.col("GoldDocId").alias("gold_doc_id"), "topic",
    )
    path = scratch_path(spark, "jsonl")
    raw.write.json(path)
    df = RD.read_jsonl(spark, path)
    return df.select("dataset", "entry_id", "Question", "Context", "Response", "Predicted",
                     F.array_join("RetrievedContexts", "||").alias("ctx_joined"), F.size("RetrievedContexts").alias("n_ctx"),
                     "GoldDocId", F.array_join("RetrievedDocIds", ",").alias("doc_ids"),
                     F.try_variant_get("extra", "$.topic", "string").alias("topic"))


_PAIRS_SQL = ("SELECT 'conversations' AS dataset, CAST(u.conv_id AS VARCHAR) || '-' || CAST(u.turn AS VARCHAR) AS entry_id, "
              "u.conv_id * 10000 + u.turn AS pos, u.text AS Question, a.text AS Response "
              "FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 "
              "WHERE u.role = 'user' AND a.role = 'assistant'")


@register("a04_read_table", _PAIRS_SQL)
def a04_read_table(spark, sf_dir):
    df = RD.read_table(conversation_pairs(spark, sf_dir), dataset_col="dataset", id_col="id", order_col="pos")
    return df.select("dataset", "entry_id", "pos", "Question", "Response")


@register("a05_canonical_keys", O.with_qa("SELECT dataset, entry_id, Question, Response, Predicted, Context FROM qa"))
def a05_canonical_keys(spark, sf_dir):
    qa = qa_view(spark, sf_dir, labels=False)
    odd = qa.select(
        "dataset", "entry_id", "pos", F.upper("Question").alias("query"), F.col("Question").alias("Question"),
        F.col("Response").alias("Ground-Truth"), F.col("Predicted").alias(" OUTPUT "), F.col("Context").alias("passage"),
    )
    df = RD.read_table(odd)
    return df.select("dataset", "entry_id", "Question", "Response", "Predicted", "Context")


@register(
    "a06_normalize_rows",
    O.with_qa("SELECT dataset, entry_id, Context, "
              "array_to_string(list_transform(CASE WHEN pos % 2 = 1 THEN [Question, NULL] ELSE RetrievedContexts END, lambda x: coalesce(x, '')), '||') AS ctx_joined "
              "FROM qa"),
)
def a06_normalize_rows(spark, sf_dir):
    qa = qa_view(spark, sf_dir, labels=False)
    qa = qa.withColumn("RetrievedContexts", F.when(F.col("pos") % 2 == 1, F.array(F.col("Question"), F.lit(None).cast("string")))
                       .otherwise(F.col("RetrievedContexts")))
    df = PR.normalize_rows(qa)
    return df.select("dataset", "entry_id", "Context", F.array_join("RetrievedContexts", "||").alias("ctx_joined"))


@register("a07_keep_only", O.with_qa("SELECT dataset, entry_id, pos, Question, Response FROM qa"))
def a07_keep_only(spark, sf_dir):
    return PR.keep_only(qa_view(spark, sf_dir, labels=False), ["Question", "Response", "NotThere"])


_BLANKED = ("CASE WHEN pos % 7 = 0 THEN ' ' || chr(160) || ' ' WHEN pos % 7 = 1 THEN ' ' ELSE Question END AS Question, "
            "CASE WHEN pos % 7 = 0 THEN '' ELSE Response END AS Response, CASE WHEN pos % 7 IN (0, 1) THEN NULL ELSE Predicted END AS Predicted")


@register(
    "a08_content_filter",
    O.with_qa(f"SELECT dataset, entry_id FROM (SELECT dataset, entry_id, {_BLANKED} FROM qa) "
              f"WHERE coalesce(regexp_matches(Question, '[^{O.WS_CLASS[1:]}'), false) OR coalesce(regexp_matches(Response, '[^{O.WS_CLASS[1:]}'), false) "
              f"OR coalesce(regexp_matches(Predicted, '[^{O.WS_CLASS[1:]}'), false)"),
)
def a08_content_filter(spark, sf_dir):
    qa = qa_view(spark, sf_dir, labels=False)
    m7 = F.col("pos") % 7
    qa = qa.select(
        "dataset", "entry_id", "pos",
        F.when(m7 == 0, F.lit("   ")).when(m7 == 1, F.lit(" ")).otherwise(F.col("Question")).alias("Question"),
        F.when(m7 == 0, F.lit("")).otherwise(F.col("Response")).alias("Response"),
        F.when(m7.isin(0, 1), F.lit(None).cast("string")).otherwise(F.col("Predicted")).alias("Predicted"),
    )
    return PR.content_filter(qa).select("dataset", "entry_id")


@register(
    "a09_dedupe",
    O.with_qa("SELECT dataset, entry_id FROM (SELECT dataset, entry_id, row_number() OVER (PARTITION BY dataset, "
              f"lower({WS_SQL_STRIP % 'coalesce(Question, \'\')'}), lower(coalesce(Context, '')) ORDER BY pos, entry_id) AS rn FROM qa) WHERE rn = 1"),
)
def a09_dedupe(spark, sf_dir):
    return PR.dedupe(qa_view(spark, sf_dir, labels=False)).select("dataset", "entry_id")


@register(
    "a09b_dedupe_late_difference",
    O.with_qa("SELECT dataset, entry_id FROM (SELECT dataset, entry_id, row_number() OVER (PARTITION BY dataset, lower(Context) ORDER BY pos, entry_id) AS rn FROM qa) WHERE rn = 1"),
)
def a09b_dedupe_late_difference(spark, sf_dir):
    qa = qa_view(spark, sf_dir, labels=False)
    return PR.dedupe(qa.withColumn("Question", F.lit("same")).withColumn("Context", F.concat(F.repeat(F.lit("x"), 256), "Context"))).select("dataset", "entry_id")


@register(
    "a10_cap",
    O.with_qa("SELECT dataset, entry_id FROM (SELECT dataset, entry_id, row_number() OVER (PARTITION BY dataset ORDER BY pos, entry_id) AS rn FROM qa) WHERE rn <= 50"),
)
def a10_cap(spark, sf_dir):
    return PR.cap_per_dataset(qa_view(spark, sf_dir, labels=False), 50).select("dataset", "entry_id")


@register(
    "a11_nested_field",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, coalesce(json_extract_string(props, '$.missing.x'), 'none') AS missing FROM events",
)
def a11_nested_field(spark, sf_dir):
    ev = _read(spark, sf_dir, "events")
    return ev.select("event_id", PR.get_path("props", "k", "double").alias("k"),
                     PR.get_path("props", "missing.x", "string", "none").alias("missing"))


@register(
    "a12_preview",
    O.with_qa("SELECT dataset, entry_id, CAST(No AS INTEGER) AS No, Question, Response, Predicted FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY pos, entry_id) AS No FROM qa) WHERE No <= 25"),
)
def a12_preview(spark, sf_dir):
    p = PR.preview(qa_view(spark, sf_dir, labels=False))
    return p.select("dataset", "entry_id", "No", "Question", "Response", "Predicted")


@register(
    "a13_jsonl_sink",
    O.with_qa(
        "SELECT dataset, count(*) AS n, sum(length(Question)) AS q_chars FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY "
        f"{O.u(42, 'pick', O.ID)}, entry_id) AS rn FROM qa) WHERE rn <= {SAMPLE_N} GROUP BY dataset"
    ),
)
def a13_jsonl_sink(spark, sf_dir):
    qa = qa_view(spark, sf_dir, labels=False)
    out, _ = S.run_sampler(qa, "uniform_random", {"n": SAMPLE_N})
    path = SK.write_jsonl(out, scratch_path(spark, "sampled"))
    back = spark.read.json(path)
    return back.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("Question")).alias("q_chars"))


@register(
    "a14_csv_sink",
    O.with_qa(
        "SELECT dataset, metric, round(avg(value), 6) AS mean, count(value) AS n FROM lm GROUP BY dataset, metric",
        O.PREP_CTE, _summary_source_sql(),
    ),
)
def a14_csv_sink(spark, sf_dir):
    summ = e01_summary(spark, sf_dir)
    path = SK.write_csv(summ, scratch_path(spark, "summary_csv"))
    back = spark.read.option("header", True).csv(path)
    return back.select("dataset", "metric", F.round(F.col("mean").cast("double"), 6).alias("mean"), F.col("n").cast("bigint").alias("n"))


# ---------------------------------------------------------------- retrieval --------
from ..operators import retrieval as RT  # noqa: E402
from ..functions.vectors import default_embedder  # noqa: E402

NL2 = "chr(10) || chr(10)"
PROMPT_SQL = "'User Question: ' || coalesce(Question, '') || " + NL2 + " || 'Relevant Excerpt(s):' || " + NL2 + " || "


@register("c01_chunk", O.with_qa("SELECT dataset, entry_id, chunk_id, text FROM ch", O.chunks_cte(100)))
def c01_chunk(spark, sf_dir):
    return RT.chunk(qa_view(spark, sf_dir, labels=False), "Context", 100)


@register(
    "c02_embed",
    O.with_qa(f"SELECT dataset, entry_id, array_to_string(list_transform({O.hashed_vec('Question')}, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS vec FROM qa"),
)
def c02_embed(spark, sf_dir):
    qa = qa_view(spark, sf_dir, labels=False)
    v = default_embedder()(F.col("Question"))
    return qa.select("dataset", "entry_id", F.array_join(F.transform(v, lambda x: x.cast("bigint").cast("string")), ",").alias("vec"))


def c03_kmeans(spark, sf_dir):
    qa = qa_view(spark, sf_dir, labels=False)
    ch = RT.embed(RT.chunk(qa, "Context", 100), "text")
    return RT.kmeans_per_entry(ch, 5)


REGISTRY["c03_kmeans"] = (c03_kmeans, None)


def _labelled_vectors(spark, sf_dir):
    """The embeddings as chunks of few, large entries: one a label."""
    e = _read(spark, sf_dir, "embeddings")
    return e.select(F.lit("embeddings").alias("dataset"), F.col("label").cast("string").alias("entry_id"), F.col("vec_id").cast("int").alias("chunk_id"),
                    F.col("embedding").cast("array<double>").alias("vec"))


@register(
    "c03b_kmeans_round",
    "WITH v AS (SELECT CAST(label AS VARCHAR) AS entry_id, vec_id, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS o FROM embeddings), "
    "ds AS (SELECT a.entry_id, a.vec_id, a.v, c.o AS center, list_sum(list_transform(list_zip(a.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d "
    "FROM v a JOIN v c ON a.entry_id = c.entry_id AND c.o < 3), "
    "lb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_id, vec_id ORDER BY d, center) AS k FROM ds) WHERE k = 1) "
    "SELECT entry_id, CAST(center AS INTEGER) AS cluster_id, count(*) AS n, CAST(min(vec_id) AS INTEGER) AS first, round(sum(list_sum(v)), 6) AS total FROM lb GROUP BY entry_id, center",
)
def c03b_kmeans_round(spark, sf_dir):
    """One of Lloyd's rounds over all tasks, from the first three vectors of each label as centers."""
    ch = _labelled_vectors(spark, sf_dir)
    first = Window.partitionBy("entry_id").orderBy("chunk_id")
    starts = ch.withColumn("o", F.row_number().over(first)).where("o <= 3").orderBy("o").collect()  # three rows a label
    centers = {}
    for r in starts:
        centers.setdefault((r["dataset"], r["entry_id"]), []).append(r["vec"])
    found = RT.lloyd_round(ch, {k: np.array(v) for k, v in centers.items()}).where("n > 0")
    return found.select("entry_id", "cluster_id", "n", "first", F.round(F.aggregate("total", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def c03c_kmeans_spread(spark, sf_dir):
    """Every label's vectors clustered over all tasks."""
    return RT.kmeans_per_entry(_labelled_vectors(spark, sf_dir), 5, entry_chunks=16)


REGISTRY["c03c_kmeans_spread"] = (c03c_kmeans_spread, None)

_SUMM_CTES = (
    O.chunks_cte(100),
    "sm AS (SELECT dataset, entry_id, CAST(chunk_id % 3 AS INTEGER) AS cluster_id, string_agg(text, ' ' ORDER BY chunk_id) AS summary FROM ch GROUP BY ALL)",
)


def _mod3_summaries(spark, sf_dir):
    qa = qa_view(spark, sf_dir, labels=False)
    ch = RT.chunk(qa, "Context", 100)
    labels = ch.select("dataset", "entry_id", "chunk_id", (F.col("chunk_id") % 3).alias("cluster_id"))
    return qa, RT.cluster_summaries(ch, labels)


@register("c04_cluster_summaries", O.with_qa("SELECT dataset, entry_id, cluster_id, summary FROM sm", *_SUMM_CTES))
def c04_cluster_summaries(spark, sf_dir):
    return _mod3_summaries(spark, sf_dir)[1]


_C06_SQL_CTES = (
    *_SUMM_CTES,
    f"qv AS (SELECT dataset, entry_id, {O.hashed_vec('Question')} AS qv FROM qa)",
    f"sv AS (SELECT *, {O.hashed_vec('summary')} AS v FROM sm)",
    f"sc AS (SELECT dataset, entry_id, cluster_id, summary, round({O.cos('qv', 'v')}, 12) AS sim FROM sv JOIN qv USING (dataset, entry_id))",
    "rk AS (SELECT *, row_number() OVER (PARTITION BY dataset, entry_id ORDER BY sim DESC, cluster_id) AS rank FROM sc)",
)


@register(
    "c06_summary_retrieval",
    O.with_qa("SELECT dataset, entry_id, CAST(rank AS INTEGER) AS rank, cluster_id, round(sim, 6) AS sim FROM rk WHERE rank <= 3", *_C06_SQL_CTES),
)
def c06_summary_retrieval(spark, sf_dir):
    qa, summ = _mod3_summaries(spark, sf_dir)
    summ = RT.embed(summ, "summary", "vec")
    q = RT.embed(qa.select("dataset", "entry_id", "Question"), "Question", "qvec").select("dataset", "entry_id", "qvec")
    top = RT.top_k_by_similarity(summ.join(q, ["dataset", "entry_id"]), F.col("qvec"), F.col("vec"), 3, tie=("cluster_id",))
    return top.select("dataset", "entry_id", "rank", "cluster_id", r6(F.col("sim")).alias("sim"))


@register(
    "c13_prompt_assembly",
    O.with_qa(f"SELECT dataset, entry_id, {PROMPT_SQL} coalesce(e.ex, '') AS prompt FROM qa LEFT JOIN "
              f"(SELECT dataset, entry_id, string_agg(summary, {NL2} ORDER BY rank) AS ex FROM rk WHERE rank <= 3 GROUP BY ALL) e USING (dataset, entry_id)",
              *_C06_SQL_CTES),
)
def c13_prompt_assembly(spark, sf_dir):
    qa, summ = _mod3_summaries(spark, sf_dir)
    summ = RT.embed(summ, "summary", "vec")
    q = RT.embed(qa.select("dataset", "entry_id", "Question"), "Question", "qvec").select("dataset", "entry_id", "qvec")
    top = RT.top_k_by_similarity(summ.join(q, ["dataset", "entry_id"]), F.col("qvec"), F.col("vec"), 3, tie=("cluster_id",))
    return RT.excerpts_prompt(qa, top, "summary").select("dataset", "entry_id", "prompt")


_GRAPH_CTES = (
    O.chunks_cte(400, "cg"),
    f"cv AS (SELECT dataset, entry_id, chunk_id, {O.hashed_vec('text')} AS v FROM cg)",
    f"pr AS (SELECT a.dataset, a.entry_id, a.chunk_id AS src, b.chunk_id AS dst, {O.cos('a.v', 'b.v')} AS w FROM cv a JOIN cv b ON a.dataset = b.dataset AND a.entry_id = b.entry_id AND a.chunk_id < b.chunk_id)",
)


@register(
    "c07_similarity_graph",
    O.with_qa("SELECT dataset, entry_id, src, dst, round(w, 6) AS weight FROM pr WHERE w > 0.5 UNION ALL "
              "SELECT dataset, entry_id, dst AS src, src AS dst, round(w, 6) AS weight FROM pr WHERE w > 0.5", *_GRAPH_CTES),
)
def c07_similarity_graph(spark, sf_dir):
    qa = qa_view(spark, sf_dir, labels=False)
    ch = RT.embed(RT.chunk(qa, "Context", 400), "text")
    g = RT.similarity_graph(ch, 0.5)
    return g.select("dataset", "entry_id", "src", "dst", r6(F.col("weight")).alias("weight"))


@register(
    "c07b_strongest_neighbours",
    O.with_qa("SELECT dataset, entry_id, CAST(src AS INTEGER) AS chunk_id, CAST(dst AS INTEGER) AS neighbour FROM (SELECT *, row_number() OVER (PARTITION BY dataset, entry_id, src ORDER BY w DESC, dst) AS o FROM ("
              "SELECT dataset, entry_id, src, dst, round(w, 12) AS w FROM pr WHERE w > 0.5 UNION ALL SELECT dataset, entry_id, dst AS src, src AS dst, round(w, 12) AS w FROM pr WHERE w > 0.5)) WHERE o = 1", *_GRAPH_CTES),
)
def c07b_strongest_neighbours(spark, sf_dir):
    """In blocks of 64 chunks, so that longer entries are compared block by block."""
    qa = qa_view(spark, sf_dir, labels=False)
    return RT.strongest_neighbours(RT.embed(RT.chunk(qa, "Context", 400), "text"), 0.5, block=64).select("dataset", "entry_id", "chunk_id", "neighbour")


_RANK_CTES = (
    O.chunks_cte(100),
    f"cv AS (SELECT ch.*, {O.hashed_vec('ch.text')} AS v FROM ch)",
    f"qv AS (SELECT dataset, entry_id, {O.hashed_vec('Question')} AS qv FROM qa)",
    f"sc AS (SELECT cv.*, {O.cos('qv.qv', 'cv.v')} AS sim FROM cv JOIN qv USING (dataset, entry_id))",
    "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, entry_id ORDER BY sim DESC, chunk_id) AS rank FROM sc) WHERE rank <= 3)",
    f"nb AS (SELECT t.dataset, t.entry_id, t.rank, c.chunk_id AS nb, c.text AS nt, {O.cos('t.v', 'c.v')} AS w FROM top t JOIN cv c ON c.dataset = t.dataset AND c.entry_id = t.entry_id AND c.chunk_id <> t.chunk_id)",
    "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, entry_id, rank ORDER BY w DESC, nb) AS o FROM nb WHERE w > 0.5) WHERE o = 1)",
    "ref AS (SELECT top.dataset, top.entry_id, top.rank, top.chunk_id, coalesce(best.nb, top.chunk_id) AS refined_id, coalesce(best.nt, top.text) AS refined_text FROM top LEFT JOIN best USING (dataset, entry_id, rank))",
    f"ex AS (SELECT dataset, entry_id, string_agg(refined_text, {NL2} ORDER BY rank) AS ex, first(refined_text ORDER BY rank) AS lead FROM ref GROUP BY ALL)",
)


def _graph_top(spark, sf_dir, twice=False):
    """``twice``: the caller reads the chunks again."""
    qa = qa_view(spark, sf_dir, labels=False)
    ch = RT.embed(RT.chunk(qa, "Context", 100), "text")
    ch = saved(ch, "chunk-vectors") if twice else ch.repartition("dataset", "entry_id")
    q = RT.embed(qa.select("dataset", "entry_id", "Question"), "Question", "qvec").select("dataset", "entry_id", "qvec")
    top = RT.top_k_by_similarity(ch.join(q, ["dataset", "entry_id"]), F.col("qvec"), F.col("vec"), 3)
    return qa, ch, top


@register("c08_node_ranking", O.with_qa("SELECT dataset, entry_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(sim, 6) AS sim FROM top", *_RANK_CTES))
def c08_node_ranking(spark, sf_dir):
    _qa, _ch, top = _graph_top(spark, sf_dir)
    return top.select("dataset", "entry_id", "rank", "chunk_id", r6(F.col("sim")).alias("sim"))


@register("c09_neighbour_refinement", O.with_qa("SELECT dataset, entry_id, CAST(rank AS INTEGER) AS rank, chunk_id, refined_id FROM ref", *_RANK_CTES))
def c09_neighbour_refinement(spark, sf_dir):
    _qa, ch, top = _graph_top(spark, sf_dir, twice=True)
    return RT.refine_with_neighbours(top, ch, 0.5).select("dataset", "entry_id", "rank", "chunk_id", "refined_id")


def _graph_prompt_sql(ids: str = "lang") -> str:
    return O.with_qa(f"SELECT dataset, entry_id, {PROMPT_SQL} coalesce(ex.ex, '') AS prompt FROM qa LEFT JOIN ex USING (dataset, entry_id)", *_RANK_CTES, ids=ids)


def _graph_prompts(qa: DataFrame) -> DataFrame:
    out = RT.run_retrieval(qa, "graphrag")
    return out.select("dataset", "entry_id", F.coalesce("prompt", RT.rag_prompt(F.col("Question"), F.lit(""))).alias("prompt"))


@register("c12_graphrag_prompt", _graph_prompt_sql())
def c12_graphrag_prompt(spark, sf_dir):
    """The technique's own map-only path."""
    return _graph_prompts(qa_view(spark, sf_dir, labels=False))


@register("c12c_graphrag_shared_ids", _graph_prompt_sql("shared"))
def c12c_graphrag_shared_ids(spark, sf_dir):
    return _graph_prompts(qa_view(spark, sf_dir, labels=False, shared_ids=True))


@register("c12d_graphrag_operators", _graph_prompt_sql())
def c12d_graphrag_operators(spark, sf_dir):
    """Composed of the operators, as with an embedder that only maps columns."""
    qa, ch, top = _graph_top(spark, sf_dir, twice=True)
    ref = RT.refine_with_neighbours(top, ch, 0.5)
    return RT.excerpts_prompt(qa, ref.select("dataset", "entry_id", "rank", F.col("refined_text").alias("text")), "text").select("dataset", "entry_id", "prompt")


@register("c10_rag_prompt", O.with_qa(f"SELECT dataset, entry_id, {PROMPT_SQL} coalesce(Context, '') AS prompt FROM qa"))
def c10_rag_prompt(spark, sf_dir):
    qa = qa_view(spark, sf_dir, labels=False)
    return qa.select("dataset", "entry_id", RT.rag_prompt(F.col("Question"), F.col("Context")).alias("prompt"))


def c11_raptor(spark, sf_dir):
    qa = qa_view(spark, sf_dir, labels=False)
    return RT.run_retrieval(qa, "raptor").select("dataset", "entry_id", "Predicted", "GenerationError")


REGISTRY["c11_raptor"] = (c11_raptor, None)


def _answer_sql(body: str) -> str:
    """The default generator: the first excerpt up to its first '. ' or line end, stripped."""
    first = f"split_part({body}, {NL2}, 1)"
    cut = f"list_min(list_filter([strpos({first}, '. '), strpos({first}, chr(10))], lambda x: x > 0))"
    return f"regexp_replace(CASE WHEN {cut} IS NULL THEN {first} ELSE substr({first}, 1, {cut}) END, '^{O.WS_CLASS}+|{O.WS_CLASS}+$', '', 'g')"


@register("c12b_graphrag_run", O.with_qa(f"SELECT dataset, entry_id, CASE WHEN coalesce(Context, '') = '' THEN '' ELSE {_answer_sql('coalesce(ex, chr(32))')} END AS Predicted, "
                                         "CAST(NULL AS VARCHAR) AS GenerationError FROM qa LEFT JOIN ex USING (dataset, entry_id)", *_RANK_CTES))
def c12b_graphrag_run(spark, sf_dir):
    qa = qa_view(spark, sf_dir, labels=False)
    return RT.run_retrieval(qa, "graphrag").select("dataset", "entry_id", "Predicted", "GenerationError")


@register("c14_generate", O.with_qa(f"SELECT dataset, entry_id, {_answer_sql(chr(39) + chr(39) + ' || coalesce(Context, ' + chr(39) + chr(39) + ')')} AS Predicted, CAST(NULL AS VARCHAR) AS GenerationError FROM qa"))
def c14_generate(spark, sf_dir):
    qa = qa_view(spark, sf_dir, labels=False)
    return RT.run_retrieval(qa, "rag").select("dataset", "entry_id", "Predicted", "GenerationError")


def _failing_generator():
    def gen(prompts):
        if any(len(p) % 7 == 0 for p in prompts):
            raise RuntimeError("refused")
        return [str(len(p)) for p in prompts]

    return gen


_PROMPT_LEN = f"length({PROMPT_SQL} coalesce(Context, ''))"


@register("c14b_generate_errors", O.with_qa(f"SELECT dataset, entry_id, CASE WHEN {_PROMPT_LEN} % 7 <> 0 THEN CAST({_PROMPT_LEN} AS VARCHAR) END AS Predicted, "
                                            f"CASE WHEN {_PROMPT_LEN} % 7 = 0 THEN 'RuntimeError(''refused'')' END AS GenerationError FROM qa"))
def c14b_generate_errors(spark, sf_dir):
    out = RT.run_retrieval(qa_view(spark, sf_dir, labels=False), "rag", generator=_failing_generator)
    return out.select("dataset", "entry_id", "Predicted", "GenerationError")


@register(
    "c16_missing_predictions",
    O.with_qa("SELECT dataset, count_if(Predicted IS NULL) AS missing_predicted, count(*) AS n FROM "
              f"(SELECT dataset, {_BLANKED} FROM qa) GROUP BY dataset"),
)
def c16_missing_predictions(spark, sf_dir):
    qa = qa_view(spark, sf_dir, labels=False)
    qa = qa.withColumn("Predicted", F.when((F.col("pos") % 7).isin(0, 1), F.lit(None).cast("string")).otherwise(F.col("Predicted")))
    return RT.missing_predictions(qa)


# ---------------------------------------------------------------- more metrics -----

def _metric_sql(keys_exprs: dict[str, str], extra_ctes=()) -> str:
    sel = ", ".join(f"round({e}, 6) AS \"{safe_name(k)}\"" for k, e in keys_exprs.items())
    return O.with_qa(f"SELECT dataset, entry_id, {sel} FROM prep2", O.PREP_CTE, *extra_ctes)


def _metric_spark(metrics, keys, **kw):
    def fn(spark, sf_dir):
        qa = qa_view(spark, sf_dir, labels=False)
        scored, _ = score_columns(qa, metrics, **kw)
        return scored.select("dataset", "entry_id", *[r6(F.col(f"`{k}`")).alias(safe_name(k)) for k in keys])

    return fn


_FOLD = "translate(%s, 'éóèñçêüäößí', 'ABCDEFGHIJK')"  # code points -> single bytes (fixture alphabet)
_LEV = (f"CASE WHEN pn = '' AND gn = '' THEN 1.0 ELSE 1.0 - levenshtein({_FOLD % 'pn'}, {_FOLD % 'gn'}) / "
        "greatest(1, greatest(length(pn), length(gn)))::DOUBLE END")
REGISTRY["d07_levenshtein"] = (
    _metric_spark(["levenshtein"], ["levenshtein"]),
    _metric_sql({"levenshtein": _LEV}, ("prep2 AS (SELECT * FROM prep)",)),
)


_PRECS = [f"(CASE WHEN P - {n} + 1 > 0 THEN coalesce(m{n}, 0) / (P - {n} + 1)::DOUBLE ELSE 0.0 END)" for n in (1, 2, 3, 4)]
_BLEU = (
    "CASE WHEN P = 0 AND G = 0 THEN 1.0 WHEN P = 0 OR G = 0 THEN 0.0 WHEN " + " OR ".join(f"{p} = 0" for p in _PRECS)
    + " THEN 0.0 ELSE (CASE WHEN P > G THEN 1.0 ELSE exp(1.0 - G / P::DOUBLE) END) * exp((" + " + ".join(f"ln({p})" for p in _PRECS) + ") / 4.0) END"
)
REGISTRY["d11_bleu"] = (
    _metric_spark(["bleu"], ["bleu"]),
    _metric_sql({"bleu": _BLEU}, (O.grams_cte("pt", "gt", (1, 2, 3, 4)), "prep2 AS (SELECT * FROM prep LEFT JOIN gm USING (dataset, entry_id))")),
)


def _rouge_n_sql(n: int) -> str:
    pr, rc = f"(coalesce(m{n}, 0) / greatest(coalesce(p{n}, 0), 1))", f"(coalesce(m{n}, 0) / greatest(coalesce(g{n}, 0), 1))"
    return f"CASE WHEN P = 0 OR G = 0 THEN 0.0 WHEN {pr} + {rc} > 0 THEN 2 * {pr} * {rc} / ({pr} + {rc}) ELSE 0.0 END"


REGISTRY["d12_rouge_n"] = (
    _metric_spark(["rouge1", "rouge2"], ["rouge1", "rouge2"]),
    _metric_sql({"rouge1": _rouge_n_sql(1), "rouge2": _rouge_n_sql(2)},
                (f"prep1 AS (SELECT dataset, entry_id, {O.rouge_tokens('pred')} AS rp, {O.rouge_tokens('ref')} AS rg FROM prep0)",
                 O.grams_cte("rp", "rg", (1, 2), "prep1"), "prep2 AS (SELECT * FROM prep LEFT JOIN gm USING (dataset, entry_id))")),
)
# The same metrics as aggregates over (entry, token).
REGISTRY["d11b_bleu_by_token"] = (_metric_spark(["bleu"], ["bleu"], engine="tokens"), REGISTRY["d11_bleu"][1])
REGISTRY["d12b_rouge_n_by_token"] = (_metric_spark(["rouge1", "rouge2"], ["rouge1", "rouge2"], engine="tokens"), REGISTRY["d12_rouge_n"][1])
REGISTRY["d15_nli_default"] = (
    _metric_spark(["nli_entail", "nli_neutral", "nli_contra"], ["nli_entail", "nli_neutral", "nli_contra"]),
    _metric_sql({"nli_entail": "0.0", "nli_neutral": "0.0", "nli_contra": "0.0"}, ("prep2 AS (SELECT * FROM prep)",)),
)
REGISTRY["d16_cosine_default"] = (
    _metric_spark(["cosine"], ["cosine"]),
    _metric_sql({"cosine": f"CASE WHEN pn <> '' OR gn <> '' THEN {O.cos(O.hashed_vec('ref'), O.hashed_vec('pred'))} ELSE 0.0 END"},
                ("prep2 AS (SELECT * FROM prep)",)),
)
for _name, _m, _k in (("d05_rouge_l", "rougeL", "ROUGE-L"), ("d08_seqmatch", "seqmatch", "seqmatch"), ("d13_rouge_lsum", "rougeLsum", "rougeLsum")):
    REGISTRY[_name] = (_metric_spark([_m], [_k]), None)


def _meteor_sql() -> str:
    """The k-th occurrence of a word from the end of the prediction meets the k-th from the end of the
    gold; breaks between met pairs that are neighbours on both sides make chunks."""
    side = lambda name, words, at: (f"{name} AS (SELECT *, row_number() OVER (PARTITION BY dataset, entry_id, t ORDER BY {at} DESC) AS k FROM "  # noqa: E731
                                    f"(SELECT dataset, entry_id, unnest({words}) AS t, unnest(range(len({words}))) AS {at} FROM prep))")
    ctes = (
        side("hy", "pt", "i"), side("rf", "gt", "j"),
        "met AS (SELECT dataset, entry_id, i, j, lag(i) OVER w AS pi, lag(j) OVER w AS pj FROM hy JOIN rf USING (dataset, entry_id, t, k) WINDOW w AS (PARTITION BY dataset, entry_id ORDER BY i))",
        "mt AS (SELECT dataset, entry_id, count(*)::DOUBLE AS m, sum(CASE WHEN i = pi + 1 AND j = pj + 1 THEN 0 ELSE 1 END)::DOUBLE AS chunks FROM met GROUP BY dataset, entry_id)",
        "prep2 AS (SELECT * FROM prep LEFT JOIN mt USING (dataset, entry_id))",
    )
    mean = "((m / P) * (m / G) / (0.9 * (m / P) + 0.1 * (m / G)))"
    value = f"CASE WHEN P = 0 AND G = 0 THEN 1.0 WHEN P = 0 OR G = 0 OR m IS NULL THEN 0.0 ELSE {mean} * (1 - 0.5 * power(chunks / m, 3)) END"
    return _metric_sql({"meteor": value}, ctes)


REGISTRY["d14_meteor"] = (_metric_spark(["meteor"], ["meteor"]), _meteor_sql())


def _turns(spark, sf_dir) -> DataFrame:
    """Neighbouring turns of conversations: the answer's text against the question's."""
    return conversation_pairs(spark, sf_dir).select("dataset", F.col("id").alias("entry_id"), F.col("query").alias("Predicted"), F.col("answer").alias("Response"))


@register(
    "d05b_rouge_l_turns",
    "WITH tk AS (SELECT CAST(u.conv_id AS VARCHAR) || '-' || CAST(u.turn AS VARCHAR) AS entry_id, "
    f"{O.norm_tokens('u.text')} AS p, {O.norm_tokens('a.text')} AS g FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 "
    "WHERE u.role = 'user' AND a.role = 'assistant'), "
    # a row of the table a predicted token: the running maximum of what ends at each gold token
    "lcs AS (SELECT entry_id, len(p) AS P, len(g) AS G, list_reduce(list_concat([list_transform(range(len(g) + 1), lambda x: 0)], "
    "list_transform(p, lambda t: list_concat([0], list_transform(g, lambda y: CASE WHEN y = t THEN 1 ELSE 0 END)))), "
    "lambda r, e: list_transform(range(1, len(r) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN k = 1 THEN 0 ELSE greatest(r[k], r[k - 1] + e[k]) END)))) AS r FROM tk) "
    "SELECT entry_id, round(CASE WHEN P = 0 OR G = 0 THEN 0.0 ELSE 2.44 * r[len(r)] / (P + 1.44 * G) END, 6) AS rouge_l FROM lcs",
)
def d05b_rouge_l_turns(spark, sf_dir):
    scored, _ = score_columns(_turns(spark, sf_dir), ["rougeL"])
    return scored.select("entry_id", r6(F.col("`ROUGE-L`")).alias("rouge_l"))


@register(
    "d28_merge_metrics",
    O.with_qa(f"SELECT dataset, entry_id, CAST(2 AS INTEGER) AS n_keys, round({O.metric_exprs()['EM']}, 6) AS EM, "
              f"round({O.metric_exprs()['F1']}, 6) AS F1 FROM prep", O.PREP_CTE),
)
def d28_merge_metrics(spark, sf_dir):
    from ..operators.scoring import score

    qa = qa_view(spark, sf_dir, labels=False)
    once = score(qa, ["em"])
    twice = score(once, ["F1"])
    return twice.select("dataset", "entry_id", F.size("metrics").alias("n_keys"), r6(F.col("metrics")["EM"]).alias("EM"),
                        r6(F.col("metrics")["F1"]).alias("F1"))


@register("d27b_score_all_map", O.with_qa(
    f"SELECT dataset, entry_id, CAST(31 + CASE WHEN {O.metric_exprs()['first_support_rank']} IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_metrics FROM prep", O.PREP_CTE))
def d27b_score_all_map(spark, sf_dir):
    from ..operators.scoring import score

    qa = qa_view(spark, sf_dir, labels=False)
    return score(qa).select("dataset", "entry_id", F.size("metrics").alias("n_metrics"))




# ---------------------------------------------------------------- pipeline / trials ---
from . import pipeline as PL  # noqa: E402

_TRIALS = 3


def _trial_sql_ctes():
    ex = O.metric_exprs()
    pick = " UNION ALL ".join(
        f"SELECT {t} AS trial, dataset, entry_id FROM (SELECT dataset, entry_id, row_number() OVER (PARTITION BY dataset ORDER BY "
        f"{O.u(42 + t, 'pick', O.ID)}, entry_id) AS rn FROM qa) WHERE rn <= {SAMPLE_N}"
        for t in range(_TRIALS)
    )
    return (
        O.PREP_CTE,
        f"dr AS ({pick})",
        f"sc AS (SELECT dataset, entry_id, {ex['EM']} AS \"EM\", {ex['F1']} AS \"F1\" FROM prep)",
        "lm AS (UNPIVOT (SELECT dr.trial, dr.dataset, sc.\"EM\", sc.\"F1\" FROM dr JOIN sc USING (dataset, entry_id)) ON \"EM\", \"F1\" INTO NAME metric VALUE value)",
        "ts AS (SELECT trial, dataset, metric, avg(value) AS mean, count(value) AS n FROM lm GROUP BY ALL)",
        "st AS (SELECT dataset, metric, avg(mean) AS m, stddev_pop(mean) AS s, count(mean) AS trials FROM ts GROUP BY ALL)",
        "disp AS (SELECT *, CASE WHEN round(s, 3) = 0 THEN printf('%.3f', m) ELSE printf('%.3f ± %.3f', m, s) END AS display FROM st)",
    )


def _trials(spark, sf_dir, **view):
    qa = qa_view(spark, sf_dir, labels=False, **view)
    return PL.run_trials(qa, "uniform_random", {"n": SAMPLE_N}, trials=_TRIALS, metrics=["em", "f1"])


@register("e03_trials", O.with_qa("SELECT CAST(trial AS INTEGER) AS trial, dataset, metric, round(mean, 6) AS mean, n FROM ts", *_trial_sql_ctes()))
def e03_trials(spark, sf_dir):
    summ, _ = _trials(spark, sf_dir)
    return summ.select("trial", "dataset", "metric", r6(F.col("mean")).alias("mean"), "n")


@register("e03b_trials_shared_ids", O.with_qa("SELECT CAST(trial AS INTEGER) AS trial, dataset, metric, round(mean, 6) AS mean, n FROM ts", *_trial_sql_ctes(), ids="shared"))
def e03b_trials_shared_ids(spark, sf_dir):
    summ, _ = _trials(spark, sf_dir, shared_ids=True)
    return summ.select("trial", "dataset", "metric", r6(F.col("mean")).alias("mean"), "n")


@register("e03d_trials_repeated_ids", O.repeated(O.with_qa(
    "SELECT CAST(trial AS INTEGER) AS trial, dataset, metric, round(mean, 6) AS mean, n FROM ts", *_trial_sql_ctes(), ids="repeated"), "trial", "dataset", "metric", "mean", "n"))
def e03d_trials_repeated_ids(spark, sf_dir):
    summ, _ = _trials(spark, sf_dir, repeated_ids=True)
    return summ.select("trial", "dataset", "metric", r6(F.col("mean")).alias("mean"), "n")


@register("e04_trial_stats", O.with_qa("SELECT dataset, metric, round(m, 6) AS trial_mean, round(s, 6) AS trial_std, trials, display FROM disp", *_trial_sql_ctes()))
def e04_trial_stats(spark, sf_dir):
    _, st = _trials(spark, sf_dir)
    return st.select("dataset", "metric", r6(F.col("trial_mean")).alias("trial_mean"), r6(F.col("trial_std")).alias("trial_std"),
                     "trials", "display")


@register(
    "e05_pivot",
    O.with_qa("PIVOT (SELECT dataset, metric, display FROM disp) ON dataset USING coalesce(max(display), '—') GROUP BY metric", *_trial_sql_ctes()),
)
def e05_pivot(spark, sf_dir):
    from ..operators.report import pivot_table

    _, st = _trials(spark, sf_dir)
    return pivot_table(st, "display")


_PIPE_CFG = {"mode": "dataset", "subsampling": {"method": "uniform_random", "n": SAMPLE_N},
             "evals": {"metrics": ["em", "f1", "mrr"], "k_values": [1, 3]}}


@register(
    "e06_pipeline",
    O.with_qa(
        "SELECT dataset, metric, round(avg(value), 6) AS mean, count(value) AS n FROM lm GROUP BY dataset, metric",
        O.PREP_CTE,
        "dd AS (SELECT dataset, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY lower(regexp_replace(coalesce(Question, ''), "
        f"'^{O.WS_CLASS}+|{O.WS_CLASS}+$', '', 'g')), pos, entry_id) AS x, "
        f"row_number() OVER (PARTITION BY dataset, lower(regexp_replace(coalesce(Question, ''), '^{O.WS_CLASS}+|{O.WS_CLASS}+$', '', 'g')), "
        "lower(coalesce(Context, '')) ORDER BY pos, entry_id) AS rn FROM qa) WHERE rn = 1)",
        f"sp AS (SELECT dataset, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {O.u(42, 'pick', O.ID)}, entry_id) AS r FROM dd) WHERE r <= {SAMPLE_N})",
        f"sc AS (SELECT prep.dataset, entry_id, {O.metric_exprs((1, 3))['EM']} AS \"EM\", {O.metric_exprs((1, 3))['F1']} AS \"F1\", "
        f"{O.metric_exprs((1, 3))['MRR']} AS \"MRR\" FROM prep JOIN sp USING (dataset, entry_id))",
        "lm AS (UNPIVOT sc ON \"EM\", \"F1\", \"MRR\" INTO NAME metric VALUE value)",
    ),
)
def e06_pipeline(spark, sf_dir):
    qa = qa_view(spark, sf_dir, labels=False)
    out = PL.run_pipeline(qa, _PIPE_CFG)
    return out["metrics_summary"].select("dataset", "metric", r6(F.col("mean")).alias("mean"), "n")


_RAG_CFG = {"mode": "api", "dedupe": False, "retrieval": {"technique": "rag"}}
_RAG_EM = "CASE WHEN " + O.normalize(f"({_answer_sql(chr(39) + chr(39) + ' || coalesce(Context, ' + chr(39) + chr(39) + ')')})") + " = " + O.normalize("Response") + " THEN 1.0 ELSE 0.0 END"


def _rag_draw(seed: int) -> str:
    return (f"(SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {O.u(seed, 'pick', O.ID)}, entry_id) AS rn FROM qa)")


@register("e06b_pipeline_api", O.with_qa(f"SELECT dataset, 'EM' AS metric, round(avg({_RAG_EM}), 6) AS mean, count(*) AS n, count(*) AS n_predictions FROM {_rag_draw(42)} WHERE rn <= {SAMPLE_N} GROUP BY dataset"))
def e06b_pipeline_api(spark, sf_dir):
    """The api mode with all artifacts written; the counts come from the written predictions."""
    folder = scratch_path(spark, "artifacts")
    cfg = _RAG_CFG | {"subsampling": {"method": "uniform_random", "n": SAMPLE_N}, "evals": {"metrics": ["em"]}, "artifacts_dir": folder}
    out = PL.run_pipeline(qa_view(spark, sf_dir, labels=False), cfg)
    written = spark.read.json(f"{folder}/predictions").groupBy("dataset").agg(F.count(F.lit(1)).alias("n_predictions"))
    return out["metrics_summary"].join(written, "dataset").select("dataset", "metric", r6(F.col("mean")).alias("mean"), "n", "n_predictions")


@register("e03c_trials_rag", O.with_qa("SELECT trial, dataset, 'EM' AS metric, round(avg(em), 6) AS mean, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT {t} AS trial, dataset, {_RAG_EM} AS em FROM {_rag_draw(42 + t)} WHERE rn <= {SAMPLE_N}" for t in range(_TRIALS)) + ") GROUP BY ALL"))
def e03c_trials_rag(spark, sf_dir):
    qa = qa_view(spark, sf_dir, labels=False)
    summ, _ = PL.run_trials(qa, "uniform_random", {"n": SAMPLE_N}, trials=_TRIALS, metrics=["em"], cfg=_RAG_CFG)
    return summ.select("trial", "dataset", "metric", r6(F.col("mean")).alias("mean"), "n")


@register("e01b_empty_dataset", O.with_qa("SELECT s.dataset, 'EM' AS metric, round(avg(CASE WHEN pn = gn THEN 1.0 ELSE 0.0 END) FILTER (prep0.dataset IS NOT NULL), 6) AS mean, count(prep0.dataset) AS n "
                                          "FROM (SELECT DISTINCT dataset FROM qa UNION ALL SELECT 'none') s LEFT JOIN prep0 ON prep0.dataset = s.dataset GROUP BY s.dataset", O.PREP_CTE))
def e01b_empty_dataset(spark, sf_dir):
    from ..operators.report import summarise

    qa = qa_view(spark, sf_dir, labels=False)
    names = qa.select("dataset").distinct().unionByName(spark.range(1).select(F.lit("none").alias("dataset")))
    scored, keys = score_columns(qa, ["em"])
    return summarise(scored, keys, names).select("dataset", "metric", r6(F.col("mean")).alias("mean"), "n")


@register(
    "e07_evaluation_step",
    O.with_qa(
        "SELECT dataset, metric, round(avg(value), 6) AS mean, count(value) AS n FROM lm GROUP BY dataset, metric",
        O.PREP_CTE,
        f"sc AS (SELECT dataset, entry_id, {O.metric_exprs()['EM']} AS \"EM\", {O.metric_exprs()['jaccard']} AS \"jaccard\" FROM prep)",
        "lm AS (UNPIVOT sc ON \"EM\", \"jaccard\" INTO NAME metric VALUE value)",
    ),
)
def e07_evaluation_step(spark, sf_dir):
    qa = qa_view(spark, sf_dir, labels=False)
    _enriched, summary = PL.evaluation_step(qa, ["em", "jaccard"])
    return summary.select("dataset", "metric", r6(F.col("mean")).alias("mean"), "n")


@register(
    "e08_sampling_step",
    "SELECT dataset, 'stratified' AS method, CAST(30 AS BIGINT) AS requested_n, count(*) AS actual_n FROM ("
    + _strat_sql(30, "proportional") + ") GROUP BY dataset",
)
def e08_sampling_step(spark, sf_dir):
    qa = qa_view(spark, sf_dir)
    _s, audit = PL.sampling_step(qa, "stratified", {"n": 30})
    return audit.select("dataset", "method", "requested_n", "actual_n")


@register(
    "b16_date_parser",
    "SELECT event_id, CAST(CASE WHEN event_id % 4 = 0 THEN epoch(date_trunc('day', ts)) ELSE epoch(date_trunc('second', ts)) END AS BIGINT) AS epoch_s FROM events",
)
def b16_date_parser(spark, sf_dir):
    ev = _read(spark, sf_dir, "events").select("event_id", "ts")
    m4 = F.col("event_id") % 4
    s = (
        F.when(m4 == 0, F.date_format("ts", "yyyy-MM-dd"))
        .when(m4 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(m4 == 2, F.concat(F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
    )
    num = F.when(m4 == 3, F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("double"))
    parsed = F.coalesce(S.parse_date(s, "string"), S.parse_date(num, "double"))
    return ev.select("event_id", F.unix_timestamp(parsed.cast("timestamp")).alias("epoch_s"))


@register(
    "b16b_iso_forms",
    "SELECT event_id, CAST(epoch_us(CASE event_id % 6 WHEN 0 THEN date_trunc('day', ts) WHEN 1 THEN date_trunc('minute', ts) WHEN 2 THEN date_trunc('hour', ts - INTERVAL 330 MINUTE) + INTERVAL 330 MINUTE ELSE ts END) AS BIGINT) AS micros FROM events",
)
def b16b_iso_forms(spark, sf_dir):
    ev = _read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    m = F.col("event_id") % 6
    text = lambda form, shift=0: F.date_format(F.col("ts") + F.expr(f"INTERVAL {shift} MINUTES"), form)
    s = (
        F.when(m == 0, text("yyyyMMdd")).when(m == 1, text("yyyy-MM-dd'T'HH:mm")).when(m == 2, F.concat(text("yyyy-MM-dd HH", -330), F.lit("-0530")))
        .when(m == 3, text("yyyy-MM-dd HH:mm:ss.SSSSSS")).when(m == 4, F.concat(text("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", 60), F.lit("+01")))
        .otherwise(F.concat(text("yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00:00")))
    )
    return ev.select("event_id", F.unix_micros(S.parse_date(s, "string").cast("timestamp")).alias("micros"))


# ---------------------------------------------------------------- streams ----------
from ..streaming import running as RUN  # noqa: E402


def _streamed(spark, sf_dir, build, mode: str) -> DataFrame:
    """All QA rows as a stream of a few micro-batches; the rows that ``build`` gives with their epoch."""
    qa = qa_view(spark, sf_dir, labels=False).select("dataset", "entry_id", "Response", "Predicted")
    path, out = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    qa.write.parquet(path)
    files = max(1, len(spark.read.parquet(path).inputFiles()) // 3)
    stream = spark.readStream.schema(qa.schema).option("maxFilesPerTrigger", files).parquet(path)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    running = build(stream).writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", scratch_path(spark, "stream-state"))
    running.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@register("s01_running_sample", O.with_qa(_rank_sql("qa", f"{O.u(42, 'pick', O.ID)}, entry_id", SAMPLE_N)))
def s01_running_sample(spark, sf_dir):
    got = _streamed(spark, sf_dir, lambda s: RUN.running_sample(s, SAMPLE_N), "update")
    last = got.groupBy("dataset").agg(F.max("n_seen").alias("n_seen"))
    return got.join(last, ["dataset", "n_seen"]).select("dataset", "entry_id")


@register("s02_running_summary", O.with_qa(
    f"SELECT dataset, 'EM' AS metric, round(sum({O.metric_exprs()['EM']}), 6) AS total, count(*) AS n FROM prep GROUP BY dataset "
    f"UNION ALL SELECT dataset, 'F1' AS metric, round(sum({O.metric_exprs()['F1']}), 6) AS total, count(*) AS n FROM prep GROUP BY dataset", O.PREP_CTE))
def s02_running_summary(spark, sf_dir):
    got = _streamed(spark, sf_dir, lambda s: RUN.running_summary(s, ["em", "f1"]), "complete")
    last = got.agg(F.max("epoch").alias("epoch"))
    return got.join(F.broadcast(last), "epoch").select("dataset", "metric", r6(F.col("total")).alias("total"), "n")
