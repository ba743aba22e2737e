"""DuckDB SQL text for the correctness oracle (one statement per query).

The oracle computes the same definitions a different way where it can: bag metrics use
per-row list functions instead of the Spark token profile; samplers recompute the md5
uniform key. Tables are the pre-registered views of the driver.
"""

from __future__ import annotations

import math

from ..functions.text import WS_CLASS, WS_RUN  # noqa: F401

PUNCT_RE = "[!-/:-@\\[-`{-~]"
NON_ALNUM_RUN = "[^\\p{L}\\p{N}]+"
TWO_52 = "4503599627370496.0"

QA_CTE = """qa AS (
  SELECT %(dataset)s AS dataset, %(entry)s AS entry_id, doc_id AS pos,
    front AS Question, text AS Context, back AS Response,
    CASE doc_id %% 5 WHEN 0 THEN back WHEN 1 THEN 'The ' || back || '!'
      WHEN 2 THEN mid || tail WHEN 3 THEN front ELSE '' END AS Predicted,
    CASE doc_id %% 6 WHEN 0 THEN NULL WHEN 1 THEN [back, front] WHEN 2 THEN [front, back]
      WHEN 3 THEN [front, tail, back] WHEN 4 THEN [front, mid] ELSE []::VARCHAR[] END AS RetrievedContexts,
    [%(docids)s] AS RetrievedDocIds,
    CASE WHEN doc_id %% 5 = 4 THEN NULL
      ELSE CAST((doc_id + (doc_id %% 12 + 1) * (doc_id %% 12 + 1)) %% 97 AS VARCHAR) END AS GoldDocId,
    source AS topic,
    CASE WHEN doc_id %% 11 = 0 THEN NULL ELSE CAST(n_chars AS DOUBLE) END AS weight,
    coalesce(CAST(quality AS VARCHAR), 'None') AS answer_type,
    CASE WHEN labelled THEN CAST(n_chars AS DOUBLE) / 100.0 END AS difficulty,
    coalesce(toxic, 0) = 1 AS is_unanswerable,
    CASE WHEN doc_id %% 13 = 0 THEN NULL ELSE ts END AS date,
    CAST(embedding AS DOUBLE[]) AS embedding,
    CASE WHEN doc_id %% 9 = 0 THEN NULL ELSE [abs(CAST(embedding[1] AS DOUBLE)),
      abs(CAST(embedding[2] AS DOUBLE)), abs(CAST(embedding[3] AS DOUBLE))] END AS probs,
    label, quality, toxic
  FROM (
    SELECT d.*, l.quality, l.toxic, l.doc_id IS NOT NULL AS labelled, e.ts, v.embedding, v.label,
      substr(d.text, 1, length(d.text) // 2) AS front, substr(d.text, length(d.text) // 2 + 1) AS back,
      substr(d.text, length(d.text) // 3 + 1, length(d.text) // 3) AS mid, substr(d.text, 2 * (length(d.text) // 3) + 1) AS tail
    FROM documents d LEFT JOIN labels l USING (doc_id)
      LEFT JOIN (SELECT event_id %% (SELECT count(*) FROM documents) AS doc_id, max(ts) AS ts FROM events GROUP BY 1) e ON e.doc_id = d.doc_id
      LEFT JOIN embeddings v ON v.vec_id = d.doc_id %% (SELECT count(*) FROM embeddings))
)"""
_DOC_IDS = ", ".join(f"CAST((doc_id + {i * i}) % 97 AS VARCHAR)" for i in range(1, 11))
#: A row's identity for uniform numbers: ids are unique within a dataset only.
ID = "concat_ws('/', dataset, entry_id)"


#: (dataset, entry_id) of the views: as given, ids that restart in each set, and one JSONL set.
IDS = {
    "lang": ("lang", "CAST(doc_id AS VARCHAR)"),
    "shared": ("'set' || (doc_id % 4)", "CAST(doc_id // 4 AS VARCHAR)"),
    "uploaded": ("'uploaded'", "CAST(doc_id AS VARCHAR)"),
}
#: Ids that repeat, and rows without dataset: here a row has an id of its own, and '~' stands for NULL;
#: ``repeated`` undoes both in the result.
_SET, _ID = "CASE WHEN doc_id % 3 = 0 THEN '~' ELSE 'set' || (doc_id % 2) END", "CAST((doc_id // 7) % 40 AS VARCHAR)"
_NUMBER = f"row_number() OVER (PARTITION BY {_SET}, {_ID} ORDER BY doc_id)"
IDS["repeated"] = (_SET, f"{_ID} || CASE WHEN {_NUMBER} > 1 THEN '/' || CAST({_NUMBER} - 1 AS VARCHAR) ELSE '' END")


def repeated(sql: str, *columns: str) -> str:
    """The result of ``sql`` over the repeated ids: dataset, the given id and ``columns``."""
    names = {"dataset": "nullif(dataset, '~') AS dataset", "entry_id": "split_part(entry_id, '/', 1) AS entry_id"}
    return f"SELECT {', '.join(names.get(c, c) for c in columns)} FROM ({sql.replace(ID, 'concat_ws(' + repr('/') + ', nullif(dataset, ' + repr('~') + '), entry_id)')}) found"


def with_qa(body: str, *ctes: str, ids: str = "lang") -> str:
    dataset, entry = IDS[ids]
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {QA_CTE % {'dataset': dataset, 'entry': entry, 'docids': _DOC_IDS}}{extra}\n{body}"


def norm_tokens(x: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({x}, '')), '{PUNCT_RE}', '', 'g'), "
        f"'{WS_RUN}'), lambda t: t <> '' AND t NOT IN ('a', 'an', 'the'))"
    )


def normalize(x: str) -> str:
    return f"array_to_string({norm_tokens(x)}, ' ')"


def split_norm(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def sampler_tokens(x: str) -> str:
    return (
        f"list_filter(string_split(lower(regexp_replace(coalesce(CAST({x} AS VARCHAR), ''), "
        f"'{NON_ALNUM_RUN}', ' ', 'g')), ' '), lambda t: t <> '')"
    )


def rouge_tokens(x: str) -> str:
    return (
        f"list_filter(string_split(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), "
        f"lambda t: t <> '')"
    )


def ngrams(lst: str, n: int) -> str:
    if n == 1:
        return lst
    return f"list_transform(range(1, len({lst}) - {n} + 2), lambda i: array_to_string({lst}[i:i + {n - 1}], ' '))"


def u(seed, salt: str, id_expr: str) -> str:
    return (
        f"((CAST(('0x' || substr(md5(concat_ws(':', CAST({seed} AS VARCHAR), '{salt}', CAST({id_expr} AS VARCHAR))), 1, 13)) "
        f"AS BIGINT)::DOUBLE + 0.5) / {TWO_52})"
    )


def cnt(lst: str, t: str) -> str:
    return f"len(list_filter({lst}, lambda x: x = {t}))"


def contexts(prefix: str = "") -> str:
    p = prefix
    return (
        f"CASE WHEN {p}RetrievedContexts IS NOT NULL THEN list_transform({p}RetrievedContexts, lambda x: coalesce(x, '')) "
        f"WHEN coalesce({p}Context, '') <> '' THEN [{p}Context] ELSE []::VARCHAR[] END"
    )


def prefix_denoms(kmax: int) -> list[float]:
    out = [1.0]
    for m in range(1, kmax + 1):
        out.append(sum(1.0 / math.log2(i + 2) for i in range(m)))
    return out


def gains(kmax: int) -> list[float]:
    return [1.0 / math.log2(r + 2) for r in range(kmax)]


def lit_list(xs) -> str:
    return "[" + ", ".join(repr(float(x)) for x in xs) + "]"


# A prepared per-row frame with normalised tokens and contexts, and the sums over a row's tokens:
# one row a (row, token) with its counts in prediction (cp), gold (cg) and contexts (cc).
IDF_SINGLE = repr(math.log(1.5) + 1.0)
PREP_CTE = f"""prep0 AS (
  SELECT *, array_to_string(pt, ' ') AS pn, array_to_string(gt, ' ') AS gn, len(pt) AS P, len(gt) AS G,
    list_transform(ctx, lambda c: {normalize('c')}) AS nctx
  FROM (SELECT dataset, entry_id, Question, Context, Response, Predicted, RetrievedContexts, RetrievedDocIds,
          GoldDocId, coalesce(Response, '') AS ref, coalesce(Predicted, '') AS pred,
          {norm_tokens('Predicted')} AS pt, {norm_tokens('Response')} AS gt, {contexts()} AS ctx FROM qa)
),
tok AS (
  SELECT dataset, entry_id, t, sum(cp)::DOUBLE AS cp, sum(cg)::DOUBLE AS cg, max(cc) AS cc FROM (
    SELECT dataset, entry_id, unnest(pt) AS t, 1 AS cp, 0 AS cg, 0 AS cc FROM prep0
    UNION ALL SELECT dataset, entry_id, unnest(gt), 0, 1, 0 FROM prep0
    UNION ALL SELECT dataset, entry_id, unnest(flatten(list_transform(nctx, lambda c: {split_norm('c')}))), 0, 0, 1 FROM prep0)
  GROUP BY ALL),
bag AS (
  SELECT dataset, entry_id, sum(least(cp, cg)) AS ov, count_if(cp > 0 AND cg > 0) AS inter, count_if(cp > 0 OR cg > 0) AS uni,
    sum(cp * cg * idf * idf) / (greatest(any_value(P), 1) * greatest(any_value(G), 1)) AS tdot,
    sum((cp * idf) ** 2) / greatest(any_value(P), 1) ** 2 AS ta, sum((cg * idf) ** 2) / greatest(any_value(G), 1) ** 2 AS tb,
    sum(CASE WHEN P > 0 AND G > 0 THEN 0.5 * (cp / P) * ln((cp / P + 1e-12) / ((cp / P + cg / G) / 2.0 + 1e-12))
      + 0.5 * (cg / G) * ln((cg / G + 1e-12) / ((cp / P + cg / G) / 2.0 + 1e-12)) END) AS jsd,
    sum(CASE WHEN cc > 0 THEN cp ELSE 0 END) AS covp, sum(CASE WHEN cc > 0 THEN cg ELSE 0 END) AS covg
  FROM (SELECT tok.*, P, G, CASE WHEN cp > 0 AND cg > 0 THEN 1.0 ELSE {IDF_SINGLE} END AS idf FROM tok JOIN prep0 USING (dataset, entry_id))
  GROUP BY ALL),
prep AS (SELECT * FROM prep0 LEFT JOIN bag USING (dataset, entry_id))"""

def metric_exprs(ks=(1, 3, 5, 10)) -> dict[str, str]:
    """SQL expression per output key over the ``prep`` CTE."""
    ov, inter, uni = "coalesce(ov, 0)", "coalesce(inter, 0)", "uni"
    tdot, ta, tb, jsd_sum = "coalesce(tdot, 0)", "coalesce(ta, 0)", "coalesce(tb, 0)", "coalesce(jsd, 0)"
    covp = "(CASE WHEN P > 0 THEN coalesce(covp, 0)::DOUBLE / P ELSE 0.0 END)"
    covg = "(CASE WHEN G > 0 THEN coalesce(covg, 0)::DOUBLE / G ELSE 0.0 END)"
    by_ids = "(RetrievedDocIds IS NOT NULL AND GoldDocId IS NOT NULL)"
    pos_ids = "coalesce(list_position(RetrievedDocIds, GoldDocId), 0)"
    pos_sub = "coalesce(list_position(list_transform(nctx, lambda c: contains(c, gn)), true), 0)"
    rank_sub = f"(CASE WHEN gn <> '' AND {pos_sub} > 0 THEN {pos_sub} - 1 END)"
    rank = f"(CASE WHEN {by_ids} THEN (CASE WHEN {pos_ids} > 0 THEN {pos_ids} - 1 END) ELSE {rank_sub} END)"
    n_list = f"(CASE WHEN {by_ids} THEN len(RetrievedDocIds) ELSE len(ctx) END)"
    kmax = max(ks)
    den = lit_list(prefix_denoms(kmax))
    gn_ = lit_list(gains(kmax))
    e = {
        "EM": "CASE WHEN pn = gn THEN 1.0 ELSE 0.0 END",
        "F1": f"CASE WHEN P = 0 AND G = 0 THEN 1.0 WHEN P = 0 OR G = 0 THEN 0.0 WHEN {ov} = 0 THEN 0.0 "
        f"ELSE 2 * ({ov}::DOUBLE / P) * ({ov}::DOUBLE / G) / (({ov}::DOUBLE / P) + ({ov}::DOUBLE / G) + 1e-12) END",
        "jaccard": f"CASE WHEN P = 0 AND G = 0 THEN 1.0 WHEN P = 0 OR G = 0 THEN 0.0 ELSE {inter}::DOUBLE / {uni} END",
        "tfidf_cos": f"CASE WHEN P = 0 AND G = 0 THEN 1.0 WHEN sqrt({ta}) = 0 OR sqrt({tb}) = 0 THEN 0.0 "
        f"ELSE {tdot} / (sqrt({ta}) * sqrt({tb})) END",
        "jsd": f"CASE WHEN P = 0 AND G = 0 THEN 0.0 WHEN P = 0 OR G = 0 THEN 1.0 ELSE {jsd_sum} END",
        "SupportGoldInContexts": "CASE WHEN gn <> '' AND len(list_filter(nctx, lambda c: contains(c, gn))) > 0 THEN 1.0 ELSE 0.0 END",
        "SupportPredInContexts": "CASE WHEN pn <> '' AND len(list_filter(nctx, lambda c: contains(c, pn))) > 0 THEN 1.0 ELSE 0.0 END",
        "CoveragePrecision": covp,
        "CoverageRecall": covg,
        "CoverageF1": f"CASE WHEN {covp} = 0 AND {covg} = 0 THEN 0.0 ELSE 2 * {covp} * {covg} / ({covp} + {covg}) END",
        "MRR": f"CASE WHEN {rank} IS NOT NULL THEN 1.0 / ({rank} + 1) ELSE 0.0 END",
        "first_support_rank": f"CASE WHEN NOT {by_ids} THEN CAST({rank_sub} AS DOUBLE) END",
        "_rank": rank,
    }
    for k in ks:
        e[f"hit@{k}"] = f"CASE WHEN {rank} IS NOT NULL AND {rank} < {k} THEN 1.0 ELSE 0.0 END"
        e[f"ndcg@{k}"] = (
            f"(CASE WHEN {rank} IS NOT NULL AND {rank} < {k} THEN {gn_}[{rank} + 1] ELSE 0.0 END) "
            f"/ {den}[least({k}, {n_list}) + 1]"
        )
    return e


def hashed_vec(x: str, dim: int = 64) -> str:
    b = f"list_transform({sampler_tokens(x)}, lambda t: CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % {dim})"
    return f"list_transform(range({dim}), lambda i: len(list_filter({b}, lambda b: b = i))::DOUBLE)"


def cos(a: str, b: str) -> str:
    den = f"sqrt(list_sum(list_transform({a}, lambda x: x * x)) * list_sum(list_transform({b}, lambda x: x * x)))"
    return f"(CASE WHEN {den} > 0 THEN list_dot_product({a}, {b}) / {den} ELSE 0.0 END)"


#: n-grams of two token lists, one row a (row, n, gram) with its counts on both sides.
def grams_cte(left: str, right: str, sizes: tuple[int, ...], source: str = "prep0") -> str:
    parts = [f"SELECT dataset, entry_id, {n} AS n, unnest({ngrams(lst, n)}) AS g, {c} AS cp, {1 - c} AS cg FROM {source}" for n in sizes for lst, c in ((left, 1), (right, 0))]
    return ("gc AS (SELECT dataset, entry_id, n, g, sum(cp) AS cp, sum(cg) AS cg FROM (" + " UNION ALL ".join(parts) + ") GROUP BY ALL),\n"
            "gm AS (SELECT dataset, entry_id, " + ", ".join(f"sum(CASE WHEN n = {n} THEN least(cp, cg) END)::DOUBLE AS m{n}, sum(CASE WHEN n = {n} THEN cp END) AS p{n}, sum(CASE WHEN n = {n} THEN cg END) AS g{n}" for n in sizes) + " FROM gc GROUP BY ALL)")


def chunks_cte(size: int, name: str = "ch") -> str:
    return (f"{name} AS (SELECT dataset, entry_id, CAST(chunk_id AS INTEGER) AS chunk_id, substr(Context, chunk_id * {size} + 1, {size}) AS text "
            f"FROM (SELECT dataset, entry_id, Context, unnest(range(0, CAST((length(Context) - 1) // {size} + 1 AS BIGINT))) AS chunk_id "
            f"FROM qa WHERE length(coalesce(Context, '')) > 0))")
