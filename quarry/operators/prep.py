"""Row preparation: normalisation, projection, content filter, first-wins dedupe, cap,
nested field access and preview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS_CLASS

TEXT_FIELDS = ("Question", "Response", "Predicted")
PREVIEW_ROWS = 25
PREVIEW_PREDICTION_ROWS = 50
# Fixed alias lists used by the preview (first non-null wins, in this order).
PREVIEW_ALIASES = {
    "Question": ["Question", "question", "query", "prompt"],
    "Context": ["Context", "context", "document", "doc", "passage", "ctx"],
    "Response": ["Response", "response", "answer", "gold", "ground_truth"],
    "Predicted": ["Predicted", "predicted", "prediction", "model_answer", "pred", "output"],
}

_NOT_WS = "[^" + WS_CLASS[1:]


def strip_ws(c: Column) -> Column:
    """Python str.strip(): remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(c, "^" + WS_CLASS + "+|" + WS_CLASS + "+$", "")


def has_text(c: Column) -> Column:
    """True when the string has a non-whitespace character (null -> False)."""
    return F.coalesce(c.rlike(_NOT_WS), F.lit(False))


def _item_text(x: Column, typ: str) -> Column:
    """A list item as text; null and falsy items (0, false) become ''."""
    text = F.coalesce(x.cast("string"), F.lit(""))
    if typ in ("tinyint", "smallint", "int", "bigint", "float", "double") or typ.startswith("decimal"):
        return F.when(x == 0, F.lit("")).otherwise(text)
    if typ == "boolean":
        return F.when(~x, F.lit("")).otherwise(text)
    return text


def normalize_rows(df: DataFrame, max_context_chars: int | None = None) -> DataFrame:
    """Text fields to string; a list Context to its items joined by newlines; RetrievedContexts
    items to strings ('' for null, 0 and false). ``max_context_chars`` cuts Context if given."""
    types = dict(df.dtypes)
    items = lambda c: F.transform(c, lambda x: _item_text(x, types[c][6:-1]))
    out: dict[str, Column] = {}
    if "Context" in types:
        ctx = F.array_join(items("Context"), "\n") if types["Context"].startswith("array<") else F.col("Context").cast("string")
        out["Context"] = F.substring(ctx, 1, int(max_context_chars)) if max_context_chars else ctx
    for t in (*TEXT_FIELDS, "GoldDocId"):
        if types.get(t, "string") != "string":
            out[t] = F.col(t).cast("string")
    if "RetrievedContexts" in types:
        rc = F.col("RetrievedContexts")
        is_list = types["RetrievedContexts"].startswith("array<")
        out["RetrievedContexts"] = items("RetrievedContexts") if is_list else F.when(rc.isNotNull(), F.array(rc.cast("string")))
    if not types.get("RetrievedDocIds", "array<string>").startswith("array<string"):
        out["RetrievedDocIds"] = F.transform("RetrievedDocIds", lambda x: x.cast("string"))
    return df.withColumns(out) if out else df


def keep_only(df: DataFrame, keys: list[str] | None, always: tuple = ("dataset", "entry_id", "pos")) -> DataFrame:
    """Keep the listed keys that exist (plus the identity columns)."""
    if not keys:
        return df
    want = [c for c in always if c in df.columns] + [k for k in keys if k in df.columns and k not in always]
    return df.select(*want)


def content_filter(df: DataFrame) -> DataFrame:
    """Drop rows whose Question, Response and Predicted are all blank."""
    conds = [has_text(F.col(t)) for t in TEXT_FIELDS if t in df.columns]
    if not conds:
        return df.limit(0)
    keep = conds[0]
    for c in conds[1:]:
        keep = keep | c
    return df.where(keep)


def dedupe_key(df: DataFrame, context_chars: int | None = None) -> tuple[Column, Column]:
    """(question, digest of the context), both lower-cased; ``context_chars`` compares only so many
    characters of the context."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")
    ctx = text("Context")
    return F.lower(strip_ws(text("Question"))), F.sha2(F.lower(F.substring(ctx, 1, context_chars) if context_chars else ctx), 256)


def dedupe(df: DataFrame, context_chars: int | None = None) -> DataFrame:
    """First row (by pos) per (dataset, question, whole context). The window is keyed by the
    dedupe key, and rn <= 1 lets Spark insert a map-side WindowGroupLimit, so a hot
    duplicate key is cut down before the shuffle."""
    q, c = dedupe_key(df, context_chars)
    w = Window.partitionBy("dataset", "_dq", "_dc").orderBy("pos", "entry_id")
    return (
        df.withColumn("_dq", q).withColumn("_dc", c)
        .withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= 1)
        .drop("_dq", "_dc", "_rn")
    )


def cap_per_dataset(df: DataFrame, n: int | None) -> DataFrame:
    """First ``n`` rows by pos per dataset (WindowGroupLimit: partial top-n per task)."""
    if not n:
        return df
    w = Window.partitionBy("dataset").orderBy("pos", "entry_id")
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= int(n)).drop("_rn")


def load_and_normalize(
    df: DataFrame,
    *,
    max_items_per_dataset: int | None = None,
    max_context_chars: int | None = None,
    dedupe_rows: bool = True,
    dedupe_context_chars: int | None = None,
    keep_only_keys: list[str] | None = None,
) -> DataFrame:
    """Normalise -> keep_only -> content filter -> dedupe -> cap (the reference order)."""
    out = normalize_rows(df, max_context_chars)
    out = keep_only(out, keep_only_keys)
    out = content_filter(out)
    if dedupe_rows:
        out = dedupe(out, dedupe_context_chars)
    return cap_per_dataset(out, max_items_per_dataset)


def get_path(col: str | Column, path: str, typ: str = "string", default=None) -> Column:
    """Dotted field access ``a.b.c`` inside a JSON string column, with a default. Structs, maps and
    VARIANT columns: see ``fields.resolve`` and ``get_variant_path``."""
    c = F.col(col) if isinstance(col, str) else col
    val = F.get_json_object(c, "$." + path)
    if typ != "string":
        val = val.try_cast(typ)
    return F.coalesce(val, F.lit(default).cast(typ)) if default is not None else val


def get_variant_path(col: str | Column, path: str, typ: str = "string") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.try_variant_get(c, "$." + path, typ)


def preview(df: DataFrame, k: int = PREVIEW_ROWS) -> DataFrame:
    """First ``k`` rows per dataset with a running ``No``; of a field's aliases the first that is
    neither null nor '' counts."""
    cols = []
    for canon, names in PREVIEW_ALIASES.items():
        present = [F.col(n).cast("string") for n in names if n in df.columns]
        filled = [F.nullif(c, F.lit("")) for c in present]
        cols.append((F.coalesce(*filled, *present) if present else F.lit(None).cast("string")).alias(canon))
    w = Window.partitionBy("dataset").orderBy("pos", "entry_id")
    return (
        df.select("dataset", "entry_id", "pos", *cols)
        .withColumn("No", F.row_number().over(w))
        .where(F.col("No") <= int(k))
    )


def preview_predictions(df: DataFrame, k: int = PREVIEW_PREDICTION_ROWS) -> DataFrame:
    """The first ``k`` rows per dataset that have a prediction."""
    rows = preview(df.where(has_text(F.col("Predicted"))), k)
    return rows.select("dataset", "No", "Question", "Response", "Predicted")
