"""Readers that map any QA source to the canonical entry schema.

* JSON documents (list of rows, ``{"data": [...]}``, ``{name: [...]}``, or one row object)
  are parsed as VARIANT; one document is one file, so this path is for small inputs.
* JSON Lines is the scale path: ``spark.read.text`` splits files, each line is parsed as
  VARIANT; no schema inference pass over the data.
* Typed tables (Parquet, Delta, any DataFrame) only get their column names canonicalised.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import WS_CLASS
from ..session import saved

# ---- fixed values: key synonyms (normalised key -> canonical column), in priority order --
KEY_SYNONYMS = {
    "question": "Question", "query": "Question", "prompt": "Question",
    "context": "Context", "passage": "Context", "ctx": "Context",
    "response": "Response", "answer": "Response", "gold": "Response",
    "ground_truth": "Response", "groundtruth": "Response",
    "predicted": "Predicted", "prediction": "Predicted", "output": "Predicted",
    "retrievedcontexts": "RetrievedContexts", "contexts": "RetrievedContexts",
    "retrieveddocids": "RetrievedDocIds", "retrieved_docs": "RetrievedDocIds",
    "golddocid": "GoldDocId", "gold_doc_id": "GoldDocId",
}
CANONICAL = ["Question", "Context", "Response", "Predicted", "RetrievedContexts", "RetrievedDocIds", "GoldDocId"]
TEXT_COLS = ["Question", "Context", "Response", "Predicted", "GoldDocId"]
DEFAULT_DATASET = "uploaded"


def normalise_key(k: str) -> str:
    return (k or "").strip().lower().replace(" ", "").replace("-", "_")


def canonical_key(k: str) -> str:
    return KEY_SYNONYMS.get(normalise_key(k), k)


def _priority(raw: str, canon: str) -> int:
    """Q4 rule: the canonical spelling wins, then synonyms in table order."""
    if raw == canon:
        return -1
    nk = normalise_key(raw)
    keys = list(KEY_SYNONYMS)
    return keys.index(nk) if nk in keys else len(keys)


def _normalised(k: Column) -> Column:
    """``normalise_key`` as a column expression."""
    trimmed = F.regexp_replace(k, f"^{WS_CLASS}+|{WS_CLASS}+$", "")
    return F.regexp_replace(F.regexp_replace(F.lower(trimmed), " ", ""), "-", "_")


def _key_expr(k: Column) -> Column:
    """Canonical key of a key column."""
    table = F.create_map(*[F.lit(x) for kv in KEY_SYNONYMS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, _normalised(k)), k)


def _key_priority(k: Column, canon: Column) -> Column:
    order = F.create_map(*[F.lit(x) for i, syn in enumerate(KEY_SYNONYMS) for x in (syn, i)])
    return F.when(k == canon, F.lit(-1)).otherwise(F.coalesce(F.try_element_at(order, _normalised(k)), F.lit(len(KEY_SYNONYMS))))


# ------------------------------------------------------------------ typed tables ------

def read_table(
    df: DataFrame,
    *,
    dataset_name: str = DEFAULT_DATASET,
    dataset_col: str | None = None,
    id_col: str | None = None,
    order_col: str | None = None,
    mapping: dict | None = None,
) -> DataFrame:
    """Canonicalise a typed DataFrame: rename columns through the synonym table (or an
    explicit ``mapping``), add dataset / entry_id / pos. Rows whose dataset is NULL belong to
    ``dataset_name``; ids stay as given, also where they repeat (see operators/identity). Without an id or order column a row's id
    is the digest of its content and a count among equal rows, whatever the partitioning."""
    mapping = dict(mapping or {})
    chosen: dict[str, str] = {}
    for c in df.columns:
        if c in mapping:
            target = mapping[c]
        elif c in ("dataset", "entry_id", "pos") or c in (dataset_col, id_col, order_col):
            continue
        else:
            target = canonical_key(c)
        prev = chosen.get(target)
        if prev is None or _priority(c, target) < _priority(prev, target):
            chosen[target] = c
    used = set(chosen.values())
    cols = []
    ds = F.col(dataset_col) if dataset_col else (F.col("dataset") if "dataset" in df.columns else F.lit(dataset_name))
    ds = F.coalesce(ds.cast("string"), F.lit(dataset_name))
    cols.append(ds.alias("dataset"))
    pos = F.col(order_col) if order_col else (F.col("pos") if "pos" in df.columns else None)
    if id_col:
        eid = F.col(id_col).cast("string")
    elif "entry_id" in df.columns:
        eid = F.col("entry_id").cast("string")
    elif "id" in df.columns and "id" not in used:
        eid = F.col("id").cast("string")
    elif pos is not None:
        eid = F.md5(F.concat_ws("\u0001", F.lit("table"), ds.cast("string"), pos.cast("string")))
    else:
        content = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))
        name = "__content"
        df = df.withColumn(name, content)
        again = F.row_number().over(Window.partitionBy(name).orderBy(name))
        eid = F.when(again == 1, F.col(name)).otherwise(F.concat_ws("-", F.col(name), again.cast("string")))
    cols.append(eid.alias("entry_id"))
    cols.append((pos if pos is not None else F.lit(None)).cast("bigint").alias("pos"))
    for target, src in chosen.items():
        if target in ("dataset", "entry_id", "pos"):
            continue
        cols.append(F.col(f"`{src}`").alias(target))
    return df.select(*cols)


# ------------------------------------------------------------------ VARIANT rows -------

def variant_rows_to_canonical(rows: DataFrame, row_col: str = "row") -> DataFrame:
    """(dataset, pos, file, row VARIANT) -> canonical columns + ``extra`` VARIANT.
    Non-object rows are dropped. Present-but-null text fields become ''."""
    m = F.try_variant_get(F.col(row_col), "$", "map<string,variant>")
    ent = F.map_entries(m)
    tagged = F.transform(
        ent,
        lambda e: F.struct(
            _key_expr(e["key"]).alias("ck"), e["key"].alias("k"), e["value"].alias("v")
        ),
    )
    df = rows.where(m.isNotNull()).select("*", tagged.alias("_kv"))
    out = [F.col("dataset"), F.col("pos")]
    for canon in CANONICAL:
        hits = F.filter("_kv", lambda x: x["ck"] == F.lit(canon))
        ranked = F.transform(hits, lambda x: F.struct(_key_priority(x["k"], F.lit(canon)).alias("p"), x["v"].alias("v")))
        best = F.array_min(F.transform(ranked, lambda x: x["p"]))
        first = F.try_element_at(F.filter(ranked, lambda x: x["p"] == best), F.lit(1))["v"]
        present = F.size(hits) > 0
        if canon in TEXT_COLS:
            val = F.when(present, F.coalesce(F.try_variant_get(first, "$", "string"), F.lit("")))
        elif canon == "RetrievedContexts":
            arr = F.try_variant_get(first, "$", "array<variant>")
            items = F.transform(arr, lambda x: F.when(_falsy(x), F.lit("")).otherwise(F.try_variant_get(x, "$", "string")))
            val = (
                F.when(~present | F.is_variant_null(first), F.lit(None).cast("array<string>"))
                .when(arr.isNotNull(), items)
                .otherwise(F.array(F.try_variant_get(first, "$", "string")))
            )
        else:  # RetrievedDocIds
            arr = F.try_variant_get(first, "$", "array<variant>")
            val = F.transform(arr, lambda x: F.try_variant_get(x, "$", "string"))
        out.append(val.alias(canon))
    id_v = F.try_variant_get(F.col(row_col), "$.id", "string")
    eid = F.coalesce(id_v, F.md5(F.concat_ws("\u0001", F.col("file"), F.col("dataset"), F.col("pos").cast("string"))))
    return df.select(*out, eid.alias("entry_id"), F.col(row_col).alias("extra"), F.col("file").alias("source_file"))


def _falsy(x: Column) -> Column:
    """Python falsiness of a JSON value: null, false, 0, '', [], {}."""
    s = F.try_variant_get(x, "$", "string")
    num = F.try_variant_get(x, "$", "double")
    arr = F.try_variant_get(x, "$", "array<variant>")
    obj = F.try_variant_get(x, "$", "map<string,variant>")
    return (
        x.isNull() | F.is_variant_null(x)
        | (F.schema_of_variant(x) == "BOOLEAN") & (s == "false")
        | (num == 0) & F.schema_of_variant(x).isin("BIGINT", "DOUBLE", "BOOLEAN") | F.schema_of_variant(x).startswith("DECIMAL") & (num == 0)
        | (F.schema_of_variant(x) == "STRING") & (s == "")
        | (arr.isNotNull() & (F.size(arr) == 0))
        | (obj.isNotNull() & (F.size(obj) == 0))
    )


#: Splits of text files whose numbers a broadcast may hold (some 200 bytes each).
MAX_SPLITS = 500_000


def read_jsonl(spark: SparkSession, path, dataset_name: str = DEFAULT_DATASET) -> DataFrame:
    """One JSON object per non-blank line (splittable). ``pos`` counts the lines in the order of
    (file, split, line): a line's place does not depend on how splits are packed into tasks, and
    neither does the id made from it. A first pass counts the lines of each split and notes the
    row number that its first line has in its task; the second pass reads the same splits, so a
    line's number in its split is its row number less that one, and no line is shuffled."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
    ).where(F.col("value").rlike("[^" + WS_CLASS[1:])).withColumn("_seq", F.monotonically_increasing_id())
    splits = lines.groupBy("file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("file", "_start").rowsBetween(Window.unboundedPreceding, -1))  # a row a split
    splits = saved(splits.select("file", "_start", "_first", F.coalesce(before, F.lit(0)).alias("_before")), "splits")
    if splits.count() <= MAX_SPLITS:
        splits = F.broadcast(splits)
    rows = lines.join(splits, ["file", "_start"]).select(
        F.lit(dataset_name).alias("dataset"), (F.col("_before") + F.col("_seq") - F.col("_first")).cast("bigint").alias("pos"), "file", F.parse_json("value").alias("row")
    )
    return variant_rows_to_canonical(rows)


def _document_datasets(doc: Column, default_name: Column) -> Column:
    """array<struct<name, rows array<variant>>> for one parsed JSON document."""
    as_list = F.try_variant_get(doc, "$", "array<variant>")
    as_obj = F.try_variant_get(doc, "$", "map<string,variant>")
    keys = F.map_keys(as_obj)
    data = F.try_variant_get(doc, "$.data", "array<variant>")
    named = F.transform(
        F.map_entries(as_obj),
        lambda e: F.struct(e["key"].alias("name"), F.try_variant_get(e["value"], "$", "array<variant>").alias("rows")),
    )
    all_lists = F.forall(named, lambda x: x["rows"].isNotNull())
    one = lambda rows: F.array(F.struct(default_name.alias("name"), rows.alias("rows")))
    return (
        F.when(as_list.isNotNull(), one(as_list))
        .when(as_obj.isNotNull() & (F.size(keys) == 1) & (F.try_element_at(keys, F.lit(1)) == "data") & data.isNotNull(), one(data))
        .when(as_obj.isNotNull() & (F.size(keys) > 0) & all_lists, named)
        .when(as_obj.isNotNull() & (F.size(keys) > 0), one(F.array(doc)))
        .otherwise(F.raise_error(F.lit("a JSON document must be a list of rows, an object of lists, or one row object")))
    )


def read_json(spark: SparkSession, path, dataset_name: str = DEFAULT_DATASET, one_per_line: bool = False) -> DataFrame:
    """JSON documents: list of rows, {"data": [...]} (sole key), {name: [rows]} or a single row
    object; other shapes are an error. A file is one document, or with ``one_per_line`` one on each
    line, which lets a large file be split."""
    docs = spark.read.text(path, wholetext=not one_per_line).select(
        F.col("_metadata.file_path").alias("file"), F.parse_json("value").alias("doc")
    )
    sets = docs.select("file", F.explode(_document_datasets(F.col("doc"), F.lit(dataset_name))).alias("ds"))
    rows = sets.select("file", F.col("ds.name").alias("dataset"), F.posexplode("ds.rows").alias("pos", "row"))
    return variant_rows_to_canonical(rows.select("dataset", F.col("pos").cast("bigint").alias("pos"), "file", "row"))


def _plain_path(p: str) -> str:
    """A path as Spark's file metadata spells it, without the local scheme."""
    return re.sub("^file:(//)?", "", p)


def read_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several JSON documents in one read; a list takes the file stem as its name, an object
    keeps its list-valued keys; a name already taken gets the next free of ``_2``, ``_3``... in the
    order the paths are given. Only the set names meet in the driver, a few per path."""
    stems = [p.rstrip("/").split("/")[-1].rsplit(".", 1)[0] or f"ds{i + 1}" for i, p in enumerate(paths)]
    order = spark.createDataFrame([(i, _plain_path(p), s) for i, (p, s) in enumerate(zip(paths, stems))], "_fi int, _path string, _stem string")
    docs = spark.read.text(paths, wholetext=True).select(
        F.parse_json("value").alias("doc"), F.col("_metadata.file_path").alias("file"),
        F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), "^file:(//)?", "").alias("_path"),
    )
    docs = docs.join(order, "_path")
    as_list = F.try_variant_get(F.col("doc"), "$", "array<variant>")
    as_obj = F.try_variant_get(F.col("doc"), "$", "map<string,variant>")
    named = F.filter(
        F.transform(F.map_entries(as_obj), lambda e: F.struct(e["key"].alias("name"), F.try_variant_get(e["value"], "$", "array<variant>").alias("rows"))),
        lambda x: x["rows"].isNotNull(),
    )
    sets = F.when(as_list.isNotNull(), F.array(F.struct(F.col("_stem").alias("name"), as_list.alias("rows")))).otherwise(named)
    allsets = docs.select("_fi", "file", F.posexplode(sets).alias("_ki", "ds"))
    taken: set[str] = set()
    names = []
    for fi, ki, name in sorted(map(tuple, allsets.select("_fi", "_ki", "ds.name").collect())):
        free, i = name, 2
        while free in taken:
            free, i = f"{name}_{i}", i + 1
        taken.add(free)
        names.append((fi, ki, free))
    table = spark.createDataFrame(names, "_fi int, _ki int, dataset string")
    rows = allsets.join(table, ["_fi", "_ki"]).select("file", "dataset", F.posexplode("ds.rows").alias("pos", "row"))
    return variant_rows_to_canonical(rows.select("dataset", F.col("pos").cast("bigint").alias("pos"), "file", "row"))
