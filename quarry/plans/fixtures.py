"""The QA view over the driver tables (canonical entry schema, see FIXTURES.md section 4).

documents LEFT JOIN labels / events / embeddings. Join strategy is left to Catalyst + AQE:
embeddings and labels are small at the fixture scales and get broadcast only when their
measured size is below the broadcast threshold; otherwise sort-merge joins are planned.
Only the parts a query needs are joined, so narrow queries scan narrow inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan that Parquet cannot split into as many tasks as there are cores (few row groups) is
    dealt out; a large table is read as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def qa_view(
    spark: SparkSession,
    sf_dir: str,
    *,
    labels: bool = True,
    events: bool = False,
    embeddings: bool = False,
    shared_ids: bool = False,
    repeated_ids: bool = False,
) -> DataFrame:
    """Every document as a QA row made of its whole text, cut in halves and thirds. Every event and
    every embedding belongs to some document. ``shared_ids`` deals the rows to four sets whose ids
    restart in each; ``repeated_ids`` to two sets and none (a third of the rows has a NULL dataset), each
    with forty ids that repeat."""
    d = spread(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))
    doc = F.col("doc_id")
    n = F.length("text")
    piece = lambda start, length: F.substr(F.col("text"), start, length)
    half, third = F.floor(n / 2).cast("int"), F.floor(n / 3).cast("int")
    one = F.lit(1)
    front, back = piece(one, half), piece(half + 1, n)
    mid, tail = piece(third + 1, third), piece(2 * third + 1, n)

    df = d
    if labels:
        lab = _read(spark, sf_dir, "labels").select(
            "doc_id", "quality", "toxic", F.lit(True).alias("_labelled")
        )
        df = df.join(lab, "doc_id", "left")
    if events:
        n_docs = _read(spark, sf_dir, "documents").count()
        ev = _read(spark, sf_dir, "events").groupBy(F.pmod("event_id", F.lit(n_docs)).alias("doc_id")).agg(F.max("ts").alias("ts"))
        df = df.join(ev, "doc_id", "left")
    if embeddings:
        em = _read(spark, sf_dir, "embeddings")
        n_vecs = em.count()
        em = em.select(F.col("vec_id").alias("_vec_id"), "embedding", "label")
        df = df.join(em, F.pmod(doc, F.lit(n_vecs)) == F.col("_vec_id"), "left")

    m6 = F.pmod(doc, F.lit(6))
    ctx_lists = (
        F.when(m6 == 0, F.lit(None).cast("array<string>"))
        .when(m6 == 1, F.array(back, front))
        .when(m6 == 2, F.array(front, back))
        .when(m6 == 3, F.array(front, tail, back))
        .when(m6 == 4, F.array(front, mid))
        .otherwise(F.array().cast("array<string>"))
    )
    m5 = F.pmod(doc, F.lit(5))
    predicted = (
        F.when(m5 == 0, back)
        .when(m5 == 1, F.concat(F.lit("The "), back, F.lit("!")))
        .when(m5 == 2, F.concat(mid, tail))
        .when(m5 == 3, front)
        .otherwise(F.lit(""))
    )
    j = F.pmod(doc, F.lit(12)) + 1
    gold = F.when(m5 == 4, F.lit(None).cast("string")).otherwise(
        F.pmod(doc + j * j, F.lit(97)).cast("string")
    )
    doc_ids = F.array(*[F.pmod(doc + i * i, F.lit(97)).cast("string") for i in range(1, 11)])

    dataset, entry = F.col("lang"), doc
    if shared_ids:
        dataset, entry = F.concat(F.lit("set"), F.pmod(doc, F.lit(4)).cast("string")), F.floor(doc / 4)
    if repeated_ids:
        dataset = F.when(F.pmod(doc, F.lit(3)) != 0, F.concat(F.lit("set"), F.pmod(doc, F.lit(2)).cast("string")))
        entry = F.pmod(F.floor(doc / 7), F.lit(40))
    cols = [
        dataset.alias("dataset"),
        entry.cast("string").alias("entry_id"),
        doc.alias("pos"),
        front.alias("Question"),
        F.col("text").alias("Context"),
        back.alias("Response"),
        predicted.alias("Predicted"),
        ctx_lists.alias("RetrievedContexts"),
        doc_ids.alias("RetrievedDocIds"),
        gold.alias("GoldDocId"),
        F.col("source").alias("topic"),
        F.when(F.pmod(doc, F.lit(11)) == 0, F.lit(None).cast("double"))
        .otherwise(F.col("n_chars").cast("double"))
        .alias("weight"),
    ]
    if labels:
        cols += [
            F.coalesce(F.col("quality").cast("string"), F.lit("None")).alias("answer_type"),
            F.when(F.col("_labelled"), F.col("n_chars").cast("double") / 100.0).alias("difficulty"),
            (F.coalesce(F.col("toxic"), F.lit(0)) == 1).alias("is_unanswerable"),
        ]
    if events:
        cols.append(
            F.when(F.pmod(doc, F.lit(13)) == 0, F.lit(None).cast("timestamp_ntz"))
            .otherwise(F.col("ts"))
            .alias("date")
        )
    if embeddings:
        emb = F.col("embedding").cast("array<double>")
        cols += [
            emb.alias("embedding"),
            F.when(F.pmod(doc, F.lit(9)) == 0, F.lit(None).cast("array<double>"))
            .otherwise(F.slice(F.transform(emb, lambda x: F.abs(x)), 1, 3))
            .alias("probs"),
        ]
        if labels:
            cols.append(
                F.create_map(
                    F.lit("a"), F.pmod(F.col("label"), F.lit(2)).cast("string"),
                    F.lit("b"), F.col("quality").cast("string"),
                    F.lit("c"), F.col("toxic").cast("string"),
                ).alias("committee_votes")
            )
    return df.select(*cols)


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turn -> next assistant turn of the same conversation, as raw synonym keys
    (``query`` / ``answer``) so the canonical-key step has work to do.

    An equi-join on (conv_id, turn + 1) instead of a window by conversation: the key is
    unique, so one giant conversation spreads over many tasks."""
    c = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    users = c.where(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("next_turn"), F.col("turn"), F.col("text").alias("q")
    )
    bots = c.where(F.col("role") == "assistant").select(
        "conv_id", F.col("turn").alias("next_turn"), F.col("text").alias("a")
    )
    pairs = users.join(bots, ["conv_id", "next_turn"], "inner")
    return pairs.select(
        F.lit("conversations").alias("dataset"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        (F.col("conv_id") * 10000 + F.col("turn")).alias("pos"),
        F.col("q").alias("query"),
        F.col("a").alias("answer"),
    )
