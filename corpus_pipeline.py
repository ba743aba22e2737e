"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

1. quality classifier: documents that the boosted trees reject go
2. n-gram Jaccard join: one document of each group of near copies stays (five words, 0.8)
3. suffix-array dedup: bytes of 100-byte strings that start earlier too are taken out of the texts
4. source mix: documents stand as often as the weighted mix takes them
5. BPE: every text encoded and decoded again; ids and round trip as digests

All stages but the last return the columns of documents. Each works on all its predecessor kept
and writes only to the shared folder that ``spark.checkpoint.dir`` names.

Null, empty and blank texts count as empty: the classifier scores them, they link with nothing, lose
nothing, and leave at the mix, which takes words. Rows that lack or repeat a doc_id are documents of
their own in every stage; labels reach the classifier by doc_id only. Of rows that repeat id and text
one stays at stage 2; ties there go to the least doc_id (none comes last), then to the md5 of the text.
A null source or lang is a value like any other. Very long texts are worked on whole. Extra columns
of any name stay until the last stage. An empty table gives no rows, with the last stage's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, mixing, ngram_join, quality_gbt, suffix_dedup
from quarry.llm.common import documents, saved
from quarry.llm.queries import tokenizer
from quarry.session import ship_package


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    model = quality_gbt.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_gbt.accepted_documents(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return ngram_join.one_of_each_group(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return suffix_dedup.dedup_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return bpe.round_trip_digest(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: SQL expresses neither the classifier nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
