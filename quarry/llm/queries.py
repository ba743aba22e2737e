"""The registered queries of the training-data operators: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, divergence, edit_counts, imatch, lyndon_runs, mixing, ngram_join, phrases, quality_gbt, suffix_dedup, token_store, url_filter, vector_packing
from quarry.llm.common import documents


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_documents(documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_digest(documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.session import scratch_path

    manifest = token_store.write_token_files(documents(spark, sf_dir), scratch_path(spark, "token-files"), tokenizer("word_bpe_49k.json"), end_id=2)
    return token_store.read_token_digests(spark, manifest)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_components(documents(spark, sf_dir), k=3, percent=90).select("doc_id", "n_shingles", "component_id", "n_links")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digest(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge_quality(documents(spark, sf_dir))


def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_gbt.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_gbt.score_documents(docs, model)


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_filter.OP9_RULES)


def op10_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.count_edits(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), edit_counts.review_edits)


def op11_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lyndon_runs.run_digest(documents(spark, sf_dir))


def op12_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = vector_packing.token_pieces(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), end_id=0, seq_len=2048)
    return vector_packing.pack(pieces, vector_packing.Capacity(tokens=2048), weights=(1.0, 1.0, 1.0))


def op13_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top_phrases(documents(spark, sf_dir), k=2000, max_words=3, min_count=10, scale=1_000_000, percent=50)


REGISTRY = {
    "op1_imatch": (op1_imatch, None),
    "op2_suffix_dedup": (op2_suffix_dedup, None),
    "op3_token_files": (op3_token_files, None),
    "op4_ngram_join": (op4_ngram_join, None),
    "op5_bpe_round_trip": (op5_bpe_round_trip, None),
    "op6_source_mix": (op6_source_mix, mixing.OP6_SQL),
    "op7_divergence_rules": (op7_divergence_rules, None),
    "op8_quality_trees": (op8_quality_trees, None),
    "op9_url_rules": (op9_url_rules, url_filter.OP9_SQL),
    "op10_edit_counts": (op10_edit_counts, None),
    "op11_lyndon_runs": (op11_lyndon_runs, None),
    "op12_vector_packing": (op12_vector_packing, None),
    "op13_phrase_automata": (op13_phrase_automata, None),
}
