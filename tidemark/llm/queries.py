"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import quality_classifier
from tidemark.llm.decontamination import decontamination
from tidemark.llm.jaccard_join import jaccard_groups
from tidemark.llm.lexical_search import indexed, search
from tidemark.llm.license_scan import license_scan
from tidemark.llm.oracles import ORACLES
from tidemark.llm.quality_rules import quality_rules
from tidemark.llm.secret_scan import secret_scan
from tidemark.llm.sentencepiece_codec import round_trip
from tidemark.llm.sharding import shard
from tidemark.llm.shared import documents
from tidemark.llm.substring_dedup import n_removed, substring_dedup
from tidemark.llm.suffix_dedup import suffix_dedup
from tidemark.llm.toxicity import held_out, toxicity, train
from tidemark.llm.whitening import whitened


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.where(~held_out("doc_id")))
    return toxicity(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", n_removed().alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", n_removed().alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    own = quality_classifier.held_out("doc_id")
    return quality_classifier.quality(docs, quality_classifier.train(docs, labels.where(~own))).select("doc_id", own.alias("held_out"), "score", "predicted")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(indexed(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict:
    found = (
        op1_ngram_jaccard_join, op2_toxicity, op3_substring_dedup, op4_license_scans, op5_sharding, op6_secret_scans, op7_quality_rules, op8_sentencepiece, op9_benchmark_decontamination,
        op10_suffix_array_dedup, op11_quality_classifier, op12_embedding_whitening, op13_ranked_lexical_search,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return ORACLES
