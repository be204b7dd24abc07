"""Queries over the test tables, one per operator, with the parameters a production job uses."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    cover_tree,
    fill_middle,
    hidden_markov,
    mixing,
    oracle,
    packing,
    pii,
    ptolemaic,
    quality_crf,
    quality_rules,
    simhash_vp,
    substring_dedup,
    token_counts,
    toxicity,
)
from .common import table

PACKING_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
COUNTING_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash_vp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vp.near_duplicates(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_report(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), PACKING_TOKENIZER)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), COUNTING_TOKENIZER)


def op11_ptolemaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ptolemaic.cluster(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest)


def op12_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score(table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    output, text = F.col("output"), fill_middle.restored(F.col("output"), F.col("form"))
    digests = [F.sha2(output, 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256")]
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cover_tree": op1_cover_tree,
    "op2_quality_crf": op2_quality_crf,
    "op3_toxicity": op3_toxicity,
    "op4_simhash_vp": op4_simhash_vp,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_pii": op6_pii,
    "op7_packing": op7_packing,
    "op8_mixing": op8_mixing,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_counts": op10_token_counts,
    "op11_ptolemaic": op11_ptolemaic,
    "op12_hidden_markov": op12_hidden_markov,
    "op13_fill_middle": op13_fill_middle,
}

#: The other operators learn models, or hash, encode and pack in ways SQL does not have; the
#: tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_cover_tree": oracle.TOP_K,
    "op5_substring_dedup": oracle.SUBSTRING_DEDUP,
    "op8_mixing": oracle.MIXING,
    "op11_ptolemaic": oracle.centroid_clustering(),
    "op13_fill_middle": oracle.FILL_MIDDLE,
}
