"""The queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, decontam, lm_scoring, minhash, oracles, quality_rules, sentencepiece_codec, sharding, suffix_dedup, token_counts, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(_table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 4) for c in ("class_distance", "word_distance")})


def op2_interval_tree_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed_bytes(_table(spark, sf_dir, "documents"), suffix_dedup.Repeats(length=400)).drop("removed")


def op3_byte_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(sharding.sized(_table(spark, sf_dir, "documents")), 40)


def op4_subword_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: Rules of op5: verdict, host, path.
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def op5_weighted_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_unigram_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = sentencepiece_codec.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    coded = sentencepiece_codec.encode_decode(_table(spark, sf_dir, "documents"), pieces)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "byte_tokens",
        F.xxhash64("ids").alias("ids_hash"),
        F.octet_length("decoded").cast("long").alias("decoded_bytes"),
        F.md5("decoded").alias("decoded_md5"),
        "round_trip",
    )


def op7_hyperminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), minhash.Rule(percent=85, rows=5))


def op8_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_rank_synchronous_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op10_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(_table(spark, sf_dir, "documents"), 7, 2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_distribution_divergence,
        op2_interval_tree_repeats,
        op3_byte_prefix_shards,
        op4_subword_quality_classifier,
        op5_weighted_url_vocabulary,
        op6_unigram_encode_decode,
        op7_hyperminhash_near_dedup,
        op8_spaced_seed_decontamination,
        op9_rank_synchronous_token_counts,
        op10_deleted_interpolation,
    )
}

ORACLES: dict[str, str] = {
    "op1_distribution_divergence": oracles.quality_rules_sql(),
    "op7_hyperminhash_near_dedup": oracles.near_duplicates_sql(85),
    "op3_byte_prefix_shards": oracles.byte_shards_sql(40),
    "op5_weighted_url_vocabulary": url_filter.verdict_sql("pages", URL_RULES),
}
