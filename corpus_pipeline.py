"""A corpus pipeline: each stage takes the documents that its predecessor left.

STAGES lists (name, function); each function takes (spark, docs, sf_dir).  The
first four return documents with all their columns, the last one their tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, minhash, quality_rules, sentencepiece_codec, suffix_dedup
from millrace.llm.textbatch import removed, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null, empty and blank texts have too few words and go; rows that repeat are
    judged alike.  Documents with a null language are held against the nearest
    reference.
    """
    return quality_rules.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays.

    Null and blank texts are no duplicates of others; of rows that repeat an id
    and a text one stays.
    """
    return minhash.without_near_duplicates(docs, minhash.Rule(percent=80, rows=4))


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words, and strings of 280 bytes, that occur elsewhere are cut out of the texts.

    Every row stays; a null text stays null, and a text that is all repeats
    becomes empty.  Rows that repeat are occurrences like any other.
    """
    cut = suffix_dedup.without_repeats(docs, suffix_dedup.Repeats(length=280, anchor=64), suffix_dedup.Repeats(length=51, anchor=12, words=True))
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go.

    Null and empty texts hold none and stay; rows that repeat are judged alike.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each text, and what they decode to; a null text has none and decodes to an empty one."""
    pieces = sentencepiece_codec.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    coded = sentencepiece_codec.encode_decode(docs, pieces)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "byte_tokens", "decoded", "round_trip")


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeat_removal),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", tokens),
]

#: Removing maximal repeats and segmenting by a trie can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; between stages they are tables in the shared folder, each removed when the next one is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir))
        if last:
            removed(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
