"""Entropy, word statistics and tokenizer metrics."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MAX_WORDS, VOWEL_SIGNS
from ..functions import arrays
from ..functions import text as T
from . import ordered


def entropy(counts: DataFrame, group: str = "lang", n: str = "n") -> DataFrame:
    """Bits for each symbol, -sum(p log2 p), of symbol counts."""
    p = F.col(n) / F.sum(n).over(Window.partitionBy(group))
    # + 0.0: a single symbol gives 0, not -0
    return counts.select(group, n, p.alias("_p")).groupBy(group).agg(F.count("*").alias("symbols"), F.sum(n).alias("total"), F.round(-F.sum(F.col("_p") * F.log2("_p")) + F.lit(0.0), 4).alias("entropy"))


def char_counts(docs: DataFrame, text: str = "text", group: str = "lang") -> DataFrame:
    return docs.select(group, F.explode(F.split(text, "")).alias("symbol")).where("symbol != ''").groupBy(group, "symbol").agg(F.count("*").alias("n"))


def byte_counts(docs: DataFrame, text: str = "text", group: str = "lang") -> DataFrame:
    """Counts of bytes, from character counts: a character's bytes are fixed."""
    chars = char_counts(docs, text, group)
    each = F.regexp_extract_all(F.hex(F.encode("symbol", "UTF-8")), F.lit(".."), F.lit(0))
    return chars.select(group, "n", F.explode(each).alias("symbol")).groupBy(group, "symbol").agg(F.sum("n").alias("n"))


def first_words(docs: DataFrame, limit: int = MAX_WORDS, group: str = "lang", text: str = "text") -> DataFrame:
    """The first words of each language in document order; only documents that begin within the limit are split open."""
    sized = docs.select("doc_id", group, F.col(text).alias("__text"), F.coalesce(F.size(T.words(F.col(text))), F.lit(0)).cast("long").alias("__n"))
    rows = ordered.by_number(sized, [group], ["doc_id"], F.col("__n"), "__running", below=limit).where("__n > 0")
    take = F.least(F.col("__n"), F.lit(limit) - (F.col("__running") - F.col("__n"))).cast("int")
    return rows.withColumn("__take", take).where("__take > 0").select("doc_id", group, F.explode(F.slice(T.words(F.col("__text")), F.lit(1), F.col("__take"))).alias("word"))


def complexity(docs: DataFrame, limit: int = MAX_WORDS, group: str = "lang") -> DataFrame:
    """Words, types, type-token ratio, mean word length and share of types that occur once."""
    types = first_words(docs, limit, group).groupBy(group, "word").agg(F.count("*").alias("n"))
    return types.groupBy(group).agg(
        F.sum("n").alias("word_count"),
        F.count("*").alias("type_count"),
        F.round(F.count("*") / F.sum("n"), 4).alias("type_token_ratio"),
        F.round(F.sum(F.col("n") * F.length("word")) / F.sum("n"), 2).alias("avg_word_length_chars"),
        F.round(F.count_if(F.col("n") == 1) / F.count("*"), 4).alias("hapax_ratio"),
    )


def tokenizer_metrics(rows: DataFrame, pieces: Column, text: Column, group: str = "lang") -> DataFrame:
    """Tokens for each sentence and character, and the share of vowel signs that begin a piece.

    ``rows`` has one sentence each.  The share is null where no piece shows a
    vowel sign (pieces of a byte-level tokenizer).
    """
    long = lambda c, name: c.cast("long").alias(name)
    # of the pieces only those that show a vowel sign matter; they are split off once
    signs = lambda ps: F.filter(ps, lambda p: p.rlike(f"[{VOWEL_SIGNS}]"))
    begun = lambda ps: F.size(F.filter(ps, T.starts_with_vowel_sign))
    both = T.let(pieces, lambda ps: T.let(signs(ps), lambda s: F.struct(long(F.size(ps), "t"), long(begun(s), "b"), long(F.size(s), "s"))))
    counted = rows.select(group, F.explode(F.array(both)).alias("x"), long(F.length(text), "c"), long(T.vowel_signs(text), "v")).select(group, "x.*", "c", "v")
    return totals(counted.withColumn("k", F.lit(1)), [group])


def totals(counted: DataFrame, names: list[str]) -> DataFrame:
    """Metrics of counts: k sentences, t tokens, c characters, v vowel signs, s pieces that show one, b pieces that begin with one."""
    return counted.groupBy(*names).agg(
        F.sum("k").cast("long").alias("sentences"),
        F.sum("t").alias("total_tokens"),
        F.sum("c").alias("total_chars"),
        F.round(F.sum("t") / F.greatest(F.sum("k"), F.lit(1)), 2).alias("avg_tokens_per_sentence"),
        F.round(F.sum("t") / F.greatest(F.sum("c"), F.lit(1)), 4).alias("tokens_per_char"),
        F.when(F.sum("s") > 0, F.round(100 * F.sum("b") / F.greatest(F.sum("v"), F.lit(1)), 2)).alias("vowel_split_pct"),
    )


def syllable_metrics(rows: DataFrame, text: str, group: str = "lang") -> DataFrame:
    """:func:`tokenizer_metrics` with single characters and with syllables as pieces: (group, ..., tokenizer), counted on Arrow arrays.

    A piece of either kind shows one vowel sign at most, so as many show one as there are.
    """
    kind = rows.schema[group].dataType.simpleString()
    signs = (0x093E, 0x094C)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = pa.schema([b.schema.field(group), *[(n, pa.int64()) for n in "ktcvsb"], ("tokenizer", pa.string())])
            texts, groups = b.column(text), b.column(group)
            out = []
            for i, j in arrays.slices(texts):
                for g, k, c, t, v, begun in arrays.sign_counts(texts.slice(i, j - i), groups.slice(i, j - i), signs):
                    out.append({group: g, "k": k, "t": c, "c": c, "v": v, "s": v, "b": v, "tokenizer": "characters"})
                    out.append({group: g, "k": k, "t": t, "c": c, "v": v, "s": v, "b": begun, "tokenizer": "aksharas"})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    counted = rows.select(group, text).mapInArrow(run, f"{group} {kind}, k long, t long, c long, v long, s long, b long, tokenizer string")
    got = totals(counted, [group, "tokenizer"])
    return got.select(*[c for c in got.columns if c != "tokenizer"], "tokenizer")


def improvement(base: Column, ours: Column) -> Column:
    """Per cent by which a value is below the base; null for a base of 0."""
    return F.when(base > 0, F.round((base - ours) / base * 100, 2))


def compression_metrics(compressed: Column, size: Column, chars: Column) -> dict[str, Column]:
    """Ratio, bits for each character and byte; null for an empty text."""
    none = lambda c: F.nullif(c, F.lit(0))
    return {"ratio": F.round(none(size) / none(compressed), 4), "bpc": F.round(compressed * 8 / none(chars), 4), "bpb": F.round(compressed * 8 / none(size), 4)}
