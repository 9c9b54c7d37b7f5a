"""A character n-gram model in place of a neural one: bits for each character, sampling.

Its numbers are those of a substitute model and no neural model's.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics, ordered

class ProbModel(Protocol):
    """What the arithmetic coder and the samplers need of a model."""

    def next_probs(self, context: Sequence[int]) -> np.ndarray: ...


class BigramModel:
    """Add-one bigram probabilities over ids below ``size``."""

    def __init__(self, counts: dict[int, dict[int, int]], size: int):
        self.counts, self.size = counts, size

    def next_probs(self, context: Sequence[int]) -> np.ndarray:
        p = np.ones(self.size)
        if context:
            for k, n in self.counts.get(context[-1], {}).items():
                p[k] += n
        return p / p.sum()

    def sample(self, start: Sequence[int], n: int, seed: int) -> list[int]:
        """``n`` further ids, the same for the same seed."""
        random, out = np.random.default_rng(seed), list(start)
        for _ in range(n):
            out.append(int(np.searchsorted(np.cumsum(self.next_probs(out)), random.random())))
        return out


def bigrams(docs: DataFrame, text: str = "text", group: str = "lang") -> DataFrame:
    """Counts of adjacent characters, in generated code: (lang, a, b, n)."""
    each = F.regexp_extract_all(F.col(text), F.lit(r"(?s)(?=([^\x{DC00}-\x{DFFF}].))"), F.lit(1))
    pair = docs.select(group, F.explode(each).alias("p"))
    return pair.groupBy(group, "p").agg(F.count("*").alias("n")).select(group, F.substring("p", 1, 1).alias("a"), F.substring("p", 2, 1).alias("b"), "n")


def bits_per_char(train: DataFrame, test: DataFrame, group: str = "lang", text: str = "text") -> DataFrame:
    """Bits of the test characters under an add-one bigram model of the training ones.

    A document's first character is coded uniformly over the vocabulary, the
    distinct characters of both parts.
    """
    learned = bigrams(train, text, group)
    contexts = learned.groupBy(group, "a").agg(F.sum("n").alias("c"))
    chars = train.select(group, text).union(test.select(group, text)).select(group, F.explode(F.split(text, "")).alias("ch")).where("ch != ''")
    size = chars.distinct().groupBy(group).agg(F.count("*").alias("v"))
    seen = bigrams(test, text, group).withColumnRenamed("n", "times")
    scored = seen.join(learned, [group, "a", "b"], "left").join(contexts, [group, "a"], "left").join(F.broadcast(size), group)  # one row a language
    p = (F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("c", F.lit(0)) + F.col("v"))
    bits = scored.groupBy(group).agg(F.sum(-F.col("times") * F.log2(p)).alias("inner"))
    sizes = test.where(F.length(text) > 0).groupBy(group).agg(F.count("*").alias("docs"), F.sum(F.length(text)).alias("chars"), F.sum(F.octet_length(text)).alias("bytes"))
    all_ = sizes.join(size, group).join(bits, group, "left").withColumn("total_bits", F.coalesce("inner", F.lit(0.0)) + F.col("docs") * F.log2(F.col("v").cast("double")))
    return all_.select(group, F.col("chars").alias("total_chars"), F.col("bytes").alias("total_bytes"), F.round("total_bits", 2).alias("total_bits"), F.round(F.col("total_bits") / F.col("chars"), 4).alias("bpc"), F.round(F.col("total_bits") / F.col("bytes"), 4).alias("bpb"))


def model_sizes(docs: DataFrame, bits: DataFrame, group: str = "lang", text: str = "text") -> DataFrame:
    """Bytes that ideal coders need: of single characters, of single bytes, and of characters after characters (``bits``, of the test part).

    A codec table (group, codec, original_bytes, original_chars, compressed_bytes).
    """
    whole = docs.groupBy(group).agg(F.sum(F.octet_length(text)).alias("original_bytes"), F.sum(F.length(text)).alias("original_chars"))

    def ideal(counts: DataFrame, name: str) -> DataFrame:
        totals = counts.groupBy(group).agg(F.sum("n").alias("__t"))
        each = ordered.beside(counts, F.broadcast(totals), [group])  # one row a group
        sums = each.groupBy(group).agg(F.sum(-F.col("n") * F.log2(F.col("n") / F.col("__t"))).alias("__bits"))
        return ordered.beside(whole, sums, [group]).select(group, F.lit(name).alias("codec"), "original_bytes", "original_chars", F.ceil(F.col("__bits") / 8).cast("long").alias("compressed_bytes"))

    pairs = bits.select(group, F.lit("bigram").alias("codec"), F.col("total_bytes").alias("original_bytes"), F.col("total_chars").alias("original_chars"), F.ceil(F.col("total_bits") / 8).cast("long").alias("compressed_bytes"))
    return ideal(metrics.char_counts(docs, text, group), "characters").unionByName(ideal(metrics.byte_counts(docs, text, group), "bytes")).unionByName(pairs)


def windowed(test: DataFrame, bits: DataFrame, context: int, group: str = "lang", text: str = "text") -> DataFrame:
    """Bits of the test part in windows of ``context`` ids: windows, tokens, bits for each of them, and the ratio to plain bytes.

    Windows overlap by an id, and the model sees one character back, so the bits
    are those of the whole sequence.
    """
    n = F.length(text)
    count = F.when(n >= 2, F.floor((n - 2) / (context - 1)) + 1).otherwise(0)
    sizes = test.where(n > 0).groupBy(group).agg(F.sum(count).cast("long").alias("windows"))
    both = ordered.beside(bits, sizes, [group])
    per = lambda c: F.round(F.col("total_bits") / F.col(c), 4)
    return both.select(group, "windows", F.col("total_chars").alias("total_tokens"), "total_bits", per("total_chars").alias("bits_per_token"), F.round(F.col("total_bytes") * 8 / F.col("total_bits"), 4).alias("compression_ratio"))


def sequential_bits(train: Sequence[str], test: Sequence[str]) -> float:
    """Bits of texts one character after another, as :func:`bits_per_char` sums them; to check it on small texts."""
    pairs: dict[tuple[str, str], int] = {}
    first: dict[str, int] = {}
    for t in train:
        for a, b in zip(t, t[1:]):
            pairs[a, b] = pairs.get((a, b), 0) + 1
            first[a] = first.get(a, 0) + 1
    size = len(set("".join([*train, *test])))
    total = 0.0
    for t in test:
        total += np.log2(size) if t else 0.0
        total -= sum(np.log2((pairs.get((a, b), 0) + 1) / (first.get(a, 0) + size)) for a, b in zip(t, t[1:]))
    return float(total)


def perplexity(bits: DataFrame, group: str = "lang") -> DataFrame:
    """Perplexity for each character, exp of the mean negative log likelihood."""
    return bits.select(group, F.round(F.pow(F.lit(2.0), F.col("total_bits") / F.col("total_chars")), 3).alias("perplexity"))


def generated(train: DataFrame, chars: int, seed: int = 42, group: str = "lang", text: str = "text") -> DataFrame:
    """A text of ``chars`` characters of each language, sampled from its bigrams; the same for the same seed. (group, text)"""
    learned = bigrams(train, text, group)
    kind = train.schema[group].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        random = np.random.default_rng(seed)
        table = {a: (g["b"].to_numpy(), np.cumsum(g["n"].to_numpy())) for a, g in pdf.sort_values(["a", "b"]).groupby("a")}
        starts = sorted(table)
        out = [starts[0]]
        for x in random.random(chars - 1):
            following, total = table.get(out[-1]) or table[starts[0]]
            out.append(following[np.searchsorted(total, x * total[-1], "right")])
        return pd.DataFrame({group: [pdf[group].iloc[0]], "text": ["".join(out)]})

    return learned.groupBy(group).applyInPandas(run, f"{group} {kind}, text string")


def learning_rate(step: DataFrame, rate: float, warmup: int, steps: int) -> DataFrame:
    """Linear warm-up and decay at each optimizer step, as an expression."""
    s = F.col("step")
    return step.withColumn("rate", F.when(s < warmup, s / warmup * rate).otherwise(F.greatest(F.lit(0.0), (F.lit(steps) - s) / F.lit(max(1, steps - warmup))) * rate))
