"""The stages of a corpus study, from raw files to reports, each a table in a folder.

A stage whose output exists is not run again unless asked to; a language without
any source is reported and skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CODEC_LEVELS, HYBRID_CODECS, MODEL_CHARS, SEED, ScriptSpec
from ..functions import text as T
from ..operators import coding, curate, metrics, ngram, ordered, report, sample, segment, tokenizers
from ..sources import readers


def read_sources(spark: SparkSession, lang: str, sources: Mapping[str, Sequence[str]], target: int) -> DataFrame | None:
    """Lines of a language's text sources, an equal share of ``target`` bytes each; None without any source.

    ``sources`` names candidates for each source in order of preference.
    """
    parts = []
    for k, (name, candidates) in enumerate(sources.items()):
        path = readers.first_source(spark, candidates)
        if path is None:
            print(f"{lang}: no file for {name}, skipped")
            continue
        rows = readers.text_lines(spark, path, blank=True)
        parts.append(rows.select(F.lit(k).cast("long").alias("doc_id"), F.lit(lang).alias("lang"), F.lit(name).alias("source"), "line_no", "line", (F.octet_length("line") + 1).cast("long").alias("size")))
    if not parts:
        return None
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    quota = target // len(parts)
    total = ordered.by_number(lines, ["source"], ["line_no"], F.col("size"), "_running")
    return total.where(F.col("_running") - F.col("size") < quota).drop("_running", "size")


def clean(lines: DataFrame, script: ScriptSpec, sequential: bool = True) -> DataFrame:
    """Paragraphs (lang, doc_id, first_line, text) of cleaned, deduplicated lines."""
    rows = curate.classify(lines, script)
    kept = curate.first_lines(rows.where("status = 'keep'"), "cleaned")
    marked = rows.where("status != 'keep'").unionByName(kept)  # duplicates leave no boundary
    paras = curate.paragraphs(marked, whole_files=True)
    if sequential:
        gone = curate.near_dedup_sequential(paras).where("duplicate").select("doc_id", "first_line")
        return paras.join(gone, ["doc_id", "first_line"], "left_anti")
    keyed = paras.withColumn("key", F.concat_ws("/", "doc_id", "first_line"))
    return curate.near_dedup_lsh(keyed, "key").drop("key")


def split(paras: DataFrame, target: int, ratio: float = 0.95, seed: int = SEED) -> DataFrame:
    """Paragraphs within the byte target, each marked for training or test."""
    docs = paras.select(F.concat_ws("/", "doc_id", "first_line").alias("doc_id"), "lang", "text", F.octet_length("text").cast("long").alias("size"))
    fits = sample.greedy_pack(docs.select("doc_id", "lang", "size"), target, seed=seed).select("doc_id")
    return sample.mark_split(docs.join(fits, "doc_id", "left_semi").drop("size"), ratio, seed)


def _part(docs: DataFrame, split: str) -> DataFrame:
    return docs.where(F.col("split") == split).select("doc_id", "lang", "text")


def _numbered(docs: DataFrame) -> DataFrame:
    """Documents with a number in place of their id, in the order of a digest of it: the same whatever their partitions."""
    return docs.withColumn("doc_id", F.xxhash64("doc_id"))


def benchmark(test: DataFrame) -> DataFrame:
    """Sizes under all codecs with times and errors, and the entropies, of each language's test part."""
    sizes = report.with_metrics(coding.compress_groups(_numbered(test), [*CODEC_LEVELS, *HYBRID_CODECS]))
    entropy = lambda counts, name: metrics.entropy(counts).select("lang", F.col("entropy").alias(name))
    return sizes.join(entropy(metrics.char_counts(test), "char_entropy"), "lang", "left").join(entropy(metrics.byte_counts(test), "byte_entropy"), "lang", "left")


def records(conditions: Mapping[str, Callable[[], DataFrame]], spark: SparkSession) -> DataFrame:
    """Bits of each language under each condition; a condition that fails is a record with its error.

    Conditions give (lang, total_chars, total_bytes, total_bits, bpc, bpb), a row a language.
    """
    schema = "condition string, lang string, total_chars long, total_bytes long, total_bits double, bpc double, bpb double, error string"
    names = ["lang", "total_chars", "total_bytes", "total_bits", "bpc", "bpb"]
    rows: list[tuple] = []
    for name, make in conditions.items():
        try:
            rows += [(name, *(r[c] for c in names), None) for r in make().select(*names).collect()]
        except Exception as e:  # noqa: BLE001 - any failure becomes a record
            rows.append((name, *[None] * len(names), str(e)[:200]))
    return spark.createDataFrame(rows, schema)


def compression(docs: DataFrame, classical_only: bool = False, chars: int = MODEL_CHARS) -> DataFrame:
    """Records of the classical codecs on the whole test part and of the n-gram model on its first ``chars`` characters, plain and in syllables."""
    train, test = _part(docs, "train"), _part(docs, "test")

    def classical(name: str) -> DataFrame:
        c = report.with_metrics(coding.compress_groups(_numbered(test), [name]))
        failed = c.where("error is not null").select("error").first()
        if failed:
            raise ValueError(failed["error"])
        return c.select("lang", F.col("original_chars").alias("total_chars"), F.col("original_bytes").alias("total_bytes"), (F.col("compressed_bytes") * 8.0).alias("total_bits"), "bpc", "bpb")

    conditions: dict[str, Callable[[], DataFrame]] = {name: (lambda name=name: classical(name)) for name in CODEC_LEVELS}
    if not classical_only:
        prefix = sample.corpus_ends(_numbered(test), chars, tail=False).select("lang", F.col("part").alias("text"))
        conditions["ngram"] = lambda: ngram.bits_per_char(train, prefix)
        mapping = segment.pua_map(segment.vocabulary_of(train.unionByName(test), F.col("text")))

        def mapped(rows: DataFrame) -> DataFrame:
            return segment.remap_text(rows, F.col("text"), mapping, keep=()).select("lang", F.col("remapped").alias("text"))

        def in_syllables() -> DataFrame:
            bits = ngram.bits_per_char(mapped(train), mapped(prefix)).select("lang", "total_bits")
            sizes = prefix.groupBy("lang").agg(F.sum(F.length("text")).alias("total_chars"), F.sum(F.octet_length("text")).alias("total_bytes"))
            per = lambda c: F.round(F.col("total_bits") / F.col(c), 4)
            return bits.join(sizes, "lang").withColumns({"bpc": per("total_chars"), "bpb": per("total_bytes")})

        conditions["ngram_syllables"] = in_syllables
    return records(conditions, docs.sparkSession)


def verified(docs: DataFrame, chars: int = MODEL_CHARS) -> DataFrame:
    """Whether the first test characters of each language come back from the arithmetic coder: (lang, documents, round_trips)."""
    prefix = sample.corpus_ends(_numbered(_part(docs, "test")), chars, tail=False).select("doc_id", "lang", F.col("part").alias("text"))
    coded = coding.arithmetic_round_trip(prefix).select("doc_id", "round_trip")
    return prefix.select("doc_id", "lang").join(coded, "doc_id").groupBy("lang").agg(F.count("*").alias("documents"), F.count_if("round_trip").alias("round_trips"))


def generated(docs: DataFrame, chars: int = MODEL_CHARS) -> DataFrame:
    """Codec sizes of a text that each language's bigrams generate."""
    made = ngram.generated(_part(docs, "train"), chars).withColumn("doc_id", F.lit(0).cast("long"))
    return report.with_metrics(coding.compress_groups(made, [*CODEC_LEVELS, *HYBRID_CODECS]))


def measure(docs: DataFrame) -> dict[str, DataFrame]:
    """Entropies, complexity and n-gram bits of the test split."""
    test = _part(docs, "test")
    return {
        "char_entropy": metrics.entropy(metrics.char_counts(test)),
        "byte_entropy": metrics.entropy(metrics.byte_counts(test)),
        "complexity": metrics.complexity(_numbered(test)),
        "ngram_bits": ngram.bits_per_char(_part(docs, "train"), test),
    }


def test_sentences(docs: DataFrame) -> DataFrame:
    """Sentences (lang, sentence) of the test split for tokenizers, white space as single blanks."""
    lines = curate.lines_of(_part(docs, "test").withColumn("source", F.lit(""))).withColumn("sentence", F.array_join(T.words(F.col("line")), " "))
    return lines.where(F.length("sentence") > 20).select("lang", "sentence")


def tokenizer_stage(docs: DataFrame, files: Mapping[str, str], training: tokenizers.Training = tokenizers.Training()) -> dict[str, DataFrame]:
    """Sweep over trained and given tokenizers, comparison with the baseline, and the ablation of split compounds."""
    train, sentences = _part(docs, "train"), test_sentences(docs)
    swept = tokenizers.sweep(train, sentences, dict(files) or None, training)
    return {"sweep": swept, "comparison": tokenizers.compared(swept), "sandhi_ablation": tokenizers.sandhi_ablation(train, sentences, training)}


def extension(docs: DataFrame, base: str | None, training: tokenizers.Training = tokenizers.Training()) -> DataFrame:
    """Pieces of several syllables that a base tokenizer (a file; single characters without one) splits: what to extend it by."""
    train = _part(docs, "train")
    mapping = tokenizers.corpus_mapping(train, F.col("text"))
    models = tokenizers.train_akshara(tokenizers.word_counts(train, F.col("text")), mapping, training)
    return tokenizers.novel_merges(tokenizers.vocabulary_pieces(models, mapping), tokenizers.load_file(base) if base else list)


def syllable_map(docs: DataFrame) -> DataFrame:
    """Private-use code points of the training split's syllables."""
    return tokenizers.corpus_mapping(_part(docs, "train"), F.col("text"))


def reports(measured: Mapping[str, DataFrame], benchmarks: DataFrame | None, compressed: DataFrame | None, swept: DataFrame | None = None) -> dict[str, DataFrame]:
    """Master table, comparison, rankings and markdown; codec sizes from the benchmark where it is there, else from the compression records."""
    first = benchmarks.select("lang", "codec", "ratio", "bpc", "bpb", "error") if benchmarks is not None else None
    second = None
    if compressed is not None:
        ratio = F.round(F.col("total_bytes") * 8 / F.col("total_bits"), 4).alias("ratio")
        second = compressed.where("lang is not null").select("lang", F.col("condition").alias("codec"), ratio, "bpc", "bpb", "error")
    codecs = report.preferred(first, second).drop("origin") if first is not None and second is not None else first if first is not None else second
    models = second.where("codec in ('ngram', 'ngram_syllables')") if second is not None else codecs.where("false")
    names = [*CODEC_LEVELS, *HYBRID_CODECS]
    best = report.best_codec(codecs, names)
    compared = report.comparison(measured["complexity"], best)
    out = {"master": report.master_table(codecs.where(F.col("codec").isin(names)).unionByName(models), [*names, "ngram", "ngram_syllables"]), "comparison": compared, "rankings": report.rankings(compared), "markdown": report.markdown(codecs.where(F.col("codec").isin(names) & F.col("error").isNull()))}
    return out | ({"tokenizer_markdown": report.markdown_tokenizers(swept.where("lang is not null"))} if swept is not None else {})


def stored(spark: SparkSession, path: str, make: Callable[[], DataFrame], again: bool = False) -> DataFrame:
    """The table at a path, made first where it is not there or was not written to its end."""
    if again or not readers.complete(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
