"""Syllable segmentation, private-use code points, and vocabularies of pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import PRIVATE_USE, SPACE_MARK
from ..functions import arrays
from ..functions import text as T


def segments(docs: DataFrame, text: Column, group: str = "lang") -> DataFrame:
    """Segments of each document as an array."""
    return docs.select("doc_id", group, T.aksharas(text).alias("segments"))


def akshara_vocabulary(segmented: DataFrame, group: str = "lang") -> DataFrame:
    """Distinct segments that get a code point of their own, and how often each occurs."""
    each = segmented.select(group, F.explode("segments").alias("akshara"))
    return each.where(T.is_akshara(F.col("akshara"))).groupBy(group, "akshara").agg(F.count("*").alias("n"))


def _counted(docs: DataFrame, text: Column, group: str, name: str, count: Callable[[pa.Array, pa.Array], tuple]) -> DataFrame:
    """Counts of what texts are made of, on Arrow arrays: each few megabytes of text give a piece about once."""
    kind = docs.schema[group].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = pa.schema([b.schema.field(group), (name, pa.string()), ("n", pa.int64())])
            texts, groups = b.column("__text"), b.column(group)
            for i, j in arrays.slices(texts):
                columns = count(texts.slice(i, j - i), groups.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    each = docs.select(group, text.alias("__text")).mapInArrow(run, f"{group} {kind}, {name} string, n long")
    return each.groupBy(group, name).agg(F.sum("n").alias("n"))


def vocabulary_of(docs: DataFrame, text: Column, group: str = "lang") -> DataFrame:
    """:func:`akshara_vocabulary` of texts."""
    return _counted(docs, text, group, "akshara", lambda t, g: arrays.segment_counts(t, g, SPACE_MARK)).where(T.is_akshara(F.col("akshara")))


def pua_map(vocabulary: DataFrame, group: str = "lang") -> DataFrame:
    """Code points of syllables, given in code point order of the syllables.

    Raises when a code point is asked for beyond the private use ranges.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy("akshara")) - 1
    point = F.raise_error("private use code points are used up").cast("long")
    before = sum(high - low + 1 for low, high in PRIVATE_USE)
    for low, high in reversed(PRIVATE_USE):
        before -= high - low + 1
        point = F.when(F.col("_rank") < before + high - low + 1, F.col("_rank") - before + low).otherwise(point)
    ranked = vocabulary.select(group, "akshara").withColumn("_rank", rank)
    return ranked.select(group, "akshara", point.cast("long").alias("cp"))


def load_map(spark: SparkSession, path: str, group: str = "lang") -> DataFrame:
    """A stored map; raises if two syllables of a language share a code point."""
    mapping = spark.read.schema(f"{group} string, akshara string, cp long").json(path)
    if mapping.groupBy(group, "cp").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        raise ValueError(f"{path}: a code point stands for two syllables")
    return mapping


def held(mapping: DataFrame) -> DataFrame:
    """A map that is computed once, however often it is used: at most as many rows a language as there are private use code points."""
    return mapping.sparkSession.createDataFrame(mapping.collect(), mapping.schema)


def _table(mapping: DataFrame, group: str) -> dict[str, dict[str, str]]:
    """The characters of each language's syllables: at most as many as there are private use code points."""
    out: dict[str, dict[str, str]] = {}
    for r in mapping.collect():
        out.setdefault(r[group], {})[r["akshara"]] = chr(r["cp"])
    return out


def remap(segmented: DataFrame, mapping: DataFrame, group: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """Text in which each mapped segment is one private use character; a space mark is a space again.

    Columns ``keep`` come along.

    A lookup in a SQL map walks through its entries; here it is a hash lookup in
    Arrow batches.
    """
    table = segmented.sparkSession.sparkContext.broadcast({g: {SPACE_MARK: " "} | m for g, m in _table(mapping, group).items()})

    @F.pandas_udf("string")
    def joined(segments: pd.Series, groups: pd.Series) -> pd.Series:
        plain = {SPACE_MARK: " "}
        maps = [table.value.get(g, plain) for g in groups]
        return pd.Series([None if s is None else "".join([m.get(x, x) for x in s]) for s, m in zip(segments, maps)], dtype=object)

    return segmented.select("doc_id", group, *keep, joined("segments", group).alias("remapped"))


def remap_text(docs: DataFrame, text: Column, mapping: DataFrame, group: str = "lang", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """:func:`remap` of texts, on Arrow arrays: (keep, group, remapped)."""
    plain = {SPACE_MARK: " "}
    table = docs.sparkSession.sparkContext.broadcast({g: plain | m for g, m in _table(mapping, group).items()})
    joined = F.arrow_udf(lambda t, g: pa.concat_arrays([arrays.mapped(t.slice(i, j - i), g.slice(i, j - i), table.value, plain).cast(pa.string()) for i, j in arrays.slices(t)] or [pa.array([], pa.string())]), "string")
    return docs.select(*keep, group, joined(text, F.col(group)).alias("remapped"))


def unmap(remapped: DataFrame, mapping: DataFrame, group: str = "lang") -> DataFrame:
    """The text that was remapped."""
    table = remapped.sparkSession.sparkContext.broadcast({g: {ord(c): a for a, c in m.items()} for g, m in _table(mapping, group).items()})

    @F.pandas_udf("string")
    def back(text: pd.Series, groups: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else t.translate(table.value.get(g, {})) for t, g in zip(text, groups)], dtype=object)

    return remapped.select("doc_id", group, back("remapped", group).alias("text"))


def word_frequencies(docs: DataFrame, text: Column, group: str = "lang") -> DataFrame:
    """Words between white space and how often each occurs in each language; a null text has none."""
    return _counted(docs, text, group, "word", arrays.word_counts)


def pair_counts(symbols: DataFrame, group: str = "lang") -> DataFrame:
    """Counts of adjacent symbols, each word's times its frequency: (lang, a, b, n) of (lang, symbols, n)."""
    last = F.size("symbols")
    pairs = F.zip_with(F.slice("symbols", 1, F.greatest(last - 1, F.lit(0))), F.slice("symbols", 2, F.greatest(last, F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    each = symbols.where(last > 1).select(group, "n", F.explode(F.filter(pairs, lambda p: p["b"].isNotNull())).alias("p"))
    return each.groupBy(group, F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("n").alias("n"))


def merge_pair(symbols: Column, a: str, b: str) -> Column:
    """Symbols with each leftmost occurrence of a pair joined."""
    empty = F.array().cast("array<string>")

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        join = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) == a) & (s == b)
        return F.when(join, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, s)))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(symbols, empty, lambda done, s: F.when(F.size(done) == 0, F.array(s)).otherwise(step(done, s)))


def train_merges(words: DataFrame, merges: int, every: int = 20) -> list[tuple[str, str]]:
    """Byte-pair merges learned from (word, n): the most frequent pair first, ties by text.

    Only the word table is rewritten; one pair a round comes to the driver.  Each
    round's table is held, so that a round does not repeat those before it; its
    lineage is cut by a checkpoint after each few rounds where a folder is set.
    """
    spark = words.sparkSession
    table = words.select(F.lit("all").alias("lang"), F.split("word", "").alias("symbols"), "n").persist()
    found: list[tuple[str, str]] = []
    for i in range(merges):
        best = pair_counts(table).orderBy(F.desc("n"), "a", "b").limit(1).collect()
        if not best or best[0]["n"] < 2:
            break
        a, b = best[0]["a"], best[0]["b"]
        found.append((a, b))
        held = table
        table = table.withColumn("symbols", F.when(F.array_contains("symbols", a), merge_pair(F.col("symbols"), a, b)).otherwise(F.col("symbols"))).persist()
        table.count()
        held.unpersist()
        if i % every == every - 1 and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            table = table.checkpoint()
    return found


def novel_pieces(pieces: DataFrame, base: DataFrame, min_aksharas: int = 2, limit: int = 4000) -> DataFrame:
    """Pieces of several syllables that the base vocabulary does not have as one token, longest first.

    ``pieces`` and ``base`` have a column piece; a top-k report of ``limit`` rows.
    """
    counted = pieces.select("piece", F.size(T.aksharas(F.col("piece"))).cast("long").alias("aksharas")).where(F.col("aksharas") >= min_aksharas)
    return counted.join(base.select("piece").distinct(), "piece", "left_anti").dropDuplicates(["piece"]).orderBy(F.desc("aksharas"), "piece").limit(limit)


def token_blocks(ids: Column, size: int) -> Column:
    """Blocks of ``size`` ids; what is left over at the end is dropped."""
    empty = F.array().cast("array<array<int>>")

    def cut(x: Column) -> Column:
        number = F.floor(F.size(x) / size).cast("int")
        return F.when(number > 0, F.transform(F.sequence(F.lit(0), number - 1), lambda i: F.slice(x, i * size + 1, size))).otherwise(empty)

    return T.let(ids, cut)


def score_windows(ids: Column, context: int) -> Column:
    """Windows of ``context`` ids, each beginning with the last id of the one before."""
    empty = F.array().cast("array<array<int>>")

    def cut(x: Column) -> Column:
        n = F.size(x)
        return F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 2, F.lit(context - 1)), lambda s: F.slice(x, s + 1, context))).otherwise(empty)

    return T.let(ids, cut)


def context_start(position: Column, context: int) -> Column:
    """Where the context of an id begins if it grows to twice ``context`` ids and is then cut back to ``context``."""
    reset = F.floor((position - 2 * context - 1) / (context + 1)) + 1
    return F.when(position <= 2 * context, F.lit(0)).otherwise(reset * (context + 1)).cast("long")


def code_points(text: Column) -> Column:
    """Code points of a text as ids."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
