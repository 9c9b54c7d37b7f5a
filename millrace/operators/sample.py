"""Budgets, samples and splits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import HOLDOUT_CHARS, HOLDOUT_TRAIN_CHARS, SAMPLE_SENTENCES, SEED, TRAIN_RATIO
from ..functions import text as T
from . import ordered
from .curate import lines_of

#: Rows that are packed one after another at the end of greedy packing.
PACK_ROWS = 200_000


def within_budget(rows: DataFrame, group: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """Rows in order until the budget is reached; the row that crosses it is in.  A null size counts as nothing."""
    own = F.coalesce(F.col(size), F.lit(0))
    total = ordered.by_number(rows, group, order, own, "__running", below=budget)
    return total.where(F.col("__running") - own < budget).drop("__running")


def quota_merge(lines: DataFrame, target: int, group: str = "lang", source: str = "source") -> DataFrame:
    """Lines of each source up to an equal share of the target, sources one after another.

    ``size`` is a line's bytes and its newline.
    """
    lines = lines.persist()  # slim rows, read three times
    number = lines.select(group, source).distinct().groupBy(group).agg(F.count("*").alias("__n"))
    total = ordered.by_number(lines, [group, source], ["doc_id", "line_no"], F.col("size"), "__running", below=target)
    quota = F.floor(F.lit(target) / F.col("__n"))
    return ordered.beside(total, number, [group]).where(F.col("__running") - F.col("size") < quota).drop("__running", "__n")


def greedy_pack(rows: DataFrame, budget: int, group: str = "lang", key: str = "doc_id", size: str = "size", seed: int = SEED) -> DataFrame:
    """Rows in random order that fit the budget, skipping those that don't.

    All rows before the first that does not fit are taken; what is left of the
    budget then rules out all larger rows, so the rest shrinks from round to
    round.  The last few rows are packed one by one.
    """
    # a row number makes the order one of rows, where ids repeat; it is fixed by being held
    digest = F.concat(ordered.order_digest(seed, key), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))
    left = rows.where(F.col(size).isNotNull()).select(group, key, size, digest.alias("__digest")).persist()
    kinds = rows.select(group, key, size).schema
    room = {r[group]: budget for r in left.select(group).distinct().collect()}  # one row a language
    spark = rows.sparkSession
    taken = spark.createDataFrame([], kinds)
    gap = lambda: spark.createDataFrame([(g, r) for g, r in room.items()], rows.select(group).schema.add("__room", "long"))
    while room:
        left = ordered.beside(left, F.broadcast(gap()), [group]).where(F.col(size) <= F.col("__room")).drop("__room").persist()
        if left.count() <= PACK_ROWS:
            break
        total = ordered.beside(ordered.by_hash(left, [group], "__digest", F.col(size), "__running", key), F.broadcast(gap()), [group])
        over = total.where(F.col("__running") > F.col("__room")).groupBy(group).agg(F.min("__digest").alias("__stop"))
        stops = F.broadcast(gap().drop("__room").join(over.withColumnRenamed(group, "__g"), F.col(group).eqNullSafe(F.col("__g")), "left").drop("__g"))
        cut = ordered.beside(left, stops, [group])
        now = cut.where(F.col("__stop").isNull() | (F.col("__digest") < F.col("__stop"))).select(group, key, size).persist()
        taken = taken.unionByName(now)
        used = {r[group]: r["s"] for r in now.groupBy(group).agg(F.sum(size).alias("s")).collect()}
        room = {g: r - used.get(g, 0) for g, r in room.items()}
        left = cut.where(F.col("__digest") > F.col("__stop")).drop("__stop").persist()
    rest = dict(room)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__digest")
        name = pdf[group].iloc[0]
        space, keep = rest[None if pd.isna(name) else name], []
        for s in pdf[size]:
            fits = s <= space
            keep.append(fits)
            space -= s if fits else 0
        return pdf.loc[keep, [group, key, size]]

    return taken.unionByName(left.groupBy(group).applyInPandas(pack, kinds))


def train_test_split(docs: DataFrame, ratio: float = TRAIN_RATIO, seed: int = SEED, group: str = "lang", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row's split: exactly floor(ratio * n) rows of a group for training, at random; a null group is a group.

    Columns ``keep`` come along; they should be slim.
    """
    slim = docs.select(key, group, *keep).withColumn("__digest", ordered.order_digest(seed, key))
    ranked = ordered.by_hash(slim, [group], "__digest", F.lit(1), "__rank", key)
    number = slim.groupBy(group).agg(F.count("*").alias("__n"))
    train = F.col("__rank") <= F.floor(F.lit(ratio) * F.col("__n"))
    return ordered.beside(ranked, F.broadcast(number), [group]).select(key, group, *keep, F.when(train, "train").otherwise("test").alias("split"))  # one row a group


def mark_split(docs: DataFrame, ratio: float = TRAIN_RATIO, seed: int = SEED, group: str = "lang", key: str = "doc_id") -> DataFrame:
    """Documents with their split beside all their columns, in place: only the last id for training of each group is looked up.

    Rows that repeat an id stay together.
    """
    split = train_test_split(docs, ratio, seed, group, key)
    at = F.struct(ordered.order_digest(seed, key).alias("d"), F.col(key).alias("k"))
    last = split.groupBy(group).agg(F.max(F.when(F.col("split") == "train", at)).alias("__last"))
    marked = ordered.beside(docs, F.broadcast(last), [group])  # one row a group
    return marked.withColumn("split", F.when(at <= F.col("__last"), "train").otherwise("test")).drop("__last")


def corpus_ends(docs: DataFrame, chars: int, tail: bool, group: str = "lang") -> DataFrame:
    """The part of each document that lies in the first or last ``chars`` characters of its language; null texts have none."""
    sized = docs.where("text is not null").select("doc_id", group, "text", F.length("text").cast("long").alias("__chars"))
    total = ordered.by_number(sized, [group], ["doc_id"], F.col("__chars"), "__running", reverse=tail, below=chars)
    inside = total.withColumn("__take", F.least(F.col("__chars"), F.lit(chars) - (F.col("__running") - F.col("__chars")))).where("__take > 0")
    cut = F.right("text", F.col("__take")) if tail else F.substring(F.col("text"), F.lit(1), F.col("__take").cast("int"))
    return inside.select("doc_id", group, F.col("__take").alias("chars"), cut.alias("part"))


def holdout(docs: DataFrame, tail: int = HOLDOUT_CHARS, most: int = HOLDOUT_TRAIN_CHARS, group: str = "lang") -> DataFrame:
    """The last ``tail`` characters of each language for evaluation, those before them (at most the first ``most``) for training.

    Gives (doc_id, group, part, chars, text).  A language of no more than
    ``tail`` characters has no part for evaluation; all of it trains.
    """
    sized = docs.where("text is not null").select("doc_id", group, "text", F.length("text").cast("long").alias("__chars"))
    whole = sized.groupBy(group).agg(F.sum("__chars").alias("__whole"))
    total = ordered.beside(ordered.by_number(sized, [group], ["doc_id"], F.col("__chars"), "__running"), F.broadcast(whole), [group])
    begin, end = F.col("__running") - F.col("__chars"), F.col("__running")
    cut = F.when(F.col("__whole") > tail, F.col("__whole") - tail).otherwise(F.col("__whole"))
    train_end = F.least(cut, F.lit(most))
    part = lambda name, low, high: F.struct(F.lit(name).alias("part"), F.greatest(low - begin, F.lit(0)).alias("from"), (F.least(high, end) - F.greatest(low, begin)).alias("chars"))
    each = total.select("doc_id", group, "text", F.explode(F.array(part("train", F.lit(0).cast("long"), train_end), part("eval", cut, F.col("__whole")))).alias("p")).where("p.chars > 0")
    piece = F.substring(F.col("text"), (F.col("p.from") + 1).cast("int"), F.col("p.chars").cast("int"))
    return each.select("doc_id", group, "p.part", "p.chars", piece.alias("text"))


def sample_sentences(docs: DataFrame, split: DataFrame, limit: int = SAMPLE_SENTENCES, longer_than: int = 20) -> DataFrame:
    """The first lines of each language's test documents, of its training documents if it has no test lines."""
    lines = lines_of(docs).withColumn("sentence", T.strip(F.col("line"))).where(F.length("sentence") > longer_than)
    marked = lines.join(split.select("doc_id", "split").distinct(), "doc_id").select("lang", "doc_id", "line_no", "sentence", "split")
    chosen = marked.groupBy("lang").agg(F.min("split").alias("split"))  # test comes before train
    rows = ordered.beside(marked, F.broadcast(chosen.withColumnRenamed("split", "__chosen")), ["lang"]).where(F.col("split") == F.col("__chosen")).drop("__chosen")
    return ordered.by_number(rows, ["lang"], ["doc_id", "line_no"], F.lit(1), "rank", below=limit).where(F.col("rank") <= limit)


def exact_budget(docs: DataFrame, target: int, done: int = 0, group: str = "lang", text: str = "text") -> DataFrame:
    """Texts in order until a group has ``target`` bytes, ``done`` of them from an earlier run; the last is cut to whole characters.

    Each text counts with a newline.  Rows before ``done`` bytes are skipped, so
    a broken copy can go on where it stopped.
    """
    sized = docs.where(F.col(text).isNotNull()).select("doc_id", group, text, (F.octet_length(text) + 1).cast("long").alias("__size"))
    total = ordered.by_number(sized, [group], ["doc_id"], F.col("__size"), "__running", below=target)
    before = F.col("__running") - F.col("__size")
    rows = total.where((before >= done) & (before < target)).withColumn("__room", F.lit(target) - before)
    whole = F.when(F.col("__size") <= F.col("__room"), F.col(text)).otherwise(T.utf8_prefix(F.col(text), F.col("__room")))
    return rows.select("doc_id", group, whole.alias(text))
