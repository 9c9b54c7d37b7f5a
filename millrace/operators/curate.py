"""Curation of documents as lines: cleaning, filters, exact and near dedup, paragraphs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEVANAGARI, PURITY_LINES, NearDedup, ScriptSpec
from ..functions import arrays
from ..functions import text as T
from . import ordered


#: Estimated bytes for each core below which a table is dealt anew.
SMALL = 32 << 20


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to all cores where the input is so small that a scan gives few tasks; large inputs stay as they are.

    The optimizer's estimate decides; nothing is run for it.
    """
    if rows.isStreaming:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if ordered.estimated_bytes(rows) < cores * SMALL else rows


def lines_of(docs: DataFrame) -> DataFrame:
    """Lines of documents with their place; a null text has none, an empty one has one empty line."""
    rows = docs.select("doc_id", "lang", "source", "text")
    return spread(rows, "doc_id").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def classify(lines: DataFrame, script: ScriptSpec = DEVANAGARI) -> DataFrame:
    """Lines with their cleaned form and what becomes of them.

    Both come out of one generator, so a filter on the status does not clean
    each line a second time.
    """
    both = T.let(T.clean_line(F.col("line"), script), lambda c: F.struct(c.alias("cleaned"), T.line_status(c, script).alias("status")))
    return lines.select("*", F.explode(F.array(both)).alias("_both")).select(*lines.columns, "_both.cleaned", "_both.status")


def kept_lines(docs: DataFrame, script: ScriptSpec = DEVANAGARI) -> DataFrame:
    """Lines that cleaning keeps, with their cleaned form."""
    return classify(lines_of(docs), script).where("status = 'keep'")


def first_lines(lines: DataFrame, line: str = "line", group: str = "lang") -> DataFrame:
    """The first of equal lines within a language; blank lines all stay, null lines go.

    The first is found by an aggregation of places, which combines before its
    shuffle, so a very common line is one row for each task.
    """
    marked = lines.withColumn("__line_key", F.md5(F.col(line)))
    place = F.struct("doc_id", "line_no")
    first = marked.where(F.col(line) != "").groupBy(group, "__line_key").agg(F.min(place).alias("x"))
    stay = first.select(F.col(group).alias("__g"), F.col("__line_key").alias("__k"), F.col("x.doc_id").alias("__d"), F.col("x.line_no").alias("__n"))
    on = F.col(group).eqNullSafe(F.col("__g")) & (F.col("__line_key") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("line_no").eqNullSafe(F.col("__n"))
    # rows that repeat an id and a place as well are one line
    unique = marked.join(stay, on, "left_semi").dropDuplicates([group, "__line_key"])
    return unique.drop("__line_key").unionByName(lines.where(F.col(line) == ""))


def clean_stats(docs: DataFrame, script: ScriptSpec = DEVANAGARI) -> DataFrame:
    """Counters of the cleaning stage by language."""
    lines = classify(lines_of(docs), script)
    keep = F.col("status") == "keep"
    size = lambda c: (F.octet_length(c) + 1).cast("long")
    # lines are cleaned once: those kept are counted by their digest, others together
    each = lines.groupBy("lang", F.when(keep, F.md5("cleaned")).alias("k")).agg(
        F.count("*").alias("raw"),
        F.max(F.length("line")).cast("long").alias("longest"),
        F.count_if(F.length("line") > script.max_line).alias("cut"),
        F.count_if(F.col("status") == "script").alias("script"),
        F.count_if(F.col("status") == "short").alias("short"),
        F.sum(size("line")).alias("bytes"),
        F.max(F.when(keep, size("cleaned"))).alias("clean"),
    )
    mb = lambda c: F.round(F.sum(c) / (1024 * 1024), 4)
    # lines without a language count as rejected or kept, but as no final ones
    known = F.col("k").isNotNull() & F.col("lang").isNotNull()
    counts = each.groupBy("lang").agg(
        F.sum("raw").alias("raw_lines"),
        F.max("longest").alias("longest_raw_line_chars"),
        F.sum("cut").alias("truncated_lines"),
        F.sum("script").alias("rejected_script"),
        F.sum("short").alias("rejected_short"),
        mb(F.col("bytes")).alias("raw_size_mb"),
        F.count_if(known).alias("final_lines"),
        mb(F.when(known, F.col("clean"))).alias("clean_size_mb"),
        F.coalesce(F.sum(F.when(F.col("k").isNotNull(), F.col("raw"))), F.lit(0)).alias("kept_lines"),
    )
    return counts.withColumn("exact_duplicates", F.col("kept_lines") - F.col("final_lines")).drop("kept_lines")


def script_purity(docs: DataFrame, script: ScriptSpec, limit: int = PURITY_LINES) -> DataFrame:
    """Mean script ratio of each language's first kept lines, and whether less than 1 % is foreign."""
    ratio = T.script_ratio(F.col("cleaned"), script).alias("ratio")
    kept = kept_lines(docs, script).select("lang", "doc_id", "line_no", ratio).persist()  # slim rows, read three times
    ranked = ordered.by_number(kept, ["lang"], ["doc_id", "line_no"], F.lit(1), "rank", below=limit).where(F.col("rank") <= limit)
    foreign = F.round(1 - F.avg("ratio"), 4)
    return ranked.groupBy("lang").agg(F.count("*").alias("lines"), foreign.alias("foreign_share"), F.when(foreign < 0.01, "PASS").otherwise("WARN").alias("verdict"))


def long_lines(docs: DataFrame, threshold: int, limit: int = 20) -> DataFrame:
    """The first lines over a length, with a preview."""
    found = lines_of(docs).where(F.length("line") > threshold)
    return found.orderBy("doc_id", "line_no").limit(limit).select("doc_id", "line_no", F.length("line").cast("long").alias("chars"), F.substring("line", 1, 100).alias("preview"))


def paragraphs(classified: DataFrame, by: str = "doc_id", whole_files: bool = False) -> DataFrame:
    """Runs of kept lines between others: (doc_id, lang, first_line, n_lines, text).

    Islands are numbered within a document.  A document's lines are ordered in
    one task, or, with ``whole_files``, where a document is a file of any size, in
    ranges of lines.
    """
    broken = (F.col("status") != "keep").cast("int")
    if whole_files:
        numbered = ordered.by_number(classified, ["lang", by], ["line_no"], broken, "__island")
    else:
        w = Window.partitionBy(by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        numbered = classified.withColumn("__island", F.sum(broken).over(w))
    listed = F.array_sort(F.collect_list(F.struct("line_no", "cleaned")))
    grouped = numbered.where("status = 'keep'").groupBy("doc_id", "lang", "__island").agg(listed.alias("x"), F.min("line_no").alias("first_line"))
    return grouped.select("doc_id", "lang", "first_line", F.size("x").cast("long").alias("n_lines"), F.array_join(F.transform("x", lambda s: s["cleaned"]), "\n").alias("text"))


#: Bytes of texts that are signed together.
SIGNED_TOGETHER = 4 << 20


def signatures(rows: DataFrame, key: str = "doc_id", text: str = "text", spec: NearDedup = NearDedup()) -> DataFrame:
    """MinHash signatures: each slice of texts hashes its distinct shingles once; rows of one key are signed together."""
    bodies = spread(rows.where(F.length(text) >= spec.min_chars).select(key, T.head_and_tail(F.col(text), spec.max_chars).alias("s")), key)
    kind = rows.schema[key].dataType.simpleString()
    names = [f"m{i}" for i in range(spec.hashes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = pa.schema([b.schema.field(key), *[(n, pa.int64()) for n in names]])
            for i, j in arrays.slices(b.column("s"), SIGNED_TOGETHER):
                least = arrays.least_values(b.column("s").slice(i, j - i), spec.ngram, spec.coefficients(), spec.prime)
                yield pa.RecordBatch.from_arrays([b.column(key).slice(i, j - i), *[pa.array(x) for x in least]], schema=schema)

    each = bodies.mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{n} long" for n in names))
    return each.groupBy(key).agg(*[F.min(n).alias(n) for n in names]).select(key, F.array(*names).alias("signature"))


def signature_pairs(signed: DataFrame, key: str = "doc_id", spec: NearDedup = NearDedup()) -> DataFrame:
    """Pairs whose signatures agree in enough places, found by equal bands.

    At the reference threshold some band always agrees, so no pair is missed.
    Rows of equal signatures meet through one representative, its number of
    members is in ``twins``.
    """
    rows = spec.hashes // spec.bands
    groups = signed.groupBy("signature").agg(F.min(key).alias("id"), F.count("*").alias("twins"))
    band = F.transform(F.sequence(F.lit(0), F.lit(spec.bands - 1)), lambda i: F.xxhash64(i, F.slice("signature", i * rows + 1, rows)))
    banded = groups.select("id", "signature", F.explode(band).alias("band"))
    a, b = banded.alias("a"), banded.alias("b")
    met = a.join(b, F.expr("a.band = b.band and a.id < b.id")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), T.signature_matches(F.col("a.signature"), F.col("b.signature")).alias("matches"))
    return met.where(F.col("matches") >= spec.matches).distinct()


def signature_classes(signed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows with the least id of those with an equal signature."""
    least = signed.groupBy("signature").agg(F.min(key).alias("representative"))
    return signed.join(least, "signature").select(key, "representative")


#: Classes of a band up to which bands are compared many at a time.
FEW = 32


def beaten_classes(signed: DataFrame, key: str = "doc_id", spec: NearDedup = NearDedup(), block: int = 256) -> DataFrame:
    """Representatives (representative) of equal signatures that have a near class of lesser id.

    Bands of few classes are a row each and are compared in arrays, thousands at
    a time.  Others are compared in blocks of ``block`` classes, each two blocks in a group;
    a group puts out a class once at most, so a very common band costs no pairs.
    """
    rows = spec.hashes // spec.bands
    classes = signed.groupBy("signature").agg(F.min(key).alias("id"))
    band = F.transform(F.sequence(F.lit(0), F.lit(spec.bands - 1)), lambda i: F.xxhash64(i, F.slice("signature", i * rows + 1, rows)))
    banded = classes.select("id", "signature", F.explode(band).alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    sized = banded.join(shared, "band")
    kind = signed.schema[key].dataType.simpleString()
    need = spec.matches
    last = F.col("id").isNull().alias("null")  # a null id comes last
    few = sized.where(F.col("size") <= FEW).groupBy("band").agg(F.array_sort(F.collect_list(F.struct(last, "id", "signature"))).alias("x"))
    few = few.select(F.col("x.id").alias("id"), F.flatten("x.signature").alias("flat"))

    def of_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            ids, flat = b.column("id"), b.column("flat").flatten().to_numpy(zero_copy_only=False).reshape(-1, spec.hashes)
            sizes = ids.value_lengths().to_numpy(zero_copy_only=False)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            near = np.zeros(len(flat), bool)
            for back in range(1, int(sizes.max(initial=0))):
                i = np.flatnonzero((place >= back) & ~near)
                near[i] = (flat[i] == flat[i - back]).sum(1) >= need
            found = ids.flatten().filter(pa.array(near))
            yield pa.RecordBatch.from_arrays([found], names=["representative"])

    dealt = sized.where(F.col("size") > FEW).withColumn("n", F.ceil(F.col("size") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values("id")
        signatures = np.stack(pdf["signature"].to_list())
        near = [bool(((signatures[:i] == signatures[i]).sum(1) >= need).any()) for i in range(1, len(pdf))]
        return pd.DataFrame({"representative": pdf["id"].to_numpy()[1:][near]})

    many = met.select("id", "signature", "band", "low", "high").groupBy("band", "low", "high").applyInPandas(run, f"representative {kind}")
    return few.mapInArrow(of_bands, f"representative {kind}").union(many).distinct()


def near_dedup_lsh(rows: DataFrame, key: str = "doc_id", text: str = "text", spec: NearDedup = NearDedup()) -> DataFrame:
    """Rows without a near duplicate of lesser id; short and null texts are not compared.

    Rows of one id are one document, whose shingles are taken together.
    """
    signed = signatures(rows, key, text, spec).persist()  # slim rows, read three times
    classes = signature_classes(signed, key)
    gone = classes.join(beaten_classes(signed, key, spec), "representative", "left_semi").select(key).union(classes.where(F.col(key) != F.col("representative")).select(key))
    return rows.join(gone.distinct(), key, "left_anti")


def near_dedup_stats(rows: DataFrame, group: str = "lang", key: str = "doc_id") -> DataFrame:
    """Documents of each language and how many of them are near duplicates of others."""
    kept = near_dedup_lsh(rows, key).groupBy(group).agg(F.count("*").alias("__kept"))
    counted = rows.groupBy(group).agg(F.count("*").alias("documents"))
    joined = counted.join(kept.withColumnRenamed(group, "__g"), F.col(group).eqNullSafe(F.col("__g")), "left")
    return joined.select(group, "documents", (F.col("documents") - F.coalesce("__kept", F.lit(0))).alias("near_duplicates"))


def near_dedup_sequential(paras: DataFrame, spec: NearDedup = NearDedup(), group: str = "lang", order: tuple[str, ...] = ("doc_id", "first_line")) -> DataFrame:
    """Greedy near-dedup in order: a paragraph goes if it is near one of the last ``window`` kept ones.

    What is kept depends on what was kept before, so a group is one task; only
    signatures and places go there, not texts.
    """
    width = spec.window
    need = spec.matches
    names = list(order)
    keyed = paras.withColumn("_id", F.concat_ws("/", *names))
    signed = signatures(keyed, "_id", "text", spec)
    rows = keyed.select("_id", group, *names, F.length("text").alias("chars")).join(signed, "_id", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        recent, kept = np.zeros((width, spec.hashes), np.int64), 0  # the last kept ones, in a ring
        pdf = pdf.sort_values(names)
        dup = []
        for s in pdf["signature"]:
            if s is None:
                dup.append(False)
                continue
            v = np.asarray(s)
            near = kept > 0 and int((recent[: min(kept, width)] == v).sum(1).max()) >= need
            dup.append(near)
            if not near:
                recent[kept % width] = v
                kept += 1
        return pd.DataFrame({group: pdf[group], **{n: pdf[n] for n in names}, "duplicate": dup})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(group, *names).schema) + ", duplicate boolean"
    return rows.groupBy(group).applyInPandas(run, schema)


def devanagari(text: Column) -> Column:
    """A Devanagari text by rule from a Latin one, for tables without any."""
    return T.translate(F.lower(text), "abcdefghijklmnopqrstuvwxyz", "ाबचदेफग्िजकलमनोपटरसतुवंःयड")
