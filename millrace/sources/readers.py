"""Readers of the corpus formats, and writers between stages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T
from ..operators import sample

PAGE = S.StructType(
    [
        S.StructField("title", S.StringType()),
        S.StructField("revision", S.StructType([S.StructField("text", S.StructType([S.StructField("_VALUE", S.StringType()), S.StructField("_space", S.StringType())]))])),
    ]
)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that Spark reads is there and not empty."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p) and fs.getContentSummary(p).getLength() > 0)


def scratch(spark: SparkSession) -> str:
    """A path that is not there yet, in the session's ``spark.checkpoint.dir``, which all machines share; without one in a temporary folder, on a single machine only."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        shared = tempfile.mkdtemp(prefix="scratch-")
    return f"{shared}/{uuid.uuid4().hex}"


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table's folder was written to its end; what a killed job left is not complete."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def within_target(rows: DataFrame, target: int | None, text: str = "text") -> DataFrame:
    """Rows in the order in which they are read until their texts have ``target`` bytes, each with a blank line; the one that crosses it is in."""
    if target is None:
        return rows
    placed = rows.withColumns({"__place": F.monotonically_increasing_id(), "__all": F.lit(0), "__size": (F.octet_length(text) + 2).cast("long")})
    return sample.within_budget(placed, ["__all"], ["__place"], "__size", target).drop("__place", "__all", "__size")


def first_source(spark: SparkSession, candidates: Sequence[str]) -> str | None:
    """The first path that exists and is not empty; None is the caller's sign to skip."""
    return next((c for c in candidates if exists(spark, c)), None)


def wiki_articles(spark: SparkSession, path: str, longer_than: int = 50, target: int | None = None) -> DataFrame:
    """Plain text of the articles of a MediaWiki dump: (title, text), long ones before and after stripping, up to ``target`` bytes."""
    raw = spark.read.format("xml").option("rowTag", "page").schema(PAGE).load(path)
    pages = raw.select("title", F.col("revision.text._VALUE").alias("markup")).where(F.length("markup") > longer_than)
    return within_target(pages.select("title", T.strip_wiki_markup(F.col("markup")).alias("text")).where(F.length("text") > longer_than), target)


def tei_body(xml: bytes | str) -> str:
    """Text of a TEI document's body, of the whole document without one, empty if it can't be parsed."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return ""
    found = root.find(".//{http://www.tei-c.org/ns/1.0}body")
    found = root.find(".//body") if found is None else found
    return "\n".join(t.strip() for t in (root if found is None else found).itertext() if t.strip())


def tei_bodies(rows: DataFrame, key: str, xml: str) -> DataFrame:
    """Rows (key, text) of each document's body; a null document has an empty one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "text": ["" if c is None else tei_body(c) for c in f[xml]]})

    return rows.select(key, xml).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, text string")


def tei_texts(spark: SparkSession, plain: str | None, xml: str | None, longer_than: int = 100, target: int | None = None) -> DataFrame:
    """Texts of plain and XML editions, plain ones first: (source_ord, path, text), up to ``target`` bytes, so XML ones only if plain ones leave room."""
    parts = []
    if plain:
        rows = spark.read.text(plain, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
        parts.append(rows.select(F.lit(0).alias("source_ord"), "path", T.body_of_edition(F.col("value")).alias("text")))
    if xml:
        rows = tei_bodies(spark.read.format("binaryFile").load(xml).select("path", "content"), "path", "content")
        parts.append(rows.select(F.lit(1).alias("source_ord"), "path", T.body_of_edition(F.col("text")).alias("text")))
    if not parts:
        return spark.createDataFrame([], "source_ord int, path string, text string")
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return within_target(out.where(F.length("text") > longer_than), target)


def text_lines(spark: SparkSession, path: str, blank: bool = False) -> DataFrame:
    """Stripped lines of text files in order: (path, line_no, line); ids grow with the place in a file but have gaps."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line_no"), T.strip(F.make_valid_utf8("value")).alias("line"))
    return rows if blank else rows.where("line != ''")


def json_results(spark: SparkSession, candidates: Sequence[str], schema: str) -> DataFrame:
    """Result records of the first source that is there; none where all are missing, malformed ones as nulls.

    A folder holds JSON lines, as :func:`write_json` writes them; a file one record or an array of them.
    """
    path = first_source(spark, candidates)
    if path is None:
        return spark.createDataFrame([], schema)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    return spark.read.schema(schema).json(path, mode="PERMISSIVE", multiLine=not folder)


def document_stream(spark: SparkSession, path: str, schema: S.StructType | str) -> DataFrame:
    """Documents that arrive as Parquet files in a folder, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def write_wiki(pages: DataFrame, path: str, title: str, markup: str) -> None:
    """Pages as a MediaWiki dump that :func:`wiki_articles` reads."""
    text = F.struct(F.struct(F.col(markup).alias("_VALUE")).alias("text"))
    pages.select(F.col(title).cast("string").alias("title"), text.alias("revision")).write.format("xml").options(rootTag="mediawiki", rowTag="page").save(path)


def write_splits(rows: DataFrame, path: str) -> None:
    """Rows (lang, split, ...) as Parquet by language and split."""
    rows.write.mode("overwrite").partitionBy("lang", "split").parquet(path)


def export_text(rows: DataFrame, path: str, text: str = "text") -> None:
    """Texts with a blank line after each, as text files."""
    rows.select(F.concat(F.col(text), F.lit("\n"))).write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls left out; what was there goes."""
    rows.write.mode("overwrite").json(path)


def latest_checkpoint(spark: SparkSession, listing: DataFrame) -> DataFrame:
    """The path of greatest step, of (path) rows that end in step_N."""
    step = F.regexp_extract("path", r"step_(\d+)/?$", 1)
    return listing.where(step != "").agg(F.max_by("path", step.cast("long")).alias("path"), F.max(step.cast("long")).alias("step"))
