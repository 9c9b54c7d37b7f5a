"""Curation of documents that arrive as a stream.

An extension of the batch operators: lines are cleaned without state, and exact
duplicates are dropped against a state that a watermark bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEVANAGARI, ScriptSpec
from ..operators.curate import classify, lines_of


def clean_stream(docs: DataFrame, script: ScriptSpec = DEVANAGARI) -> DataFrame:
    """Kept lines of streamed documents."""
    return classify(lines_of(docs), script).where("status = 'keep'").select("doc_id", "lang", "source", "line_no", "cleaned")


def distinct_stream(lines: DataFrame, delay: str = "1 hour", time: str = "arrived") -> DataFrame:
    """Lines without repeats of the last ``delay``; ``lines`` has a time column."""
    keyed = lines.withColumn("line_md5", F.md5("cleaned"))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["lang", "line_md5"])


def volume(events: DataFrame, time: str, text: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Texts and characters of each time window, late rows within the delay included."""
    return events.withWatermark(time, delay).groupBy(F.window(time, window)).agg(F.count("*").alias("texts"), F.sum(F.length(text)).alias("chars"))


def run_available(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write all that has arrived so far to Parquet, then stop; a later call goes on from there."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
