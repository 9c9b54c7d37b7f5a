"""Copies of a source's texts up to a byte target, to be resumed where they broke off."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sample
from . import readers

RETRIES = 5


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the texts that a folder of JSON lines has, each with its newline."""
    if not readers.exists(spark, path):
        return 0
    return spark.read.schema("text string").json(path).agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0


def copy_texts(spark: SparkSession, read: Callable[[], DataFrame], path: str, target: int, retries: int = RETRIES, pause: float = 1.0) -> bool:
    """Append (doc_id, text) rows of ``read()`` to a folder until it has ``target`` bytes, the last text cut to whole characters; whether it got there.

    A try that fails is repeated after a pause that grows with their number, and
    goes on behind what is stored.
    """
    for tried in range(retries + 1):
        done = stored_bytes(spark, path)
        if done >= target:
            return True
        try:
            rows = read().select("doc_id", F.lit("all").alias("lang"), "text")
            sample.exact_budget(rows, target, done).where("text != ''").select("text").write.mode("append").json(path)
            # a cut text may end a few bytes before the target
            return stored_bytes(spark, path) > target - 4
        except Exception as e:  # noqa: BLE001 - any failure of a source is tried again
            print(f"{path}: {str(e)[:200]}")
            if tried < retries:
                time.sleep(pause * (tried + 1))
    return False


def copy_all(spark: SparkSession, sources: Mapping[str, Callable[[], DataFrame]], folder: str, target: int, retries: int = RETRIES, pause: float = 1.0) -> DataFrame:
    """Copy each source and tell how it went: (source, status, bytes)."""
    rows = []
    for name, read in sources.items():
        ok = copy_texts(spark, read, f"{folder}/{name}", target, retries, pause)
        rows.append((name, "ok" if ok else "incomplete", stored_bytes(spark, f"{folder}/{name}")))
    return spark.createDataFrame(rows, "source string, status string, bytes long")
