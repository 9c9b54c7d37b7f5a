"""Sharding: contiguous shards of nearly equal bytes.

Rows are ordered by id over range partitions.  Each partition's total of bytes
and rows goes to the driver (one row a partition), whose prefix sums give every
partition its global offset; a row's own offset is that plus the running sum
inside its partition.  The line of all bytes is cut at equal targets, and a row
belongs to the shard in which the middle of its bytes falls.  Texts are never
moved: only id, size and checksum are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import checkpoint, shuffle_width


def sized(docs: DataFrame, overhead: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, bytes and checksum of each row; a null text has no bytes."""
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(raw).cast("long") + F.lit(overhead)).alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )


def byte_shards(rows: DataFrame, shards: int = 40) -> DataFrame:
    """Cut rows (doc_id, size, text_crc32) into contiguous shards of nearly equal size.

    Order: doc_id (nulls first), checksum, size, then place in the input, so
    repeated rows and ids are spread like any others.  Adds shard (0 to
    shards - 1), slot (place in the shard, from 0 without gaps), law and
    grown_shard (null: this law moves rows when a shard is added).  A row larger
    than a target can leave a shard empty; an empty table gives no rows.
    """
    order = ["doc_id", "text_crc32", "size", "_place"]
    spread = rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(shuffle_width(rows.sparkSession), *order)
    ranges = checkpoint(spread.withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*order))
    totals = ranges.groupBy("_part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).orderBy("_part").collect()
    before: dict[int, tuple[int, int]] = {}
    all_bytes = all_rows = 0
    for t in totals:
        before[t["_part"]] = (all_bytes, all_rows)
        all_bytes, all_rows = all_bytes + t["bytes"], all_rows + t["rows"]
    # (2 * offset + size) * shards has to fit 64 bits: beyond that, cut in coarser units
    unit = max(1, (2 * all_bytes * shards) >> 62)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, list[int]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            size, part = b.column("size").to_numpy(), b.column("_part").to_numpy()
            offset, row = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for p in np.unique(part).tolist():
                mine = part == p
                seen = at.setdefault(p, list(before[p]))
                ends = np.cumsum(size[mine]) + seen[0]
                offset[mine] = ends - size[mine]
                row[mine] = seen[1] + np.arange(len(ends))
                seen[0], seen[1] = int(ends[-1]), seen[1] + len(ends)
            middle = (2 * offset + size) // unit
            shard = np.minimum(middle * shards // max(1, 2 * all_bytes // unit), shards - 1)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("size"), b.column("text_crc32"), pa.array(shard.astype(np.int32)), pa.array(row)],
                ["doc_id", "size", "text_crc32", "shard", "row"],
            )

    placed = ranges.select("doc_id", "size", "text_crc32", "_part").mapInArrow(run, "doc_id long, size long, text_crc32 long, shard int, row long")
    # one row a shard
    first = F.broadcast(placed.groupBy(F.col("shard").alias("_shard")).agg(F.min("row").alias("_first")))
    return placed.join(first, placed["shard"] == first["_shard"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
