"""Columnar text helpers shared by the operators of this subpackage.

An Arrow batch of texts is looked at as one byte buffer with document offsets.
Words, lines and n-grams are index ranges into that buffer and are hashed to
64 bits with array operations, eight bytes at a time, so no Python object is
made per word.  Batches have at most a few megabytes and are cut into slices,
which bounds a worker's memory by the longest single document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text handled at once by a Python worker.
SLICE_BYTES = 3 << 19
#: Rows of an Arrow batch sent to a Python worker, and its bytes, but for a last row that is longer.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Largest estimate of a table's size that is kept; Spark's own for a table of unknown size.
MOST_ESTIMATED = (1 << 63) - 1

_U = np.uint64
_M1, _M2, _GOLD = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, in bytes too: documents can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset on a
    single machine (tests) is a temporary one used.  A cluster without it raises:
    a machine's own folder is not seen by the others.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            import tempfile

            shared = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(shared)
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder.

    Spark keeps its estimate of the size, which for a join is the product of both
    sides: over a loop of joins its digits double with each, until the driver has
    no memory left for the number.  Estimates beyond 64 bits are dropped.
    """
    spark = df.sparkSession
    shared_folder(spark)
    cut = df.checkpoint()
    plan = cut._jdf.queryExecution().logical()
    if plan.stats().sizeInBytes() <= MOST_ESTIMATED:
        return cut
    jvm, session = spark.sparkContext._jvm, cut._jdf.sparkSession()
    none = jvm.scala.Option.empty()
    plan = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), session, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, plan), spark)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """Cut the lineage with a Parquet table in the shared folder; the table and its path, to be removed when nothing reads it any more."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of :func:`written`."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> _U(30))
    x = x * _M1
    x ^= x >> _U(27)
    x *= _M2
    x ^= x >> _U(31)
    return x


def seg_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]], empty ranges included."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, dtype=np.int64, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


class Texts:
    """Texts of a batch as one padded byte buffer and document offsets."""

    def __init__(self, column: pa.Array, lower: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.type not in (pa.binary(), pa.large_binary()):
            column = pc.cast(column, pa.large_binary()) if column.type == pa.large_string() else pc.cast(column, pa.binary())
        if column.null_count:
            column = pc.fill_null(column, b"")
        wide = np.int64 if column.type == pa.large_binary() else np.int32
        _, ends, data = column.buffers()
        n = len(column)
        offsets = np.frombuffer(ends, wide, n + 1, column.offset * wide().itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
        first, last = int(offsets[0]), int(offsets[-1])
        self.n = n
        self.offsets = offsets - first
        self.buf = np.zeros(last - first + 8, np.uint8)
        if last > first:
            raw = np.frombuffer(data, np.uint8, last - first, first)
            self.buf[: last - first] = LOWER[raw] if lower else raw
        self.size = last - first

    @property
    def bytes(self) -> np.ndarray:
        return self.buf[: self.size]

    def words(self) -> None:
        """Find the words ``[^\\x20\\x09-\\x0D]+``: starts, ends and each document's first word index."""
        inside = ~SPACE[self.bytes]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        edges = self.offsets[:-1][self.offsets[:-1] < self.size]
        begin[edges] = inside[edges]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        tails = self.offsets[1:][self.offsets[1:] > 0] - 1
        stop[tails] = inside[tails]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(stop) + 1
        self.word_offsets = np.searchsorted(self.starts, self.offsets)

    def hash_ranges(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        """64-bit hashes of byte ranges, equal for equal bytes."""
        view = np.ndarray((len(self.buf) - 7,), "<u8", self.buf.data, 0, (1,))
        length = (ends - starts).astype(np.int64)
        h = (length.astype(_U) + _U(seed)) * _GOLD
        left, at, alive = length, starts, None
        while True:
            if alive is None:
                x, rest, cur = view[at], left, h
            else:
                if not len(alive):
                    return h
                x, rest, cur = view[at], left, h[alive]
            short = rest < 8
            shift = np.where(short, 64 - 8 * np.maximum(rest, 0), 0).astype(_U)
            x = np.where(shift < 64, (x << (shift & _U(63))) >> (shift & _U(63)), _U(0))
            value = mix((cur ^ x) * _M1 + _GOLD)
            if alive is None:
                h = value
                alive = np.flatnonzero(rest > 8)
                left, at = left[alive] - 8, at[alive] + 8
            else:
                h[alive] = value
                more = rest > 8
                alive, left, at = alive[more], rest[more] - 8, at[more] + 8

    def word_hashes(self) -> np.ndarray:
        return self.hash_ranges(self.starts, self.ends)

    def text(self, start: int, end: int) -> str:
        return self.buf[start:end].tobytes().decode("utf-8", "replace")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice has about ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(size)
        i = 0
        while i < batch.num_rows:
            base = total[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(i, j - i)
            i = j


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int, most_bytes: int = 48 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of sorted batches, with the groups' bounds."""
    held: list[pa.RecordBatch] = []
    n = size = 0

    def cut(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows, bool)
        change[:1] = True
        for k in keys:
            c = table.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(change)

    for b in batches:
        held.append(b)
        n, size = n + b.num_rows, size + b.nbytes
        if n >= rows or size >= most_bytes:
            table = pa.Table.from_batches(held)
            at = cut(table)
            if len(at) > 1:
                yield table.slice(0, at[-1]), at
                held = table.slice(at[-1]).combine_chunks().to_batches()
                n, size = table.num_rows - int(at[-1]), sum(x.nbytes for x in held)
    if held and n:
        table = pa.Table.from_batches(held)
        at = cut(table)
        yield table, np.append(at, table.num_rows)


def windows(h: np.ndarray, width: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` successive words: a hash for each position, and which positions lie inside a document."""
    n = len(h)
    out = np.zeros(n, _U)
    for k in range(width):
        out = mix(out * _GOLD + (h[k:] if k else h)) if not k else _shifted(out, h, k)
    owner_end = np.repeat(offsets[1:], np.diff(offsets))
    return out, np.arange(n) + width <= owner_end


def _shifted(out: np.ndarray, h: np.ndarray, k: int) -> np.ndarray:
    n = len(h)
    if k < n:
        out[: n - k] = mix(out[: n - k] * _GOLD + h[k:])
    return out
