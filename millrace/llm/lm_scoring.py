"""LM scoring: bigram deleted interpolation.

The probability of a token mixes three maximum-likelihood estimates, of the
token after its context, of the token alone and of any token of the vocabulary.
The mixture's weights depend on how often the context was seen and are learned
by expectation-maximisation on a part of the training documents whose own
counts are deleted from the estimates for that purpose.

Counting never sends a row for each token.  Documents are dealt to blocks of
some megabytes; a block sends the sorted distinct n-gram hashes of its texts, cut
into hash ranges, as packed arrays.  A range merges what all blocks sent, and
answers each block with the totals in the block's own order, so hashes travel
once and answers are small.  A frequent word is one entry for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import _GOLD, Texts, checkpoint, mix, seg_sum, slices, small_batches

_U = np.uint64
#: The end token's hash; it is also the context of a text's first token.
_END = _U(0x5851F42D4C957F2D)
UNIGRAM, BIGRAM, STATS = 0, 1, 2
#: Parts of the documents: counted, counted but deleted for learning weights, held out.
COUNTED, DELETED, HELD_OUT = 0, 1, 2
#: Context-frequency buckets: 0, 1, 2-3, 4-7, ...
BUCKETS = 40


@dataclass(frozen=True)
class Plan:
    """Blocks of about ``block_bytes`` of text, a hash range for each ``blocks_per_range`` of them.

    Blocks and ranges both keep their size as the input grows; what a block
    sends a range gets smaller, down to single entries.  One training document
    in ``deleted_in`` has its counts deleted while weights are learned.
    """

    block_bytes: int = 9 << 20
    blocks_per_range: int = 2
    deleted_in: int = 40
    em_rounds: int = 60


# -- packed arrays -----------------------------------------------------------


def pack_sorted(h: np.ndarray, base: int) -> bytes:
    """Sorted 64-bit values as byte-cut differences from ``base`` on."""
    d = np.diff(h, prepend=_U(base))
    width = max(1, (int(d.max()).bit_length() + 7) // 8) if len(d) else 1
    return bytes([width]) + d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(b: bytes, base: int) -> np.ndarray:
    width = b[0]
    cut = np.frombuffer(b, np.uint8, offset=1).reshape(-1, width)
    full = np.zeros((len(cut), 8), np.uint8)
    full[:, :width] = cut
    d = full.view("<u8").ravel()
    return np.cumsum(d, dtype=_U) + _U(base)


def pack_counts(c: np.ndarray) -> bytes:
    planes = c.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(planes.tobytes(), 1)


def unpack_counts(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


def _range_bounds(ranges: int) -> list[int]:
    return [(r << 64) // ranges for r in range(ranges)]


# -- a block's n-grams -------------------------------------------------------


class Block:
    """Token and bigram hashes of the documents of a block."""

    def __init__(self, table: pa.Table):
        parts = [pa.ipc.open_stream(zstandard.decompress(b)).read_all() for b in table.column("payload").to_pylist()]
        docs = pa.concat_tables(parts)
        self.doc_id = docs.column("doc_id").combine_chunks()
        self.part = docs.column("part").to_numpy()
        texts = Texts(docs.column("text").combine_chunks(), lower=True)
        texts.words()
        n = texts.n
        counts = np.diff(texts.word_offsets)
        self.offsets = texts.word_offsets + np.arange(n + 1)
        self.token = np.full(int(self.offsets[-1]), _END, _U)
        place = np.arange(len(texts.starts)) + np.repeat(np.arange(n), counts)
        self.token[place] = texts.word_hashes()
        self.context = np.empty_like(self.token)
        self.context[1:] = self.token[:-1]
        self.context[self.offsets[:-1]] = _END
        self.tokens = np.diff(self.offsets)

    def grams(self, kind: int) -> np.ndarray:
        return mix(self.token) if kind == UNIGRAM else mix(mix(self.context) * _GOLD + self.token)


# -- counting ----------------------------------------------------------------


def _packed(docs: DataFrame, learn_mod: int, learn_skip: int, plan: Plan, doc_id: str, text: str) -> tuple[DataFrame, int, int]:
    """Documents as compressed payloads of (block, payload); how many blocks, from 0 on, hold the deleted part; hash ranges."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // plan.block_bytes))
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    part = F.when(crc % learn_mod == learn_skip, HELD_OUT).when(F.floor(crc / learn_mod).cast("long") % plan.deleted_in == 0, DELETED).otherwise(COUNTED)
    dealt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    rows = rows.withColumn("part", part.cast("int")).withColumn("block", dealt)
    few = max(1, -(-blocks // plan.deleted_in))  # blocks of the deleted part
    # block ids: the deleted part's from 0, the others' after them
    rows = rows.withColumn("block", F.when(F.col("part") == DELETED, F.col("block") % few).otherwise(F.col("block") + few))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            block = table.column("block").to_numpy()
            ids, out = np.unique(block), []
            for b in ids.tolist():
                sink = pa.BufferOutputStream()
                mine = table.filter(pa.array(block == b)).select(["doc_id", "text", "part"])
                with pa.ipc.new_stream(sink, mine.schema) as w:
                    w.write_table(mine)
                out.append(zstandard.compress(sink.getvalue().to_pybytes(), 1))
            return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(out, pa.binary())], ["block", "payload"])

        for piece in slices(batches):
            held.append(piece)
            size += piece.nbytes
            if size > 24 << 20:
                yield flush()
                held.clear()
                size = 0
        if held:
            yield flush()

    return rows.select("doc_id", "text", "part", "block").mapInArrow(run, "block int, payload binary"), few, max(8, blocks // plan.blocks_per_range)


def _sent(ranges: int):
    bounds = _range_bounds(ranges)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block = Block(table)
        rows: dict[str, list] = {"kind": [], "range": [], "block": [], "hashes": [], "counted": [], "deleted": []}
        owner = np.repeat(block.part, block.tokens)
        for kind in (UNIGRAM, BIGRAM):
            u, inverse = np.unique(block.grams(kind), return_inverse=True)
            counted = np.bincount(inverse[owner == COUNTED], minlength=len(u))
            deleted = np.bincount(inverse[owner == DELETED], minlength=len(u))
            at = np.r_[np.searchsorted(u, np.array(bounds, _U)), len(u)]
            for r in np.flatnonzero(np.diff(at)).tolist():
                i, j = at[r], at[r + 1]
                rows["kind"].append(kind)
                rows["range"].append(r)
                rows["block"].append(key[0].as_py())
                rows["hashes"].append(pack_sorted(u[i:j], bounds[r]))
                rows["counted"].append(pack_counts(counted[i:j]))
                rows["deleted"].append(pack_counts(deleted[i:j]))
        i32 = pa.int32()
        return pa.table([pa.array(rows["kind"], i32), pa.array(rows["range"], i32), pa.array(rows["block"], i32), *[pa.array(rows[k], pa.binary()) for k in ("hashes", "counted", "deleted")]], list(rows))

    return run


def _answered(ranges: int):
    bounds = _range_bounds(ranges)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        kind, r = key[0].as_py(), key[1].as_py()
        hashes = [unpack_sorted(b, bounds[r]) for b in table.column("hashes").to_pylist()]
        sizes = np.cumsum([0, *map(len, hashes)])
        u, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        totals = []
        for name in ("counted", "deleted"):
            c = np.concatenate([unpack_counts(b) for b in table.column(name).to_pylist()])
            totals.append(np.bincount(inverse, c, len(u)).astype(np.int64))
        counted, both = totals[0], totals[0] + totals[1]
        blocks = table.column("block").to_pylist()
        seen = [(c[inverse[sizes[i] : sizes[i + 1]]]) for c in (both, counted) for i in range(len(blocks))]
        packed = [pack_counts(c) for c in seen]
        n = len(blocks)
        kinds, ranges, names, all_, part = [kind] * n, [r] * n, list(blocks), packed[:n], packed[n:]
        if kind == UNIGRAM:  # tokens and types: of all counts, and without the deleted part
            stats = np.array([both.sum(), (both > 0).sum(), counted.sum(), (counted > 0).sum()])
            kinds, ranges, names, all_, part = kinds + [STATS], ranges + [r], names + [-1], all_ + [pack_counts(stats)], part + [b""]
        i32 = pa.int32()
        return pa.table([pa.array(names, i32), pa.array(kinds, i32), pa.array(ranges, i32), pa.array(all_, pa.binary()), pa.array(part, pa.binary())], ["block", "kind", "range", "total", "counted"])

    return run


def _counts_in(block: Block, answers: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token of a block: its count, its context's, and theirs together."""
    by: dict[tuple[int, int], bytes] = {(k, r): b for k, r, b in zip(*(answers.column(c).to_pylist() for c in ("kind", "range", column)))}

    def totals(kind: int) -> np.ndarray:
        mine = [by[key] for key in sorted(by) if key[0] == kind]
        return np.concatenate([unpack_counts(b) for b in mine]) if mine else np.zeros(0, np.int64)

    single = totals(UNIGRAM)
    u, inverse = np.unique(block.grams(UNIGRAM), return_inverse=True)
    token = single[inverse]
    context = np.empty_like(token)
    context[1:] = token[:-1]
    end = single[np.searchsorted(u, mix(np.array([_END])))[0]] if len(u) else 0
    context[block.offsets[:-1]] = end
    _, inverse = np.unique(block.grams(BIGRAM), return_inverse=True)
    return token, context, totals(BIGRAM)[inverse]


# -- mixture weights ---------------------------------------------------------


def bucket_of(context: np.ndarray) -> np.ndarray:
    """The frequency bucket of context counts: 0, 1, 2-3, 4-7, ..."""
    return np.minimum(np.where(context > 0, np.frexp(context.astype(float))[1], 0), BUCKETS - 1)


def estimates(token: np.ndarray, context: np.ndarray, pair: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return pair / np.maximum(context, 1), token / max(n, 1)


def learn_weights(bucket: np.ndarray, p2: np.ndarray, p1: np.ndarray, count: np.ndarray, p0: float, rounds: int) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each bucket by expectation-maximisation.

    A bucket without held-out tokens takes those of the nearest one with some;
    contexts that were never seen give the bigram no weight.  The uniform
    weight is at least one in a million, so no text is impossible.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    p = np.stack([p2, p1, np.full(len(p1), p0)], 1)
    filled = np.bincount(bucket, count, BUCKETS) > 0
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (count / np.maximum(share.sum(1), 1e-300))[:, None]
        gathered = np.stack([np.bincount(bucket, share[:, k], BUCKETS) for k in range(3)], 1)
        total = gathered.sum(1, keepdims=True)
        weights = np.where(total > 0, gathered / np.maximum(total, 1e-300), weights)
    have = np.flatnonzero(filled)
    if len(have):
        for b in np.flatnonzero(~filled):
            weights[b] = weights[have[np.argmin(np.abs(have - b))]]
    weights[0, 0] = 0.0
    weights = np.maximum(weights, [0.0, 1e-6, 1e-6])
    return weights / weights.sum(1, keepdims=True)


_STEP = 8  # bins for each factor e of a probability


def _bins(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.maximum(np.floor(np.log(p) * _STEP), -_STEP * 60), 1).astype(np.int64)


def _observed(n: int):
    """Held-out tokens of a block by bucket and binned estimates."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["bucket", "b2", "b1", "s2", "s1", "n"]
        if not left.num_rows:
            return pa.table([pa.array([], pa.int32())] * 3 + [pa.array([], pa.float64())] * 2 + [pa.array([], pa.int64())], names)
        token, context, pair = _counts_in(Block(left), right, "counted")
        bucket = bucket_of(context)
        p2, p1 = estimates(token, context, pair, n)
        keys = np.stack([bucket, _bins(p2), _bins(p1)], 1)
        u, inverse = np.unique((keys[:, 0] * 4096 + keys[:, 1] + 1024) * 4096 + keys[:, 2] + 1024, return_inverse=True)
        i32 = pa.int32()
        return pa.table(
            [
                pa.array(u // 4096 // 4096, i32),
                pa.array(u // 4096 % 4096 - 1024, i32),
                pa.array(u % 4096 - 1024, i32),
                pa.array(np.bincount(inverse, p2, len(u))),
                pa.array(np.bincount(inverse, p1, len(u))),
                pa.array(np.bincount(inverse, minlength=len(u)).astype(np.int64)),
            ],
            names,
        )

    return run


def _scored(n: int, types: int, weights: np.ndarray):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not left.num_rows:
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            return pa.table([pa.array([], k) for k in kinds], names)
        block = Block(left)
        token, context, pair = _counts_in(block, right, "total")
        p2, p1 = estimates(token, context, pair, n)
        w = weights[bucket_of(context)]
        mixed = w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (types + 1)
        base = np.log10((token + 1) / (n + types + 1))
        sums = [np.add.reduceat(x, block.offsets[:-1]) for x in (base, np.log10(mixed))]
        known = seg_sum(token > 0, block.offsets)
        return pa.table([block.doc_id, pa.array(block.part == HELD_OUT), pa.array(block.tokens), pa.array(known), pa.array(np.full(len(known), n, np.int64)), *map(pa.array, sums)], names)

    return run


def score_texts(docs: DataFrame, mod: int = 7, skip: int = 2, plan: Plan = Plan(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn from documents with crc32(doc_id) mod ``mod`` other than ``skip``; score all.

    Null and empty texts have the end token alone; a null id takes the
    checksum of an empty string.  Every input row gives one row.  Without
    training documents every probability is uniform.
    """
    packed, few, ranges = _packed(docs, mod, skip, plan, doc_id, text)
    sent = packed.groupBy("block").applyInArrow(_sent(ranges), "kind int, range int, block int, hashes binary, counted binary, deleted binary")
    answers = checkpoint(sent.groupBy("kind", "range").applyInArrow(_answered(ranges), "block int, kind int, range int, total binary, counted binary"))
    stats = answers.where(F.col("kind") == STATS).select("total").collect()  # one row a range
    n, types, n_counted, types_counted = (int(x) for x in sum((unpack_counts(r["total"]) for r in stats), np.zeros(4, np.int64)))
    answers = answers.where(F.col("kind") != STATS)
    binned = (
        packed.where(F.col("block") < few)
        .groupBy("block")
        .cogroup(answers.where(F.col("block") < few).groupBy("block"))
        .applyInArrow(_observed(n_counted), "bucket int, b2 int, b1 int, s2 double, s1 double, n long")
        .groupBy("bucket", "b2", "b1")
        .agg(F.sum("s2").alias("s2"), F.sum("s1").alias("s1"), F.sum("n").alias("n"))
    )
    bins = binned.collect()  # bounded by buckets times bins
    count = np.array([b["n"] for b in bins], float)
    column = lambda k: np.array([b[k] for b in bins], float) / np.maximum(count, 1)
    weights = learn_weights(np.array([b["bucket"] for b in bins], np.int64), column("s2"), column("s1"), count, 1 / (types_counted + 1), plan.em_rounds)
    return (
        packed.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(_scored(n, types, weights), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )
