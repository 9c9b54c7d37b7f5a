"""Benchmark decontamination: spaced-seed hashing.

A seed is a window of tokens of which a fixed mask looks at some and ignores the
others, so a seed survives substituted words at the ignored places.  Seeds of
the benchmark items are looked up at every position of every document.  A hit
gives an item and a diagonal (how far the document is shifted against the item);
along the diagonal the stretch with most agreeing words is taken, of all those
with the least share of them, and verified against a least number of words.

The benchmark is a stated query set.  It is read in blocks of bounded size, and
the blocks' indexes, never the documents, go to the workers.  Documents are read
once, whatever the number of blocks: a worker holds the token hashes of a chunk
of documents and takes one block after another from its machine's disk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import _GOLD, Texts, mix, seg_sum, slices, small_batches

_U = np.uint64

#: Masks of the seeds; 0 is an ignored token.
MASKS = ("11011", "1101001", "11100101", "1010011001")
#: Marks at a word's edges that are no part of its token.
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in ".,;:!?'\"()[]{}-_*"]] = True
BITMAP_BITS = 22
#: Seed hits, and words along diagonals, that are looked at together.
HITS = 1 << 21
#: Bytes of text that all blocks are compared with before the next ones are read.
CHUNK_BYTES = 24 << 20


@dataclass(frozen=True)
class Overlap:
    """Least verified overlap: ``words`` agreeing words, or the whole of a shorter item, with at least ``share`` of its stretch agreeing.

    ``block_tokens``: about how many words of items a worker has at a time; an
    item is not divided.
    """

    words: int = 12
    share: float = 0.8
    min_item_words: int = 4
    block_tokens: int = 1 << 20


def tokens_of(texts: Texts) -> np.ndarray:
    """Hashes of lower-cased words without marks at their edges (texts are made lower-case on reading)."""
    starts, ends = texts.starts.copy(), texts.ends.copy()
    for _ in range(3):
        if len(starts):
            ends = ends - (_EDGE[texts.buf[ends - 1]] & (ends > starts + 1))
            starts = starts + (_EDGE[texts.buf[starts]] & (ends > starts + 1))
    return texts.hash_ranges(starts, ends)


def seeds(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """A seed hash for each position at which the mask fits into ``h``."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.full(n, salt, _U)
    for k, c in enumerate(mask):
        if c == "1":
            out = mix(out * _GOLD + h[k : k + n])
    return out


class Index:
    """Seeds of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], rule: Overlap):
        texts = Texts(pa.array([t for _, t in items], pa.string()), lower=True)
        texts.words()
        h = tokens_of(texts)
        o = texts.word_offsets
        self.item_id = [i for i, _ in items]
        self.tokens = [h[o[k] : o[k + 1]] for k in range(len(items))]
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.flat = np.concatenate([*self.tokens, np.zeros(0, _U)])
        self.first = np.cumsum(self.size) - self.size
        self.least = np.minimum(rule.words, rule.share * self.size)
        short = sorted({len(t) for t in self.tokens if rule.min_item_words <= len(t) < max(map(len, MASKS))})
        self.masks = [*MASKS, *("1" * n for n in short)]
        keys, where, places = [], [], []
        for salt, mask in enumerate(self.masks):
            whole = salt >= len(MASKS)
            for k, t in enumerate(self.tokens):
                if len(t) < rule.min_item_words or whole and len(t) != len(mask):
                    continue
                s = seeds(t, mask, salt)
                keys.append(s)
                where.append(np.full(len(s), k))
                places.append(np.arange(len(s)))
        key = np.concatenate(keys) if keys else np.zeros(0, _U)
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.item = (np.concatenate(where) if where else np.zeros(0, np.int64))[order]
        self.place = (np.concatenate(places) if places else np.zeros(0, np.int64))[order]
        self.bitmap = np.zeros(1 << BITMAP_BITS, bool)
        self.bitmap[(self.key & _U((1 << BITMAP_BITS) - 1)).astype(np.int64)] = True

    def candidates(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (document, item, diagonal) of all seed hits; diagonals count words of the slice."""
        found = [np.zeros((0, 3), np.int64)]
        for salt, mask in enumerate(self.masks):
            s = seeds(h, mask, salt)
            at = np.flatnonzero(self.bitmap[(s & _U((1 << BITMAP_BITS) - 1)).astype(np.int64)])
            at = at[doc[at] == doc[at + len(mask) - 1]]
            low, high = np.searchsorted(self.key, s[at], "left"), np.searchsorted(self.key, s[at], "right")
            some = high > low
            at, low, n = at[some], low[some], (high - low)[some]
            # a seed of very many items gives very many hits: a part of them at a time
            for i, j in _parts(n, HITS):
                k = n[i:j]
                place, which = np.repeat(at[i:j], k), np.repeat(low[i:j], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                found.append(np.unique(np.stack([doc[place], self.item[which], place - self.place[which]], 1), axis=0))
                if sum(map(len, found)) > HITS:
                    found = [np.unique(np.concatenate(found), axis=0)]
        u = np.unique(np.concatenate(found), axis=0)
        return u[:, 0], u[:, 1], u[:, 2]

    def agreeing(self, h: np.ndarray, o: np.ndarray, doc: np.ndarray, item: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Words that agree along each diagonal."""
        first = np.maximum(shift, o[doc])
        n = np.minimum(shift + self.size[item], o[doc + 1]) - first
        out = np.zeros(len(doc), np.int64)
        for i, j in _parts(n, HITS):
            k = n[i:j]
            at = np.repeat(first[i:j] - np.cumsum(k) + k, k) + np.arange(k.sum())
            same = h[at] == self.flat[at + np.repeat(self.first[item[i:j]] - shift[i:j], k)]
            out[i:j] = seg_sum(same, np.concatenate([[0], np.cumsum(k)]))
        return out


def _parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Successive ranges of things whose sizes come to about ``most``, or of one thing."""
    total, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def best_stretch(same: np.ndarray, share: float) -> tuple[int, int]:
    """Start and end of the stretch with most agreeing words of all stretches in which ``share`` or more agree; of equal ones the shortest.

    With 1 - share for an agreeing word and -share for another, in whole
    numbers, the stretches that fit are those whose sum is not negative.
    """
    if same.all():
        return 0, len(same)
    part = Fraction(str(share))
    total = np.concatenate([[0], np.cumsum(np.where(same, part.denominator - part.numerator, -part.numerator))])
    agree = np.concatenate([[0], np.cumsum(same)])
    # the first place whose total is no more than that of each end
    low = np.minimum.accumulate(total)
    first = np.searchsorted(-low, -total, "left")
    # a substituted word at the start is no part of the stretch
    begin = np.append(np.flatnonzero(same), len(same))[agree[first]]
    n = agree - agree[first]
    ends = np.flatnonzero(n == n.max())
    end = int(ends[np.argmin(ends - begin[ends])])
    return min(int(begin[end]), end), end


def overlaps(h: np.ndarray, o: np.ndarray, index: Index, rule: Overlap) -> list[tuple[int, int, int, int, int, int]]:
    """Verified overlaps of documents given as token hashes and first tokens: (document, item, first word, words, agreeing words, first word of the item), the longest for each document and item."""
    best: dict[tuple[int, int], tuple[int, int, int, int, int, int]] = {}
    doc, item, shift = index.candidates(h, np.repeat(np.arange(len(o) - 1), np.diff(o)))
    fits = index.agreeing(h, o, doc, item, shift) >= index.least[item]
    for d, k, s in zip(doc[fits].tolist(), item[fits].tolist(), shift[fits].tolist()):
        words = index.tokens[k]
        first, last = max(s, int(o[d])), min(s + len(words), int(o[d + 1]))
        same = h[first:last] == words[first - s : last - s]
        i, j = best_stretch(same, rule.share)
        agree = int(same[i:j].sum())
        if agree >= index.least[k]:
            row = (d, k, first + i - int(o[d]), j - i, agree, first + i - s)
            if (d, k) not in best or agree > best[d, k][4]:
                best[d, k] = row
    return sorted(best.values())


def _indexes(benchmark: DataFrame, rule: Overlap, item_id: str, text: str) -> list:
    """The blocks' indexes, each as a broadcast of bounded size; items that repeat are one."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).where("text is not null").distinct()
    size = rows.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    n = max(1, -(-size // rule.block_tokens))
    out = []
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else rows
        items = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))  # bounded by block_tokens
        out.append(benchmark.sparkSession.sparkContext.broadcast(Index(items, rule)))
    return out


def _compared(batches: Iterator[pa.RecordBatch], text: str, shared: list, rule: Overlap) -> Iterator[tuple[pa.RecordBatch, list[tuple[list[int | None], list[tuple]]]]]:
    """Slices of documents, each with its overlaps by block."""

    def chunk(held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]) -> Iterator[tuple]:
        found: list[list] = [[] for _ in held]
        for b in shared:
            index = b.value
            for got, (_, h, o) in zip(found, held):
                rows = overlaps(h, o, index, rule)
                got.append(([index.item_id[r[1]] for r in rows], rows))
            if len(shared) > 1:  # the next block takes its place; this one stays on disk
                b.__dict__.pop("_value", None)
        yield from ((part, got) for (part, _, _), got in zip(held, found))

    held, size = [], 0
    for part in slices(batches, text):
        texts = Texts(part.column(text), lower=True)
        texts.words()
        held.append((part, tokens_of(texts), texts.word_offsets))
        size += texts.size
        if len(shared) == 1 or size >= CHUNK_BYTES:
            yield from chunk(held)
            held, size = [], 0
    if held:
        yield from chunk(held)


def contaminated(docs: DataFrame, benchmark: DataFrame, rule: Overlap = Overlap(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Documents that hold a passage of a benchmark item: one row for each such document and item.

    Returns doc_id, item_id, doc_word and item_word (where the overlap begins),
    n_words, n_same and share of the longest overlap.  Null and empty texts, and
    items of fewer than ``min_item_words`` words, overlap with nothing; repeated
    rows are reported each, and an item without an id has a null item_id.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    shared = _indexes(benchmark, rule, item_id, "text")
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64()), ("n_same", pa.int64()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _compared(batches, "text", shared, rule):
            ids = part.column(0).to_pylist()
            rows = [(ids[d], item, first, at, n, agree, agree / n) for items, got in found for item, (d, _, first, n, agree, at) in zip(items, got)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)

    return rows.mapInArrow(run, "doc_id long, item_id long, doc_word long, item_word long, n_words long, n_same long, share double")


def decontaminate(docs: DataFrame, benchmark: DataFrame, rule: Overlap = Overlap(), text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The documents that overlap with no benchmark item, with all their columns.

    Null and empty texts overlap with nothing and stay; rows that repeat are
    judged alike.
    """
    small_batches(docs.sparkSession)
    shared = _indexes(benchmark, rule, item_id, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _compared(batches, text, shared, rule):
            keep = np.ones(part.num_rows, bool)
            keep[[row[0] for _, got in found for row in got]] = False
            yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
