"""Quality classifier: supervised subword embeddings.

Words, pairs of successive words and the character n-grams of words are hashed
to buckets; each bucket has a learned vector.  A document is the average of its
features' vectors, and a softmax layer over that average gives the classes.
Vectors and layer are trained by stochastic gradient descent in numpy on a
bounded sample of labelled rows.

The layer is linear, so the average of vectors followed by the layer equals the
average of each feature's own class scores.  Scoring therefore looks up one
small row of class scores for a feature, and a word's n-grams are summed once
for each distinct word of a slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import _GOLD, Texts, checkpoint, mix, seg_sum, slices, small_batches

_U = np.uint64
_WORD, _PAIR, _END = _U(0x632BE59BD9B4E019), _U(0x8CB92BA72F3D8DD7), 0


@dataclass(frozen=True)
class Settings:
    """``max_rows`` and ``max_features``: bounds of the labelled sample; it fits the driver whatever the table's size and the texts' lengths.

    ``stop_fold``: one labelled row in so many is kept from the gradients and decides when to stop.
    """

    max_rows: int = 4000
    max_features: int = 12_000_000
    stop_fold: int = 10
    patience: int = 3
    batch: int = 8
    bucket_bits: int = 18
    dim: int = 12
    shortest: int = 3
    longest: int = 5
    rounds: int = 12
    rate: float = 0.6
    classes: int = 2
    seed: int = 5


class Features:
    """Feature buckets of the texts of a slice, by distinct word and by word place."""

    def __init__(self, texts: Texts, s: Settings):
        import pandas as pd

        self.s, self.mask = s, _U((1 << s.bucket_bits) - 1)
        self.texts = texts
        h = texts.word_hashes()
        self.codes, uniques = pd.factorize(h)
        first = np.full(len(uniques), len(h), np.int64)
        first[self.codes[::-1]] = np.arange(len(h))[::-1]
        self._subwords(texts, first, uniques)
        # a pair belongs to its first word; a document's last word has none
        self.pairs = np.full(len(h), -1, np.int64)
        if len(h) > 1:
            inside = np.ones(len(h), bool)
            last = texts.word_offsets[1:]
            inside[last[last > 0] - 1] = False
            at = np.flatnonzero(inside)
            self.pairs[at] = self._bucket(mix(h[at] * _GOLD + h[at + 1]) ^ _PAIR)

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return (1 + mix(h) % self.mask).astype(np.int64)  # bucket 0 is the end feature

    def _subwords(self, texts: Texts, first: np.ndarray, uniques: np.ndarray) -> None:
        """Buckets of each distinct word and of its character n-grams, as a ragged array."""
        s = self.s
        starts, ends = texts.starts[first], texts.ends[first]
        n = len(first)
        size = ends - starts + 2
        offsets = np.concatenate([[0], np.cumsum(size)])
        buf = np.zeros(int(offsets[-1]) + 8, np.uint8)
        inner = np.ones(int(offsets[-1]), bool)
        inner[offsets[:-1]] = False
        inner[offsets[1:] - 1] = False
        source = np.repeat(starts - offsets[:-1] - 1, size) + np.arange(int(offsets[-1]))
        buf[: len(inner)][inner] = texts.buf[source[inner]]
        buf[offsets[:-1]], buf[offsets[1:] - 1] = ord("<"), ord(">")
        marked = Texts.__new__(Texts)
        marked.buf, marked.size, marked.n, marked.offsets = buf, len(inner), n, offsets
        lead = np.flatnonzero((buf[: len(inner)] & 0xC0) != 0x80)
        owner = np.searchsorted(offsets, lead, "right") - 1
        last = np.searchsorted(lead, offsets[1:])  # first lead of the next word
        bounds = np.append(lead, len(inner))
        ids, words = [self._bucket(uniques ^ _WORD)], [np.arange(n)]
        for k in range(s.shortest, s.longest + 1):
            at = np.flatnonzero(np.arange(len(lead)) + k <= last[owner]) if len(lead) else np.zeros(0, np.int64)
            if len(at):
                ids.append(self._bucket(marked.hash_ranges(bounds[at], bounds[at + k], k)))
                words.append(owner[at])
        ids, words = np.concatenate(ids), np.concatenate(words)
        order = np.argsort(words, kind="stable")
        self.ids = ids[order]
        self.per_word = np.concatenate([[0], np.cumsum(np.bincount(words, minlength=n))])

    def scores(self, table: np.ndarray) -> np.ndarray:
        """Average class scores of each document's features."""
        out = np.empty((self.texts.n, table.shape[1]))
        number = np.diff(self.per_word)[self.codes] + (self.pairs >= 0)
        total = seg_sum(number, self.texts.word_offsets) + 1
        for k in range(table.shape[1]):
            column = table[:, k]
            cum = np.concatenate([[0.0], np.cumsum(column[self.ids])])
            word = cum[self.per_word[1:]] - cum[self.per_word[:-1]]
            each = word[self.codes]
            paired = self.pairs >= 0
            each[paired] += column[self.pairs[paired]]
            run = np.concatenate([[0.0], np.cumsum(each)])
            o = self.texts.word_offsets
            out[:, k] = (run[o[1:]] - run[o[:-1]] + column[_END]) / total
        return out

    def bags(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each document's distinct buckets and their shares of its features."""
        o = self.texts.word_offsets
        for i in range(self.texts.n):
            codes = self.codes[o[i] : o[i + 1]]
            u, n = np.unique(codes, return_counts=True)
            size = self.per_word[u + 1] - self.per_word[u]
            at = np.repeat(self.per_word[u] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            pairs = self.pairs[o[i] : o[i + 1]]
            pairs = pairs[pairs >= 0]
            ids = np.concatenate([self.ids[at], pairs, [_END]])
            weight = np.concatenate([np.repeat(n, size), np.ones(len(pairs) + 1)])
            d, back = np.unique(ids, return_inverse=True)
            share = np.bincount(back, weight, len(d))
            yield d, share / share.sum()


class _Batch:
    """Bags of features as one sparse matrix; only the order in which its entries go by feature is kept beside the bags."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray):
        self.bags, self.labels = bags, labels
        self.size = np.array([len(ids) for ids, _ in bags], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.order = np.argsort(np.concatenate([i for i, _ in bags]), kind="stable").astype(np.int32)
        self.scale = np.sqrt(self.size).astype(np.float32)[:, None]

    def _flat(self) -> tuple[np.ndarray, np.ndarray]:
        """All entries' features and shares."""
        return np.concatenate([i for i, _ in self.bags]), np.concatenate([w for _, w in self.bags]).astype(np.float32)[:, None]

    def _forward(self, ids: np.ndarray, share: np.ndarray, vectors: np.ndarray, layer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Average vectors, and probabilities of the classes."""
        hidden = np.add.reduceat(share * vectors[ids], self.first, axis=0)
        logits = hidden @ layer.T
        p = np.exp(logits - logits.max(1, keepdims=True))
        return hidden, p / p.sum(1, keepdims=True)

    def step(self, vectors: np.ndarray, layer: np.ndarray, rate: float) -> None:
        """One step down the gradient of the batch's cross-entropy, in place."""
        ids, share = self._flat()
        hidden, p = self._forward(ids, share, vectors, layer)
        p[np.arange(len(p)), self.labels] -= 1
        back = (rate * self.scale) * (p @ layer)
        layer -= rate * (p.T @ hidden)
        sorted_ids = ids[self.order]
        starts = np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]])
        spread = share * np.repeat(back, self.size, axis=0)
        vectors[sorted_ids[starts]] -= np.add.reduceat(spread[self.order], starts, axis=0)

    def loss(self, vectors: np.ndarray, layer: np.ndarray) -> float:
        p = self._forward(*self._flat(), vectors, layer)[1]
        return float(-np.log(np.maximum(p[np.arange(len(p)), self.labels], 1e-12)).sum())


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, s: Settings = Settings(), take: bool = False) -> np.ndarray:
    """Class scores of every bucket: learned vectors times the learned softmax layer.

    The gradient of an average over a document's features is spread by their
    shares and scaled up by the square root of their number, so long and short
    documents move their vectors by like amounts.  Training ends early when the
    fold kept for it has not improved for ``patience`` rounds; the best round counts.
    With ``take`` the list of bags is emptied as soon as batches are made of it.
    """
    random = np.random.default_rng(s.seed)
    vectors = (random.random((1 << s.bucket_bits, s.dim), np.float32) - 0.5) / s.dim
    layer = np.zeros((s.classes, s.dim), np.float32)
    order = random.permutation(len(bags))
    kept = order[: len(bags) // s.stop_fold]
    used = order[len(kept) :]
    made = lambda at: [_Batch([bags[i] for i in at[k : k + s.batch]], labels[at[k : k + s.batch]]) for k in range(0, len(at), s.batch)]
    batches, judged = made(used), made(kept)
    if take:
        bags.clear()
    best, since = (np.inf, vectors @ layer.T), 0
    steps, step = max(1, s.rounds * len(batches)), 0
    for _ in range(s.rounds):
        for i in random.permutation(len(batches)):
            batches[i].step(vectors, layer, s.rate * (1 - step / steps))
            step += 1
        loss = sum(b.loss(vectors, layer) for b in judged)
        if not judged or loss < best[0]:
            best, since = (loss, vectors @ layer.T), 0
        elif (since := since + 1) == s.patience:
            break
    return best[1].astype(np.float64)


def labelled_sample(docs: DataFrame, labels: DataFrame, s: Settings, doc_id: str, text: str, label: str) -> tuple[list, np.ndarray]:
    """Feature bags of at most ``max_rows`` labelled ids and ``max_features`` features, chosen by the hash of their id.

    An id with several labels counts with the greatest one, an id with several
    texts with the least one.
    """
    order = F.xxhash64("doc_id")
    chosen = (
        labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").between(0, s.classes - 1))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(order, "doc_id")
        .limit(s.max_rows)
    )
    body = F.min(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = Texts(part.column("text"))
            texts.words()
            bags = list(Features(texts, s).bags())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("label"), pa.array([len(d) for d, _ in bags], pa.int64()),
                    pa.array([d.astype("<i4").tobytes() for d, _ in bags], pa.binary()), pa.array([w.astype("<f4").tobytes() for _, w in bags], pa.binary()),
                ],
                ["doc_id", "label", "features", "ids", "shares"],
            )

    made = checkpoint(rows.mapInArrow(run, "doc_id long, label int, features long, ids binary, shares binary"))
    sizes = made.select(order.alias("h"), "doc_id", "features").collect()  # at most max_rows small rows
    room, fits = s.max_features, []
    for r in sorted(sizes):
        if r["features"] > room:
            break
        room -= r["features"]
        fits.append(r["doc_id"])
    got = (made if len(fits) == len(sizes) else made.where(F.col("doc_id").isin(fits))).select("doc_id", "label", "ids", "shares").toArrow()
    view = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in got.column(name)]  # noqa: E731  no copies
    bags, y = list(zip(view("ids", "<i4"), view("shares", "<f4"))), got.column("label").to_numpy().astype(np.int64)
    at = np.argsort(got.column("doc_id").to_numpy())
    return [bags[i] for i in at], y[at]


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    mod: int = 5,
    held_out: int = 0,
    threshold: float = 0.3,
    settings: Settings = Settings(),
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
) -> DataFrame:
    """Probability that a text has label 1, learned from rows outside the held-out fold.

    The fold is crc32(doc_id as text) mod ``mod`` = ``held_out``.  Only the text
    enters a score.  A null or empty text has the end feature alone and a null
    id counts as an empty string; without labelled rows every score is one half.
    Every input row gives one row.
    """
    small_batches(docs.sparkSession)
    fold = lambda c: F.crc32(F.coalesce(c.cast("long").cast("string"), F.lit("")).cast("binary")) % mod == held_out
    bags, y = labelled_sample(docs.where(~fold(F.col(doc_id))), labels.where(~fold(F.col(doc_id))), settings, doc_id, text, label)
    table = docs.sparkSession.sparkContext.broadcast(train(bags, y, settings, take=True))  # of fixed size
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), fold(F.col(doc_id)).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = Texts(part.column(1))
            texts.words()
            z = Features(texts, settings).scores(table.value)
            score = 1 / (1 + np.exp(z[:, 0] - z[:, 1]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
