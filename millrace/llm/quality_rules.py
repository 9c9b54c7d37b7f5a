"""Quality rules: distribution divergence.

Every document's histogram of character classes and of common words is compared
with references of its corpus, one for each language label, by Jensen-Shannon
distance (square root of the divergence in bits, 0 to 1).  The references are
measured over all documents in a first pass; a document is held against its own
language's reference where there is one and against the nearest one otherwise.
Every label has a reference: those of the labels with most words go to all
workers, the others stay in a table and are joined with their documents.
Short texts give noisy histograms, so each comparison has a least length below
which it does not judge.  Plain counts (words, symbols, repeated lines and
five-word windows) come with it and form a base rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .textbatch import LOWER, SPACE, Texts, checkpoint, mix, seg_sum, slices, small_batches, windows

_U = np.uint64

#: Common words of the languages that are looked for.
COMMON_WORDS = {
    "en": "the of and to in a is that it for was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if",
    "fr": "le la les de des du un une et est en que qui pour dans ce il elle au aux par sur pas plus avec tout mais nous vous son sa ses ou leur se ne je",
    "de": "der die das und ist von zu den mit sich des auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie",
    "es": "el la los las de del un una y es en que por con para se no lo su al más como pero sus le ya o este sí porque esta entre cuando muy sin sobre",
}
VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words.split()})

#: Character classes by leading byte.
CLASSES = ["vowel", "consonant", "upper", "digit", "space", "stop", "symbol", "other_ascii", "beyond_ascii"]
_CLASS = np.full(256, 7, np.int8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[[ord(c) for c in "aeiou"]] = 0
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[SPACE] = 4
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 6
_CLASS[0x80:0xC0] = len(CLASSES)  # continuation bytes are no characters
_CLASS[0xC0:] = 8


@dataclass(frozen=True)
class Limits:
    """What a document may differ by, and from which length it is judged."""

    min_words: int = 10
    max_repeat_percent: int = 20
    min_class_chars: int = 200
    max_class_distance: float = 0.325
    min_common_words: int = 60
    max_word_distance: float = 0.24
    word_noise: float = 0.9  # a sample of n words lies about noise / sqrt(n) further off
    max_references: int = 256  # labels whose references go to all workers
    block_references: int = 4096  # references put together where the nearest of all is sought


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the rows of two arrays of frequencies."""
    m = (p + q) / 2

    def divergence(a: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0.0).sum(-1)

    return np.sqrt(np.clip((divergence(p) + divergence(q)) / 2, 0.0, 1.0))


def _vocabulary_hashes() -> np.ndarray:
    t = Texts(pa.array(VOCABULARY))
    t.words()
    return t.word_hashes()


_SORTED: list[np.ndarray] = []


def _bin_of(hashes: np.ndarray) -> np.ndarray:
    """The vocabulary's index of each word, its length for other words."""
    if not _SORTED:
        h = _vocabulary_hashes()
        order = np.argsort(h)
        _SORTED.extend([h[order], order])
    known, order = _SORTED
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, order[at], len(known))


#: ASCII marks that stand before or after a word and are not part of it.
_TRIM = np.zeros(256, bool)
_TRIM[[ord(c) for c in ".,;:!?'\"()-"]] = True


def histograms(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Counts of character classes and of common words (the last bin: other words) of each document."""
    k = len(CLASSES) + 1
    bins = np.repeat(np.arange(texts.n, dtype=np.int32) * np.int32(k), np.diff(texts.offsets))
    bins += _CLASS[texts.bytes]
    chars = np.bincount(bins, minlength=texts.n * k).reshape(texts.n, k)[:, :-1]
    starts, ends = texts.starts.copy(), texts.ends.copy()
    for _ in range(2):
        if len(starts):
            ends = ends - (_TRIM[texts.buf[ends - 1]] & (ends > starts + 1))
            starts = starts + (_TRIM[texts.buf[starts]] & (ends > starts + 1))
    raw = texts.buf
    texts.buf = LOWER[raw]
    bins = _bin_of(texts.hash_ranges(starts, ends))
    texts.buf = raw
    w = len(VOCABULARY) + 1
    doc = np.repeat(np.arange(texts.n), np.diff(texts.word_offsets))
    words = np.bincount(doc * w + bins, minlength=texts.n * w).reshape(texts.n, w)
    return chars, words


def base_counts(texts: Texts) -> dict[str, np.ndarray]:
    """Words, their characters, symbols, repeated lines and repeated five-word windows."""
    b = texts.bytes
    starting = (b & 0xC0) != 0x80
    symbol = _CLASS[b] == 6
    n_words = np.diff(texts.word_offsets)
    out = {
        "n_words": n_words,
        "word_chars": seg_sum(starting & ~SPACE[b], texts.offsets),
        "n_symbols": seg_sum(symbol, texts.offsets),
    }
    # lines, each with its document; a line counts if it holds a word
    cuts = np.flatnonzero(b == 10)
    doc_of_cut = np.searchsorted(texts.offsets, cuts, "right") - 1
    starts = np.concatenate([texts.offsets[:-1], cuts + 1])
    ends = np.concatenate([texts.offsets[1:], cuts])
    owner = np.concatenate([np.arange(texts.n), doc_of_cut])
    starts, owner = starts[(o := np.lexsort((starts, owner)))], owner[o]
    ends = np.sort(ends, kind="stable")  # line ends stand in the order of line starts
    has_word = np.searchsorted(texts.starts, ends) > np.searchsorted(texts.starts, starts)
    starts, ends, owner = starts[has_word], ends[has_word], owner[has_word]
    key = mix(texts.hash_ranges(starts, ends, 7) + owner.astype(_U) * _U(0xD6E8FEB86659FD93))
    _, first = np.unique(key, return_index=True)
    lines = np.bincount(owner, minlength=texts.n)
    out["n_dup_lines"] = lines - np.bincount(owner[first], minlength=texts.n)
    # words in windows found twice or more in the document
    import pandas as pd

    h, inside = windows(texts.word_hashes(), 5, texts.word_offsets)
    doc = np.repeat(np.arange(texts.n), n_words)
    at = np.flatnonzero(inside)
    codes, uniques = pd.factorize(mix(h[at] + doc[at].astype(_U) * _U(0xD6E8FEB86659FD93)))
    often = np.bincount(codes, minlength=len(uniques))[codes] > 1
    edge = np.zeros(len(h) + 6, np.int64)
    np.add.at(edge, at[often], 1)
    np.add.at(edge, at[often] + 5, -1)
    out["n_repeat_words"] = seg_sum(np.cumsum(edge)[: len(h)] > 0, texts.word_offsets)
    return out


def reference_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts of character classes and common words of each language label over all documents (lang, counts, words), a table."""
    small_batches(docs.sparkSession)
    k, w = len(CLASSES), len(VOCABULARY) + 1
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for part in slices(batches):
            texts = Texts(part.column(1))
            texts.words()
            both = np.hstack(histograms(texts))
            labels = part.column(0).dictionary_encode()
            index = labels.indices.to_numpy()
            for i, name in enumerate(labels.dictionary.to_pylist()):
                total[name] = total.get(name, 0) + both[index == i].sum(0)
        names = list(total)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total[n].tolist() for n in names], pa.list_(pa.int64()))], ["lang", "counts"])

    sums = (
        rows.mapInArrow(run, "lang string, counts array<long>")
        .select("lang", F.posexplode("counts").alias("bin", "n"))
        .groupBy("lang", "bin")
        .agg(F.sum("n").alias("n"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"))
        .select("lang", F.transform("bins", lambda x: x["n"]).alias("counts"))
    )
    words = F.aggregate(F.slice("counts", k + 1, w), F.lit(0).cast("long"), lambda a, x: a + x)
    return checkpoint(sums.withColumn("words", words).where("words > 0 and lang != ''"))


def frequencies(counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """A reference: frequencies of character classes and of common words."""
    c, k = np.array(counts, float), len(CLASSES)
    return c[:k] / c[:k].sum(), c[k:] / c[k:].sum()


class Judge:
    """The rules with their references, for slices of texts."""

    def __init__(self, known: dict[str, tuple[np.ndarray, np.ndarray]], limits: Limits):
        self.limits = limits
        names = sorted(known)
        self.at = {n: i for i, n in enumerate(names)}
        self.classes = np.array([known[n][0] for n in names]).reshape(len(names), len(CLASSES))
        self.words = np.array([known[n][1] for n in names]).reshape(len(names), len(VOCABULARY) + 1)

    def _distance(self, counts: np.ndarray, least: int, refs: np.ndarray, own: np.ndarray) -> np.ndarray:
        total = counts.sum(1)
        out = np.full(len(counts), np.nan)
        if len(refs):
            judged = total >= least
            p = counts[judged] / total[judged, None]
            mine = own[judged]
            has, got = mine >= 0, np.full(len(p), np.inf)
            got[has] = js_distance(p[has], refs[mine[has]])
            if not has.all():
                for q in refs:
                    got[~has] = np.minimum(got[~has], js_distance(p[~has], q))
            out[judged] = got
        return out

    def distances(self, chars: np.ndarray, common: np.ndarray, langs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        own = np.array([self.at.get(x, -1) for x in langs], np.int64)
        return self._distance(chars, self.limits.min_class_chars, self.classes, own), self._distance(common, self.limits.min_common_words, self.words, own)

    def __call__(self, texts: Texts, langs: list[str | None], others: Iterator[Judge] = ()) -> dict[str, np.ndarray]:
        """Counts, distances and verdict; the references of ``others`` are used as well where a document has none of its own."""
        limits, c = self.limits, base_counts(texts)
        chars, common = histograms(texts)
        near = self.distances(chars, common, langs)
        for other in others:
            near = tuple(np.fmin(x, y) for x, y in zip(near, other.distances(chars, common, langs)))
        c["class_distance"], c["word_distance"] = near
        c["base_failed"] = (c["n_words"] < limits.min_words) | (100 * c["n_repeat_words"] > limits.max_repeat_percent * c["n_words"])
        allowed = limits.max_word_distance + limits.word_noise / np.sqrt(np.maximum(c["n_words"], 1))
        with np.errstate(invalid="ignore"):
            c["kept"] = ~c["base_failed"] & ~(c["class_distance"] > limits.max_class_distance) & ~(c["word_distance"] > allowed)
        return c


def _judged(docs: DataFrame, limits: Limits, text: str, lang: str, put: Callable[[pa.RecordBatch, dict[str, np.ndarray]], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """What ``put`` makes of each slice of documents and the rules' results."""
    small_batches(docs.sparkSession)
    table = reference_counts(docs, text, lang)
    most = table.orderBy(F.desc("words"), "lang").limit(limits.max_references + 1).collect()
    common = Judge({r["lang"]: frequencies(r["counts"]) for r in most[: limits.max_references]}, limits)

    def run(batches: Iterator[pa.RecordBatch], rule=common, others=()) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            texts = Texts(part.column(text))
            texts.words()
            yield put(part, rule(texts, part.column(lang).cast(pa.string()).to_pylist(), (o.value for o in others)))

    if len(most) <= limits.max_references:
        return docs.mapInArrow(run, schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            langs = part.column(lang).cast(pa.string())
            first = {x: i for i, x in enumerate(langs.to_pylist())}
            own = part.column("_counts").take(pa.array(list(first.values()), pa.int64())).to_pylist()
            rule = Judge({x: frequencies(c) for x, c in zip(first, own)}, limits)
            yield from run(iter([part]), rule)

    label = F.coalesce(F.col(lang).cast("string"), F.lit(""))
    there = label.isin(list(common.at))
    # neither the labels with most words nor documents without a label are in the join, so no key has a large share of it
    rest = docs.where(~there & (label != "")).withColumn("_label", label).join(table.select(F.col("lang").alias("_label"), F.col("counts").alias("_counts")), "_label", "left")
    blocks = -(-table.count() // limits.block_references)
    nearest = []
    for b in range(blocks):
        block = table.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == b).toLocalIterator()
        nearest.append(docs.sparkSession.sparkContext.broadcast(Judge({r["lang"]: frequencies(r["counts"]) for r in block}, limits)))
    none = Judge({}, limits)
    own = rest.where("_counts is not null").mapInArrow(joined, schema)
    without = rest.where("_counts is null").select(*docs.columns).unionByName(docs.where(label == "")).mapInArrow(lambda batches: run(batches, none, nearest), schema)
    return docs.where(there).mapInArrow(run, schema).unionByName(own).unionByName(without)


def judge(docs: DataFrame, limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rules' counts, distances and verdict of each document.

    Null and empty texts have no words and fail the base rule.  Distances are
    null where the text is shorter than the guard or there is no reference; a
    null distance rejects nothing.  Every input row gives one row.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    names = ["doc_id", *counts, "base_failed", "kept", "class_distance", "word_distance"]

    def put(part: pa.RecordBatch, c: dict[str, np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array(c[k].astype(np.int64)) for k in counts] + [pa.array(c["base_failed"]), pa.array(c["kept"])] + [pa.array(c[k], from_pandas=True) for k in names[-2:]]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names)

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in counts) + ", base_failed boolean, kept boolean, class_distance double, word_distance double"
    return _judged(rows, limits, "text", "lang", put, schema)


def kept_documents(docs: DataFrame, limits: Limits = Limits(), text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that the rules keep, with all their columns.

    Null, empty and blank texts fail the base rule and go; rows that repeat are
    judged alike.
    """
    names = docs.columns
    return _judged(docs, limits, text, lang, lambda part, c: part.select(names).filter(pa.array(c["kept"])), docs.schema)


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Measure the references over all documents, then judge each of them."""
    return judge(docs, limits)
