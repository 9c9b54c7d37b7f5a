"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch are held as ragged numpy arrays of symbol ids.  In each
round every sequence finds its own lowest-ranked adjacent pair and merges all
of that pair's occurrences, all sequences at once; a sequence that has no
mergeable pair left is finished.  Its surviving symbols are its tokens.

Only distinct words of a slice are looked at: the tokenizer's pre-tokenizer
never joins text across white space, so a document's count is the sum of its
words' counts.  ASCII words are cut by the pattern in the vocabulary file, others
by the library's own normalizer and pre-tokenizer, whose Unicode tables decide.  Strings of special tokens are found in the raw text first, as
the library does by default, and count as one token each.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .textbatch import Texts, seg_sum, slices, small_batches

#: Words whose counts a worker keeps; the store is emptied when full.
MEMORY_WORDS = 400_000

#: The order in which byte-level BPE numbers the 256 bytes is the
#: printable Latin-1 characters first, the other bytes moved up from U+0100.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_characters() -> list[str]:
    """The character that stands for each byte value in a byte-level vocabulary."""
    out, extra = [], 0
    printable = set(_PRINTABLE)
    for b in range(256):
        if b in printable:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class RankMerger:
    """A byte-level BPE vocabulary with word-end symbols, merging arrays of sequences."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        chars = byte_characters()
        self.plain = np.array([vocab.get(c, -1) for c in chars], np.int64)
        self.final = np.array([vocab.get(c + suffix, -1) for c in chars], np.int64)
        pairs = [(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.size = max(vocab.values()) + 2
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        self.specials = [t["content"] for t in spec["added_tokens"]]
        pattern = "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))
        self.special = regex.compile(pattern) if pattern else None
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"])
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.known: dict[int, int] = {}

    def cut(self, text: str) -> list[bytes]:
        """Pre-tokens of a text without special tokens."""
        if text.isascii():
            return [p.encode() for p in self.pattern.findall(text.lower())]
        normal = self.normalizer.normalize_str(text) if self.normalizer else text
        return [bytes([self.byte_of[c] for c in p]) for p, _ in self.pre_tokenizer.pre_tokenize_str(normal)]

    def pieces(self, text: str) -> tuple[list[bytes], int]:
        """Pre-tokens of a text, and how many special tokens are in it."""
        found, parts = 0, [text]
        if self.special is not None and "<" in text:
            parts = self.special.split(text)
            found = len(parts) - 1
        return [p for part in parts if part for p in self.cut(part)], found

    def survivors(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each piece after all merges."""
        n = len(pieces)
        if not n:
            return np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.plain[raw]
        symbols[ends[sizes > 0] - 1] = self.final[raw[ends[sizes > 0] - 1]]
        owner = np.repeat(np.arange(n), sizes)
        keep = symbols >= 0  # a byte without a symbol gives no token
        symbols, owner = symbols[keep], owner[keep]
        out = np.bincount(owner, minlength=n)
        none = len(self.keys)
        while len(symbols) > 1:
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            fits = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank = np.where(fits, self.rank[at], none)
            begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(np.r_[rank, none], begins)
            size = np.diff(np.r_[begins, len(owner)])
            each = np.repeat(lowest, size)
            hit = np.r_[rank, none] == each
            hit &= each < none
            # of overlapping occurrences (a run like "a a a") the leftmost of each two counts
            runs = np.flatnonzero(hit)
            if len(runs):
                new = np.r_[True, np.diff(runs) > 1]
                first = np.maximum.accumulate(np.where(new, runs, 0))
                chosen = runs[(runs - first) % 2 == 0]
                symbols = symbols.copy()
                symbols[chosen] = self.made[rank[chosen]]
                out -= np.bincount(owner[chosen], minlength=n)
                gone = np.zeros(len(symbols), bool)
                gone[chosen + 1] = True
            else:
                gone = np.zeros(len(symbols), bool)
            live = ~gone & np.repeat(lowest < none, size)
            symbols, owner = symbols[live], owner[live]
        return out

    def count_words(self, texts: Texts) -> np.ndarray:
        """Tokens of each word of the texts."""
        import pandas as pd

        codes, uniques = pd.factorize(texts.word_hashes())
        first = np.full(len(uniques), len(codes), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        known = self.known
        got = np.fromiter((known.get(h, -1) for h in uniques.tolist()), np.int64, len(uniques))
        new = np.flatnonzero(got < 0)
        if len(new):
            pieces, owner, extra = [], [], np.zeros(len(new), np.int64)
            for k, w in enumerate(first[new].tolist()):
                p, special = self.pieces(texts.text(texts.starts[w], texts.ends[w]))
                pieces += p
                owner += [k] * len(p)
                extra[k] = special
            got[new] = extra + np.bincount(np.array(owner, np.int64), self.survivors(pieces), len(new)).astype(np.int64)
            if len(known) + len(new) > MEMORY_WORDS:
                known.clear()
            known.update(zip(uniques[new].tolist(), got[new].tolist()))
        return got[codes]


_mergers: dict[str, RankMerger] = {}


def merger(path: str) -> RankMerger:
    """The vocabulary, read once by each worker."""
    if path not in _mergers:
        _mergers[path] = RankMerger(path)
    return _mergers[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of every whole text under a byte-level BPE vocabulary file.

    Returns doc_id, n_bytes, n_tokens, over_limit.  A null text counts as
    empty: 0 bytes, 0 tokens.  Each input row gives one row, repeated rows and
    null ids included; other columns are ignored.  The vocabulary file must be
    at the same path on every worker.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = merger(vocabulary)
        for part in slices(batches):
            texts = Texts(part.column(1))
            texts.words()
            tokens = seg_sum(bpe.count_words(texts), texts.word_offsets)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(texts.offsets)), pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
