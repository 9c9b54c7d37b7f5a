"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A text gets a leading white-space marker, its spaces become markers, and the
segmentation with the highest sum of piece log scores is taken.  A character
that no piece covers is given by its UTF-8 bytes' pieces.  Decoding turns ids
into bytes, markers into spaces, and drops the leading one.

No piece holds a marker after another character, so the best segmentation of a
text is the best segmentations of its chunks (markers and what follows up to the
next marker) one after another.  Distinct chunks of a slice go through the
lattice together: at each start position all chunks walk the trie in step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import Texts, slices, small_batches

MARK = "▁"
#: An unknown character scores this much below the least piece.
UNKNOWN_PENALTY = 10.0
NORMAL, UNKNOWN, CONTROL, BYTE = 0, 1, 2, 3
#: Chunks of more bytes than this are segmented one by one.
LONG_CHUNK = 96


@dataclass
class Pieces:
    """A vocabulary: piece strings, log scores, kinds."""

    text: list[str]
    score: np.ndarray
    kind: np.ndarray


def read_pieces(path: str) -> Pieces:
    """The pieces of a model file, with log scores.

    A unigram model's scores are taken as they are.  A merge model stores the
    negative merge rank instead, no log probability; each piece then gets the
    log of its Zipf frequency 1 / (rank + 2.7), normalised over the pieces.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    text = [model.id_to_piece(i) for i in range(n)]
    kind = np.array([UNKNOWN if model.is_unknown(i) else CONTROL if model.is_control(i) or model.is_unused(i) else BYTE if model.is_byte(i) else NORMAL for i in range(n)])
    score = np.array([model.get_score(i) for i in range(n)], float)
    normal = kind == NORMAL
    values = score[normal]
    if len(values) and np.all(values == np.round(values)):
        rank = np.empty(n)
        rank[normal] = np.argsort(np.argsort(-values, kind="stable"), kind="stable")
        weight = np.log(1 / (rank[normal] + 2.7))
        score[normal] = weight - np.log(np.exp(weight).sum())
    score[~normal] = 0.0
    return Pieces(text, score, kind)


class DoubleArray:
    """A double-array trie: from state s, byte c leads to base[s] + c if check there is s."""

    def __init__(self, keys: Sequence[bytes], values: Sequence[int]):
        children: list[dict[int, int]] = [{}]
        terminal = [-1]
        for key, value in zip(keys, values):
            node = 0
            for c in key:
                follow = children[node].get(c)
                if follow is None:
                    follow = children[node][c] = len(children)
                    children.append({})
                    terminal.append(-1)
                node = follow
            terminal[node] = value
        size = 4 * len(children) + 1024
        base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        taken = np.zeros(size, bool)
        taken[0] = True
        free, slot = 1, [0] * len(children)
        queue = [0]
        for node in queue:
            at = slot[node]
            value[at] = terminal[node]
            follow = children[node]
            if not follow:
                continue
            codes = np.array(sorted(follow))
            while taken[free]:
                free += 1
            b, width = -1, 64
            low = max(free, int(codes[0]) + 1)
            while b < 0:
                if low + width + 512 > size:
                    base, check, value, taken = (np.concatenate([x, np.full(size, fill, x.dtype)]) for x, fill in ((base, 0), (check, -1), (value, -1), (taken, False)))
                    size *= 2
                first = np.flatnonzero(~taken[low : low + width]) + low - codes[0]
                for c in codes[1:]:
                    first = first[~taken[first + c]]
                if len(first):
                    b = int(first[0])
                low, width = low + width, width * 2
            base[at] = b
            taken[b + codes] = True
            check[b + codes] = at
            for c in codes.tolist():
                slot[follow[c]] = b + c
                queue.append(follow[c])
        end = int(np.flatnonzero(taken)[-1]) + 257
        pad = max(0, end - size)
        self.base, self.check, self.value = (np.concatenate([x, np.full(pad, fill, x.dtype)])[:end] for x, fill in ((base, 0), (check, -1), (value, -1)))

    def find(self, key: bytes) -> int:
        state = 0
        for c in key:
            follow = self.base[state] + c
            if follow >= len(self.check) or self.check[follow] != state or not self.base[state]:
                return -1
            state = follow
        return int(self.value[state])


class Codec:
    """Encoder and decoder of a vocabulary."""

    def __init__(self, pieces: Pieces):
        self.size = len(pieces.text)
        normal = np.flatnonzero(pieces.kind == NORMAL)
        raw = [p.replace(MARK, " ").encode() for p in pieces.text]
        if any(b" " in raw[i].lstrip(b" ") for i in normal):
            raise ValueError("a piece has a marker after another character")
        self.trie = DoubleArray([raw[i] for i in normal], normal.tolist())
        self.score = pieces.score
        self.unknown_score = float(pieces.score[normal].min()) - UNKNOWN_PENALTY if len(normal) else -UNKNOWN_PENALTY
        self.unknown_id = int(np.flatnonzero(pieces.kind == UNKNOWN)[0]) if (pieces.kind == UNKNOWN).any() else 0
        self.byte_id = np.full(256, -1, np.int64)
        for i in np.flatnonzero(pieces.kind == BYTE):
            self.byte_id[int(pieces.text[i][3:5], 16)] = i
            raw[i] = bytes([int(pieces.text[i][3:5], 16)])
        for i in np.flatnonzero(pieces.kind == CONTROL):
            raw[i] = b""
        for i in np.flatnonzero(pieces.kind == UNKNOWN):
            raw[i] = " ⁇ ".encode()
        self.is_byte = pieces.kind == BYTE
        self.out_len = np.fromiter(map(len, raw), np.int64, self.size)
        self.out_start = np.concatenate([[0], np.cumsum(self.out_len)])[:-1]
        self.out = np.frombuffer(b"".join(raw) or b"\0", np.uint8)

    # -- lattice --------------------------------------------------------------

    def _together(self, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best paths of many short chunks: (chunk, start, piece or -1 for an unknown character)."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        n, longest = len(starts), int(sizes.max())
        cells = np.zeros((longest, n), np.int64)
        for k in range(longest):
            cells[k] = buf[np.minimum(starts + k, len(buf) - 1)]
        best = np.full((longest + 1, n), -np.inf)
        best[0] = 0
        from_ = np.zeros((longest + 1, n), np.int16)
        piece = np.full((longest + 1, n), -1, np.int32)
        for s in range(longest):
            rows = np.flatnonzero((sizes > s) & (best[s] > -np.inf))
            if not len(rows):
                continue
            lead = cells[s, rows]
            width = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            single = np.zeros(len(rows), bool)
            here = best[s, rows]
            alive, state, d = np.arange(len(rows)), np.zeros(len(rows), np.int64), 0
            while len(alive):
                r = rows[alive]
                nxt = base[state] + cells[s + d, r]
                ok = (check[nxt] == state) & (base[state] > 0)
                alive, nxt, r = alive[ok], nxt[ok], r[ok]
                d += 1
                hit = np.flatnonzero(value[nxt] >= 0)
                if len(hit):
                    ids, at = value[nxt[hit]], r[hit]
                    total = here[alive[hit]] + self.score[ids]
                    better = total > best[s + d, at]
                    at, ids = at[better], ids[better]
                    best[s + d, at] = total[better]
                    from_[s + d, at] = s
                    piece[s + d, at] = ids
                    single[alive[hit]] |= width[alive[hit]] == d
                more = sizes[r] > s + d
                alive, state = alive[more], nxt[more]
            lone = np.flatnonzero(~single)
            if len(lone):
                at = rows[lone]
                to = np.minimum(s + width[lone], sizes[at])
                total = here[lone] + self.unknown_score
                better = total > best[to, at]
                at, to = at[better], to[better]
                best[to, at] = total[better]
                from_[to, at] = s
                piece[to, at] = -1
        rows, at = np.arange(n), sizes.copy()
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        while len(rows):
            start = from_[at, rows].astype(np.int64)
            got.append((rows, start, piece[at, rows].astype(np.int64), at - start))
            rows, at = rows[start > 0], start[start > 0]
        return tuple(np.concatenate([g[k] for g in got]) for k in range(4))  # type: ignore[return-value]

    def _alone(self, raw: bytes) -> list[tuple[int, int, int]]:
        """Best path of one chunk: (start, piece or -1, bytes)."""
        base, check, value = self._lists()
        n = len(raw)
        best, back = [-np.inf] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        for s in range(n):
            if best[s] == -np.inf:
                continue
            c = raw[s]
            width, single, state = 1 + (c >= 0xC0) + (c >= 0xE0) + (c >= 0xF0), False, 0
            for e in range(s, n):
                nxt = base[state] + raw[e]
                if not base[state] or check[nxt] != state:
                    break
                state, v = nxt, value[nxt]
                if v >= 0:
                    single |= e + 1 - s == width
                    if best[s] + self.score[v] > best[e + 1]:
                        best[e + 1], back[e + 1] = best[s] + self.score[v], (s, v)
            to = min(s + width, n)
            if not single and best[s] + self.unknown_score > best[to]:
                best[to], back[to] = best[s] + self.unknown_score, (s, -1)
        path, at = [], n
        while at:
            s, v = back[at]
            path.append((s, v, at - s))
            at = s
        return path

    def _lists(self) -> tuple[list[int], list[int], list[int]]:
        if not hasattr(self, "_plain"):
            self._plain = (self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist())
        return self._plain

    def _segment(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each chunk as a ragged array."""
        sizes = ends - starts
        order = np.argsort(sizes, kind="stable")
        short = order[sizes[order] <= LONG_CHUNK]
        found: list[tuple[np.ndarray, ...]] = []
        # chunks of like length together, and few enough that the lattice stays small
        i = 0
        while i < len(short):
            j = min(len(short), i + 20_000, int(np.searchsorted(sizes[short], max(8, 2 * sizes[short[i]]), "right")))
            part = short[i:j]
            row, start, ids, size = self._together(buf, starts[part], sizes[part])
            found.append((part[row], start, ids, size))
            i = j
        for k in order[len(short) :].tolist():
            path = np.array(self._alone(buf[starts[k] : ends[k]].tobytes()), np.int64).reshape(-1, 3)
            found.append((np.full(len(path), k), path[:, 0], path[:, 1], path[:, 2]))
        chunk, start, ids, size = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4))
        # unknown characters become their bytes
        times = np.where((ids < 0) & (self.byte_id[0] >= 0), size, 1)
        which = np.repeat(np.arange(len(ids)), times)
        step = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        chunk, start, ids = chunk[which], start[which] + step, ids[which]
        raw = ids < 0
        ids[raw] = self.byte_id[buf[starts[chunk[raw]] + start[raw]]] if self.byte_id[0] >= 0 else self.unknown_id
        key = np.lexsort((start, chunk))
        return ids[key], np.concatenate([[0], np.cumsum(np.bincount(chunk, minlength=len(starts)))])

    # -- batches --------------------------------------------------------------

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and each text's range of them."""
        import pandas as pd

        text = pc.fill_null(column, "")
        if pc.any(pc.match_substring(text, MARK)).as_py():
            text = pc.replace_substring(text, MARK, " ")
        text = pc.if_else(pc.equal(pc.binary_length(text), 0), text, pc.binary_join_element_wise(pa.scalar(" ", text.type), text, pa.scalar("", text.type)))
        t = Texts(text)
        space = t.bytes == 32
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        edges = t.offsets[:-1][np.diff(t.offsets) > 0]
        begin[edges] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], t.size)[: len(starts)]
        per_text = np.searchsorted(starts, t.offsets)
        codes, uniques = pd.factorize(t.hash_ranges(starts, ends))
        first = np.full(len(uniques), len(codes), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        ids, at = self._segment(t.buf, starts[first], ends[first])
        size = np.diff(at)[codes]
        total = np.concatenate([[0], np.cumsum(size)])
        gather = np.repeat(at[codes] - total[:-1], size) + np.arange(int(total[-1]))
        return ids[gather].astype(np.int32), total[per_text]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of ranges of ids; bytes that are no UTF-8 become U+FFFD."""
        size = self.out_len[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        gather = np.repeat(self.out_start[ids] - total[:-1], size) + np.arange(int(total[-1]))
        raw = self.out[gather].tobytes()
        at = total[offsets].tolist()
        texts = []
        for i, j in zip(at, at[1:]):
            texts.append(raw[i + (raw[i : i + 1] == b" ") : j].decode("utf-8", "replace") if j > i else "")
        return texts


def encode_decode(docs: DataFrame, pieces: Pieces, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, and decode what was encoded.

    Returns doc_id, ids, byte_tokens (bytes given by fallback), decoded and
    round_trip.  Null and empty texts have no ids and
    decode to an empty string.  A text that holds the marker character itself
    decodes with a space in its place; round_trip is then false.  Every input
    row gives one row.
    """
    small_batches(docs.sparkSession)
    codec = docs.sparkSession.sparkContext.broadcast(Codec(pieces))  # of the vocabulary's size
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec.value
        for part in slices(batches):
            column = part.column(1)
            ids, offsets = c.encode(column)
            decoded = pa.array(c.decode(ids, offsets), pa.string())
            fallback = np.concatenate([[0], np.cumsum(c.is_byte[ids])])[offsets]
            same = pc.equal(decoded, pc.fill_null(column, ""))
            listed = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([part.column(0), listed, pa.array(np.diff(fallback)), decoded, same], ["doc_id", "ids", "byte_tokens", "decoded", "round_trip"])

    return rows.mapInArrow(run, "doc_id long, ids array<int>, byte_tokens long, decoded string, round_trip boolean")
