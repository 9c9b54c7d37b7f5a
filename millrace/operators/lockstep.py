"""The arithmetic coder of :mod:`coding` over many texts at once, by an adaptive byte bigram model.

Texts step together: step t codes byte t of each text that has one, in numpy
arrays over texts.  What the model knows before each byte does not depend on the
coder, so its counts are found first, for all bytes together.  The code is the
coder's low end without the bits that wait for a carry: the sum of what each byte
adds to the low end, which carries like any sum.

The decoder follows the text: it holds its own value, read from the code, and at
each byte asks whether the value lies in that byte's share.  Shares do not
overlap, so the decoder gives the text back exactly where the answer is yes for
each byte.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_MASK, _TOP, _QUARTER = (1 << 32) - 1, 1 << 31, 1 << 30
#: What an occurrence adds to a byte's count of 1, and texts beyond which 32 bits are too few for the counts.
STEP, LONGEST = 32, 1 << 24
#: So few texts are coded one by one.
FEW = 32


#: Bytes whose counts are found together, so that the arrays for it stay small.
BLOCK = 1 << 18


def _known(text: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte, how often its context came before, followed by a smaller byte, by an equal one, and at all; 0 for a text's first byte.

    Bytes are sorted by text and context, in their order, and then parted bit by
    bit: of two bytes that agree so far the smaller has a 0 where the greater has a 1.
    """
    less, equal, all_ = (np.zeros(len(text), np.int32) for _ in range(3))
    at = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    if not len(at):
        return less, equal, all_
    key = np.sort(((doc[at] - doc[0]).astype(np.int64) << 8 | text[at - 1]) << 32 | at)  # unique keys need no stable sort
    at, context = (key & 0xFFFFFFFF).astype(np.int32), key >> 32
    number = np.arange(len(at), dtype=np.int32)
    begins = np.concatenate([[True], context[1:] != context[:-1]])
    start = np.maximum.accumulate(np.where(begins, number, np.int32(0)))
    bounds = np.append(np.flatnonzero(begins), len(at)).astype(np.int32)
    stop = np.repeat(bounds[1:], np.diff(bounds))
    all_[at] = number - start
    symbol, sums = text[at], np.zeros(len(at), np.int32)
    for b in range(7, -1, -1):
        one = (symbol >> b & 1).astype(bool)
        if not one.any():
            continue
        zeros = np.zeros(len(at) + 1, np.int32)
        np.cumsum(~one, dtype=np.int32, out=zeros[1:])
        base = zeros[start]
        before, middle = zeros[:-1] - base, start + zeros[stop] - base
        sums += np.where(one, before, np.int32(0))
        to = np.where(one, middle + number - start - before, start + before)
        start, stop = np.where(one, middle, start), np.where(one, stop, middle)
        moved = [np.empty_like(x) for x in (at, symbol, sums, start, stop)]
        for new, old in zip(moved, (at, symbol, sums, start, stop)):
            new[to] = old
        at, symbol, sums, start, stop = moved
    less[at], equal[at] = sums, number - start
    return less, equal, all_


def _leading(x: np.ndarray) -> np.ndarray:
    """Leading zeros of 32-bit numbers."""
    return (32 - np.frexp(x.astype(np.float64))[1]).astype(np.uint64)


def _narrowed(low, high, below, upto, total):
    """The interval cut to a share and doubled: low, high, what came on top of low, shared bits, bits that wait."""
    span = high - low + np.uint64(1)
    added = span * below // total
    high = low + span * upto // total - np.uint64(1)
    low = low + added
    same = _leading(low ^ high)
    low = low << same & np.uint64(_MASK)
    high = (high << same | (np.uint64(1) << same) - np.uint64(1)) & np.uint64(_MASK)
    wait = _leading(~((low & ~high) << np.uint64(1)) & np.uint64(_MASK))
    low = low << wait & np.uint64(_TOP - 1)
    high = high << wait & np.uint64(_MASK) | (np.uint64(1) << wait) - np.uint64(1) | np.uint64(_TOP)
    return low, high, added, same, wait


def _narrowed_one(low: int, high: int, below: int, upto: int, total: int) -> tuple[int, int, int, int, int]:
    """:func:`_narrowed` of one text."""
    span = high - low + 1
    added = span * below // total
    low, high = low + added, low + span * upto // total - 1
    same = 32 - (low ^ high).bit_length()
    low, high = low << same & _MASK, (high << same | (1 << same) - 1) & _MASK
    wait = 32 - (~((low & ~high) << 1) & _MASK).bit_length()
    return low << wait & _TOP - 1, high << wait & _MASK | (1 << wait) - 1 | _TOP, added, same, wait


class Texts:
    """Texts laid out for the coder: sorted by length, longest first, all bytes of a step together."""

    def __init__(self, texts: Sequence[bytes]):
        self.size = np.array([len(t) for t in texts], np.int64)
        self.order = np.argsort(-self.size, kind="stable")
        length = self.size[self.order]
        longest = int(length[0]) if len(length) else 0
        #: How many texts have a byte at each step, and where the step's bytes begin.
        self.active = np.searchsorted(-length, -np.arange(longest), "left")
        self.begin = np.concatenate([[0], np.cumsum(self.active)])
        n = int(length.sum())
        self.below, self.upto, self.total = (np.zeros(n, np.uint32) for _ in range(3))
        self.doc = np.empty(n, np.int32)
        ends, i = np.cumsum(length), 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - length[i] + BLOCK, "right")))
            text = np.frombuffer(b"".join(texts[k] for k in self.order[i:j]), np.uint8)
            doc = np.repeat(np.arange(i, j, dtype=np.int32), length[i:j])
            place = self.begin[np.arange(len(text)) - np.repeat(ends[i:j] - length[i:j] - (ends[i] - length[i]), length[i:j])] + doc
            less, equal, all_ = _known(text, doc)
            self.below[place] = low = text + np.uint32(STEP) * less.astype(np.uint32)
            self.upto[place] = low + np.uint32(STEP) * equal.astype(np.uint32) + np.uint32(1)
            self.total[place] = np.uint32(256) + np.uint32(STEP) * all_.astype(np.uint32)
            self.doc[place] = doc
            i = j
        #: From this step on so few texts are left that each goes on by itself.
        self.turn = int(np.searchsorted(-self.active, -FEW, "right"))

    def shares(self, step: int) -> tuple[slice, np.ndarray, np.ndarray, np.ndarray]:
        rows = slice(int(self.begin[step]), int(self.begin[step + 1]))
        return rows, *(x[rows].astype(np.uint64) for x in (self.below, self.upto, self.total))

    def alone(self) -> list[tuple[int, np.ndarray, list[int], list[int], list[int]]]:
        """Of each text that is longer than the common steps: its number, and its places and shares beyond them."""
        left = int(self.active[self.turn]) if self.turn < len(self.active) else 0
        out = []
        for j in range(left):
            rows = self.begin[self.turn : len(self.active)][self.active[self.turn :] > j] + j
            out.append((j, rows, *(x[rows].tolist() for x in (self.below, self.upto, self.total))))
        return out

    def encode(self) -> list[bytes]:
        """Codes of the texts in their given order: a 4-byte count and the bits."""
        n = len(self.size)
        low, high, at = np.zeros(n, np.uint64), np.full(n, _MASK, np.uint64), np.zeros(n, np.int64)
        added, place = np.zeros(len(self.doc), np.uint32), np.zeros(len(self.doc), np.uint32)
        for t in range(self.turn):
            rows, *share = self.shares(t)
            k = rows.stop - rows.start
            low[:k], high[:k], added[rows], same, wait = _narrowed(low[:k], high[:k], *share)
            place[rows] = at[:k]
            at[:k] += (same + wait).astype(np.int64)
        for j, rows, below, upto, total in self.alone():
            l, h, p, adds, places = int(low[j]), int(high[j]), int(at[j]), [], []
            for b, u, t in zip(below, upto, total):
                l, h, add, same, wait = _narrowed_one(l, h, b, u, t)
                adds.append(add)
                places.append(p)
                p += same + wait
            low[j], high[j], at[j], added[rows], place[rows] = l, h, p, adds, places
        # the last two bits pick a number in the interval
        last = np.where(low < _QUARTER, _QUARTER, 1 << 31).astype(np.uint64) - low
        coded = (at + 2 + 7) // 8
        self.offset = np.cumsum(coded + 24) - coded - 16  # 8 bytes before each code and 16 after it are 0
        space = int((coded + 24).sum())
        whole = np.zeros(space, np.uint64)  # at byte i: bytes i - 3 to i + 4

        def add(values: np.ndarray, bit: np.ndarray, doc: np.ndarray) -> None:
            byte = self.offset[doc] + (bit >> 3)
            np.add.at(whole, byte, values.astype(np.uint64) << (np.uint64(8) - (bit & 7).astype(np.uint64)))

        for i in range(0, len(added), 1 << 20):
            part = slice(i, i + (1 << 20))
            add(added[part], place[part].astype(np.int64), self.doc[part])
        add(last, at, np.arange(n))
        wide = np.zeros(space, np.int64)
        for b in range(8):
            part = (whole >> np.uint64(8 * (7 - b)) & np.uint64(255)).astype(np.int64)
            move = b - 3
            if move < 0:
                wide[:move] += part[-move:]
            else:
                wide[move:] += part[: space - move]
        number = int.from_bytes((wide & 255).astype(np.uint8).tobytes(), "big") + (int.from_bytes((wide >> 8).astype(np.uint8).tobytes(), "big") << 8)
        data = number.to_bytes(space, "big")
        out = [b""] * n
        for k, i in enumerate(self.order):
            count = int(self.size[i])
            out[i] = count.to_bytes(4, "big") + (data[self.offset[k] : self.offset[k] + coded[k]] if count else b"")
        return out

    def decodes(self, codes: Sequence[bytes]) -> np.ndarray:
        """Whether the decoder gives each text for its code."""
        n = len(self.size)
        size = np.array([max(len(codes[i]) - 4, 0) for i in self.order], np.int64)
        offset = np.cumsum(size + 16) - size - 16
        data = np.frombuffer(b"".join(codes[i][4:] + bytes(16) for i in self.order), np.uint8).astype(np.uint64)
        window = np.zeros(len(data), np.uint64)  # 40 bits from each byte on
        for b in range(5):
            window[: len(data) - 4] |= data[b : len(data) - 4 + b] << np.uint64(8 * (4 - b))
        last = offset + size + 8  # bits past the end are 0

        def bits(at: np.ndarray, k: int) -> np.ndarray:
            """32 bits from a place on."""
            byte = np.minimum(offset[:k] + (at >> 3), last[:k])
            return window[byte] >> (np.uint64(8) - (at & 7).astype(np.uint64)) & np.uint64(_MASK)

        low, high, at = np.zeros(n, np.uint64), np.full(n, _MASK, np.uint64), np.zeros(n, np.int64)
        value = bits(at, n)
        good = np.array([int.from_bytes(codes[i][:4], "big") == self.size[i] for i in self.order], bool)
        for t in range(self.turn):
            rows, below, upto, total = self.shares(t)
            k = rows.stop - rows.start
            l, h, v = low[:k], high[:k], value[:k]
            scaled = ((v - l + np.uint64(1)) * total - np.uint64(1)) // (h - l + np.uint64(1))
            good[:k] &= (v >= l) & (v <= h) & (below <= scaled) & (scaled < upto)
            low[:k], high[:k], _, same, wait = _narrowed(l, h, below, upto, total)
            both = v << np.uint64(32) | bits(at[:k] + 32, k)
            value[:k] = (both << same) >> np.uint64(32) & np.uint64(_TOP) | (both << same + wait) >> np.uint64(32) & np.uint64(_TOP - 1)
            at[:k] += (same + wait).astype(np.int64)
        for j, _, below, upto, total in self.alone():
            l, h, v, p, fine = int(low[j]), int(high[j]), int(value[j]), int(at[j]), bool(good[j])
            begin, end = int(offset[j]), int(last[j])
            for b, u, t in zip(below, upto, total):
                scaled = ((v - l + 1) * t - 1) // (h - l + 1)
                if not (fine and l <= v <= h and b <= scaled < u):
                    fine = False
                    break
                l, h, _, same, wait = _narrowed_one(l, h, b, u, t)
                q = p + 32
                both = v << 32 | int(window[min(begin + (q >> 3), end)]) >> 8 - (q & 7) & _MASK
                v = (both << same) >> 32 & _TOP | (both << same + wait) >> 32 & _TOP - 1
                p += same + wait
            good[j] = fine
        out = np.empty(n, bool)
        out[self.order] = good
        return out


def round_trips(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each text's code, and whether the text comes back from it."""
    laid = Texts(texts)
    codes = laid.encode()
    return np.array([len(c) for c in codes], np.int64), laid.decodes(codes)
