"""Suffix-array dedup: maximal repeats from a common-prefix interval tree.

Every byte that lies in a string of ``length`` bytes which also starts anywhere
else is removed.  The corpus does not fit one suffix array, so suffixes are
sampled so that no repeat is lost: in every window of ``length`` bytes the
leftmost least-hashed string of ``anchor`` bytes is its anchor, and equal windows
have their anchors at equal places.  Only suffixes that start at anchors are
sorted, and only those whose anchor occurs more than once:

1. Anchors are counted by hash; anchors that occur once are dropped.
2. An anchor's context is all the text of the windows that chose it.  Contexts
   that occur twice as a whole are repeats throughout, and are found by
   aggregation, so copies of any number cost one row for each task.
3. The other contexts of a repeated anchor are compared as bytes: suffixes from
   the anchor on are sorted into an enhanced suffix array, a scan with a stack
   gives its common-prefix intervals, and in each interval the occurrences are
   split by their left extensions.  Occurrences with a common left extension
   form a maximal repeat; all of them are put out, not just neighbours.
4. The tree of an anchor with more contexts than one array holds (a passage in
   very many documents: the contexts at its two ends all differ) is cut into
   subtrees by longer common strings.  A window that holds its anchor ``t`` bytes
   after its start has, for ``t`` in one of some strides, a core in common with
   all windows of that stride; contexts with equal cores form a subtree, in which
   only the few bytes around the core differ and are sorted.  Equal surroundings
   are one row, whatever their number.  A subtree that is still too large has as
   many levels as a stride has bytes and is laid out level by level.

All ranges found for a context hold its anchor, so they make up one interval.
Hashes of contexts and cores have 128 bits.

With ``words`` the same is done to words in place of bytes: lengths and places
count words, a word is the 64-bit hash of its bytes, and what stands between
words does not matter.  Contexts travel as bytes and are cut into words again.
A text of any length is looked at in overlapping pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import Texts, checkpoint, grouped, mix, seg_sum, shuffle_width, slices, small_batches

_U = np.uint64
#: Bytes of text whose anchors are sought at once; some ten words of memory go with each.
ANCHOR_SLICE = 1 << 19
#: Contexts that are put into one suffix array; whole anchors only.
TREE_ROWS = 5_000
#: Bytes or words of one text whose windows are looked at together.
PIECE = 1 << 20
_BASES = (_U(0x9E3779B97F4A7C55), _U(0xC2B2AE3D27D4EB4F))


@dataclass(frozen=True)
class Repeats:
    """Length of a repeat and of an anchor (bytes, or words with ``words``), and how many contexts one suffix array holds of an anchor."""

    length: int = 400
    anchor: int = 128
    tree_contexts: int = 1000
    words: bool = False

    @property
    def stride(self) -> int:
        """Window starts that share a core: so many that cores and levels of a subtree are about equally many."""
        return min(self.anchor, max(1, round((self.length - self.anchor) ** 0.5)))


@lru_cache(maxsize=2)
def _byte_values(which: int) -> np.ndarray:
    return np.random.default_rng(97 + which).integers(0, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, ANCHOR_SLICE + (1 << 17))
        base = int(_BASES[which])
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.empty(size, _U)
            t[0], done = 1, 1
            while done < size:
                step = min(done, size - done)
                t[done : done + step] = t[:step] * _U(pow(b, done, 1 << 64))
                done += step
            out.append(t)
        _powers[which] = have = (out[0], out[1])
    return have


def units(texts: Texts, rule: Repeats) -> tuple[np.ndarray, np.ndarray]:
    """What repeats are made of, bytes or hashes of words, and each document's first one."""
    if not rule.words:
        return texts.bytes, texts.offsets
    texts.words()
    return texts.word_hashes(), texts.word_offsets


class Rolling:
    """Hashes of any ranges of bytes or of word hashes by prefix sums."""

    def __init__(self, data: np.ndarray, which: int):
        self.up, self.down = _power_tables(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, _U)
        terms = _byte_values(which)[data] if data.dtype == np.uint8 else mix(data + _BASES[which])
        terms *= self.up[: len(data)]
        np.cumsum(terms, out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        out = self.sums[width:] - self.sums[:n]
        out *= self.down[:n]
        return mix(out)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` successive ones."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(_U).max, _U)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _runs(data: np.ndarray, first: Rolling, offsets: np.ndarray, w: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of successive windows that chose the same anchor: first and last window, place of the anchor."""
    grams = first.every(k)
    bits = len(grams).bit_length()
    low = _U((1 << bits) - 1)
    packed = (grams & ~low) | np.arange(len(grams), dtype=_U)
    chosen = (sliding_least(packed, w - k + 1) & low).astype(np.int64)
    # windows inside a document
    inside = np.zeros(len(chosen) + 1, np.int8)
    long_ = np.flatnonzero(np.diff(offsets) >= w)
    inside[offsets[long_]] += 1
    np.subtract.at(inside, np.minimum(offsets[long_ + 1] - w + 1, len(chosen)), 1)
    start = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int64) > 0)
    place = chosen[start]
    new = np.r_[True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]
    at = np.flatnonzero(new)
    return start[at], start[np.append(at[1:], len(start)) - 1], place[at]


def _described(first: Rolling, second: Rolling, base: int, begin: np.ndarray, last: np.ndarray, place: np.ndarray, rule: Repeats) -> dict[str, np.ndarray]:
    """Hashes of anchors and contexts of runs, by sums over the data from ``base`` on."""
    w, k = rule.length, rule.anchor
    begin, last, place = begin - base, last - base, place - base
    return {"hash": first.at(place, place + k), "one": first.at(begin, last + w), "two": second.at(begin, last + w)}


def find_anchors(texts: Texts, rule: Repeats) -> dict[str, np.ndarray]:
    """Anchors of a slice: document, place, hash, context hashes, the context's reach to the left and right, and its bytes."""
    w, k = rule.length, rule.anchor
    data, offsets = units(texts, rule)
    names = ("doc", "place", "hash", "one", "two", "left", "right", *_bytes_of(rule))
    if len(data) < w or not (np.diff(offsets) >= w).any():
        return {name: np.zeros(0, _U if name in ("hash", "one", "two") else np.int64) for name in names}
    if len(data) <= PIECE + w:
        first = Rolling(data, 0)
        begin, last, place = _runs(data, first, offsets, w, k)
        hashes = _described(first, Rolling(data, 1), 0, begin, last, place, rule)
    else:  # pieces that overlap by a window; a run goes on over the border
        found = []
        for low in range(0, len(data) - w + 1, PIECE):
            part = data[low : low + PIECE + w - 1]
            edges = np.clip(offsets - low, 0, len(part))
            if (np.diff(edges) >= w).any():
                found.append([x + low for x in _runs(part, Rolling(part, 0), edges, w, k)])
        begin, last, place = (np.concatenate(x) for x in zip(*found))
        new = np.r_[True, (place[1:] != place[:-1]) | (begin[1:] != last[:-1] + 1)]
        at = np.flatnonzero(new)
        begin, last, place = begin[at], last[np.append(at[1:], len(last)) - 1], place[at]
        parts, i = [], 0
        while i < len(begin):
            j = max(i + 1, int(np.searchsorted(begin, begin[i] + PIECE)))
            low, high = int(begin[i]), int(last[i:j].max()) + w
            part = data[low:high]
            parts.append(_described(Rolling(part, 0), Rolling(part, 1), low, begin[i:j], last[i:j], place[i:j], rule))
            i = j
        hashes = {n: np.concatenate([p[n] for p in parts]) for n in ("hash", "one", "two")}
    doc = np.searchsorted(offsets, begin, "right") - 1
    size = {}
    if rule.words:
        first_byte = texts.starts[begin]
        size = {"first_byte": first_byte - texts.offsets[doc], "n_bytes": texts.ends[last + w - 1] - first_byte}
    return {"doc": doc, "place": place - offsets[doc], **hashes, "left": place - begin, "right": last + w - place, **size}


# -- the interval tree --------------------------------------------------------


def prefix_intervals(common: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals (length, first, last) of a suffix array by a scan with a stack.

    ``common[i]`` is the longest common prefix of the suffixes i - 1 and i, and
    0 at i = 0.
    """
    stack: list[tuple[int, int]] = [(0, 0)]
    values = common.tolist()
    for i in range(1, len(values) + 1):
        here = values[i] if i < len(values) else 0
        begin = i - 1
        while stack and stack[-1][0] > here:
            length, begin = stack.pop()
            yield length, begin, i - 1
        if not stack or stack[-1][0] < here:
            stack.append((here, begin))


def _matrix(strings: list[bytes], width: int, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes, or of words of ``unit`` 8 bytes, and how many each has; ``width`` counts bytes."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    out = np.zeros((len(strings), width), np.uint8)
    inside = np.arange(width) < size[:, None]
    out[inside] = np.frombuffer(b"".join(strings), np.uint8)
    return (out, size) if unit == 1 else (out.view(_U), size // unit)


def _agreement(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Equal leading bytes of rows of two matrices, at most ``most``."""
    differs = a != b
    first = np.where(differs.any(1), differs.argmax(1), a.shape[1])
    return np.minimum(first, most)


def maximal_repeats(group: np.ndarray, before: list[bytes], after: list[bytes], length: int, unit: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Maximal repeats of anchored strings: (occurrences, each one's common left extension, right extent).

    ``before`` is the text before an anchor, ``after`` that from it on; only
    strings of the same group are compared.  Each yield is a class of all
    occurrences in a common-prefix interval whose left extensions agree so far
    that the repeat has ``length`` bytes or more; an occurrence's left extension
    is the longest that it shares with another one of the class.  With ``unit``
    8 strings are words of 8 bytes, and all lengths count words.
    """
    n = len(after)
    back = [s[::-1] for s in before]
    width = max(map(len, after), default=unit) or unit
    order = np.array(sorted(range(n), key=lambda i: (group[i], after[i])), np.int64)
    right, right_size = _matrix([after[i] for i in order], width, unit)
    g = group[order]
    common = np.zeros(n, np.int64)
    if n > 1:
        common[1:] = np.where(g[1:] == g[:-1], _agreement(right[1:], right[:-1], np.minimum(right_size[1:], right_size[:-1])), 0)
    left_width = max(map(len, before), default=0) or unit
    left, left_size = _matrix(back, left_width, unit)
    rank = np.empty(n, np.int64)
    rank[sorted(range(n), key=lambda i: (group[i], back[i]))] = np.arange(n)
    pairs: list[tuple[int, int, int]] = []
    for extent, first, last in prefix_intervals(common):
        if extent + left_width // unit < length:
            continue
        if last == first + 1:
            pairs.append((extent, order[first], order[last]))
            continue
        members = order[first : last + 1]
        members = members[np.argsort(rank[members])]
        shared = _agreement(left[members[1:]], left[members[:-1]], np.minimum(left_size[members[1:]], left_size[members[:-1]]))
        # left extensions that differ too early split the interval
        cut = np.flatnonzero(shared < length - extent) + 1
        for part in np.split(np.arange(len(members)), cut):
            if len(part) > 1:
                inner = shared[part[0] : part[-1]]
                yield members[part], np.maximum(np.r_[inner, 0], np.r_[0, inner]), extent
    if pairs:
        extents, a, b = (np.array(x, np.int64) for x in zip(*pairs))
        for i in range(0, len(a), 20_000):
            x, y, e = a[i : i + 20_000], b[i : i + 20_000], extents[i : i + 20_000]
            shared = _agreement(left[x], left[y], np.minimum(left_size[x], left_size[y]))
            for j in np.flatnonzero(shared + e >= length).tolist():
                yield np.array([x[j], y[j]]), np.array([shared[j], shared[j]]), int(e[j])


def _reach(repeats: Iterator[tuple[np.ndarray, np.ndarray, int]], n: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Rows that occur in a repeat, and how far the repeats of each go to the left and to the right together."""
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for members, extension, extent in repeats:
        left[members] = np.maximum(left[members], extension)
        right[members] = np.maximum(right[members], extent)
    at = np.flatnonzero(right)
    return pa.array(at), left[at], right[at]


# -- the plan -----------------------------------------------------------------

_KEY = ["hash", "one", "two", "left", "right"]
_KEY_TYPES = "hash long, one long, two long, left int, right int"
#: A core: the first window start of its stride and its hash; and the bytes around it.
_SUBTREE = ["first", "core_one", "core_two"]
_CORE = [*_SUBTREE, "before", "after"]
_CORE_TYPES = "first int, core_one long, core_two long, before binary, after binary"


def _bytes_of(rule: Repeats) -> list[str]:
    """Columns that say which bytes a context of words is."""
    return ["first_byte", "n_bytes"] if rule.words else []


def anchors(docs: DataFrame, rule: Repeats) -> DataFrame:
    """Anchors of (doc_id, check, text) rows."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=ANCHOR_SLICE):
            a = find_anchors(Texts(part.column("text")), rule)
            at = pa.array(a["doc"])
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array(a[k].view(np.int64)) for k in ("hash", "one", "two")],
                    *[pa.array(a[k].astype(np.int32)) for k in ("left", "right")],
                    part.column("doc_id").take(at),
                    part.column("check").take(at),
                    pa.array(a["place"]),
                    *[pa.array(a[k]) for k in _bytes_of(rule)],
                ],
                [*_KEY, "doc_id", "check", "place", *_bytes_of(rule)],
            )

    return docs.mapInArrow(run, f"{_KEY_TYPES}, doc_id long, check long, place long" + "".join(f", {k} long" for k in _bytes_of(rule)))


def _tree_task(rule: Repeats):
    """Repeated ranges around the anchors of sorted context rows, by the interval tree."""

    def ranges(rows: pa.Table) -> pa.RecordBatch:
        text, left = rows.column("context").to_pylist(), rows.column("left").to_pylist()
        unit = 8 if rule.words else 1
        if rule.words:
            h, o = units(Texts(rows.column("context")), rule)
            text = [h[o[i] : o[i + 1]].tobytes() for i in range(len(text))]
            left = [8 * k for k in left]
        group = np.unique(rows.column("hash").to_numpy(), return_inverse=True)[1]
        at, before, after = _reach(maximal_repeats(group, [t[:k] for t, k in zip(text, left)], [t[k:] for t, k in zip(text, left)], rule.length, unit), len(text))
        keys = [rows.column(k).combine_chunks().take(at) for k in _KEY]
        return pa.RecordBatch.from_arrays([*keys, pa.array(-before), pa.array(after)], [*_KEY, "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= TREE_ROWS:  # whole anchors only
                table = pa.Table.from_batches(held)
                h = table.column("hash").to_numpy()
                at = int(np.searchsorted(h, h[-1], "left"))
                if at:
                    yield ranges(table.slice(0, at))
                    held = table.slice(at).combine_chunks().to_batches()
                    n = table.num_rows - at
        if n:
            yield ranges(pa.Table.from_batches(held))

    return run


def _cores_task(rule: Repeats):
    """Each context once for each stride of window starts: the hash of the core and the bytes around it."""
    stride, unit = rule.stride, 8 if rule.words else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = units(Texts(b.column("context")), rule)
            raw = data.tobytes()
            sums = [Rolling(data, i) for i in (0, 1)]
            low, high = offsets[:-1], offsets[1:]
            at = low + b.column("left").to_numpy()
            out = []
            for first in range(0, rule.length - rule.anchor + 1, stride):
                begin, end = at - first, at - first + rule.length - stride + 1
                rows = np.flatnonzero((begin >= low) & (end <= high))
                begin, end = begin[rows], end[rows]
                far, near = np.maximum(begin - stride + 1, low[rows]), np.minimum(end + stride - 1, high[rows])
                some = (begin - far) + (near - end) >= stride - 1  # at least one window
                rows, begin, end, far, near = (x[some] for x in (rows, begin, end, far, near))
                before = [raw[i * unit : j * unit] for i, j in zip(far.tolist(), begin.tolist())]
                after = [raw[i * unit : j * unit] for i, j in zip(end.tolist(), near.tolist())]
                take = pa.array(rows)
                hashes = [pa.array(s.at(begin, end).view(np.int64)) for s in sums]
                out.append([*[b.column(k).take(take) for k in _KEY], pa.array(np.full(len(rows), first, np.int32)), *hashes, pa.array(before, pa.binary()), pa.array(after, pa.binary())])
            for columns in out:
                yield pa.RecordBatch.from_arrays(columns, [*_KEY, *_CORE])

    return run


def _subtree_task(rule: Repeats):
    """Repeated ranges around the cores of sorted rows of one core each, by the interval tree of what follows the core."""
    unit = 8 if rule.words else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in grouped(batches, _SUBTREE, TREE_ROWS):
            before, after = rows.column("before").to_pylist(), rows.column("after").to_pylist()
            group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            # what follows the core follows one unit that all have in common, so that the whole subtree is an interval too
            at, left, right = _reach(maximal_repeats(group, before, [b"\1" * unit + a for a in after], rule.stride, unit), rows.num_rows)
            columns = [rows.column(k).combine_chunks().take(at) for k in _CORE]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(left), pa.array(right - 1)], [*_CORE, "l", "r"])

    return run


def _ranges_of_subtrees(contexts: DataFrame, rule: Repeats) -> DataFrame:
    """Repeated ranges (key, begin, end) of anchors whose tree is cut into subtrees."""
    unit, stride = 8 if rule.words else 1, rule.stride
    listed = checkpoint(contexts.mapInArrow(_cores_task(rule), f"{_KEY_TYPES}, {_CORE_TYPES}"))
    kinds = checkpoint(listed.groupBy("hash", *_CORE).agg(F.count("*").alias("n")))
    sizes = checkpoint(kinds.groupBy("hash", *_SUBTREE).agg(F.count("*").alias("size")).where("size > 1"))
    whole = kinds.where("n > 1").select("hash", *_CORE, (F.octet_length("before") / unit).cast("long").alias("l"), (F.octet_length("after") / unit).cast("long").alias("r"))
    fits = sizes.where(F.col("size") <= rule.tree_contexts).select("hash", *_SUBTREE)
    subtree = kinds.join(fits, ["hash", *_SUBTREE]).select(*_CORE)
    wide = shuffle_width(contexts.sparkSession)
    tree = subtree.repartition(wide, *_SUBTREE).sortWithinPartitions(*_SUBTREE).mapInArrow(_subtree_task(rule), f"{_CORE_TYPES}, l long, r long")
    ranges = whole.select(*_CORE, "l", "r").unionByName(tree)
    large = sizes.where(F.col("size") > rule.tree_contexts).select("hash", *_SUBTREE)
    if not large.isEmpty():
        level = F.explode(F.sequence(F.lit(0), F.lit(stride - 1))).alias("l")
        l, r = F.col("l") * unit, (F.lit(stride - 1) - F.col("l")) * unit
        each = kinds.join(large, ["hash", *_SUBTREE]).select(*_CORE, level).where((F.octet_length("before") >= l) & (F.octet_length("after") >= r))
        each = each.withColumns({"x": F.expr(f"substring(before, int(octet_length(before) - l * {unit} + 1), int(l * {unit}))"), "y": F.expr(f"substring(after, 1, int(({stride} - 1 - l) * {unit}))")})
        twice = checkpoint(each.groupBy(*_SUBTREE, "l", "x", "y").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
        levels = each.join(twice, [*_SUBTREE, "l", "x", "y"]).groupBy(*_CORE).agg(F.max("l").cast("long").alias("l"), F.max(F.lit(stride - 1) - F.col("l")).cast("long").alias("r"))
        ranges = ranges.unionByName(levels)
    best = checkpoint(ranges.groupBy(*_CORE).agg(F.max("l").alias("l"), F.max("r").alias("r")))
    end = F.lit(rule.length - stride + 1) - F.col("first") + F.col("r")
    return listed.join(best, _CORE).select(*_KEY, (-F.col("first") - F.col("l")).cast("long").alias("begin"), end.cast("long").alias("end"))


def _contexts(wanted: DataFrame, docs: DataFrame, rule: Repeats) -> DataFrame:
    """Bytes of the contexts of (key, doc_id, check, place) rows."""
    d, w = docs.alias("d"), wanted.alias("w")
    joined = w.join(d, F.expr("d.doc_id <=> w.doc_id and d.check = w.check"))
    where = "int(w.first_byte + 1), int(w.n_bytes)" if rule.words else "int(w.place - w.left + 1), w.left + w.right"
    return joined.select(*[f"w.{k}" for k in _KEY], "w.contexts", F.expr(f"substring(cast(d.text as binary), {where})").alias("context"))


def repeated_ranges(docs: DataFrame, rule: Repeats) -> DataFrame:
    """Repeated ranges of bytes or words (doc_id, check, begin, end) of (doc_id, check, text) rows."""
    found = anchors(docs, rule)
    # counted apart from the join, so that the join's own shuffle can be split where an anchor is frequent
    often = checkpoint(found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    repeated = checkpoint(found.join(often, "hash"))
    # one row for each different context; the least place stands for it
    kinds = checkpoint(repeated.groupBy(*_KEY).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "check", "place", *_bytes_of(rule))).alias("at")))
    several = checkpoint(kinds.groupBy("hash").agg(F.count("*").alias("contexts")).where("contexts > 1"))
    kinds = checkpoint(kinds.join(several, "hash", "left").select(*_KEY, "n", F.coalesce("contexts", F.lit(1)).alias("contexts"), "at.doc_id", "at.check", "at.place", *[f"at.{k}" for k in _bytes_of(rule)]))
    whole = kinds.where("n > 1").select(*_KEY, (-F.col("left")).cast("long").alias("begin"), F.col("right").cast("long").alias("end"))
    partial = kinds.where("contexts > 1").drop("n")
    contexts = checkpoint(_contexts(partial, docs, rule))
    some = contexts.where(F.col("contexts") <= rule.tree_contexts)
    wide = shuffle_width(docs.sparkSession)
    tree = some.drop("contexts").repartition(wide, "hash").sortWithinPartitions("hash").mapInArrow(_tree_task(rule), f"{_KEY_TYPES}, begin long, end long")
    ranges = whole.unionByName(tree)
    many = contexts.where(F.col("contexts") > rule.tree_contexts)
    if not many.isEmpty():
        ranges = ranges.unionByName(_ranges_of_subtrees(many, rule))
    # every range of a context holds its anchor, so together they are one interval, and the join gives one row an occurrence
    ranges = checkpoint(ranges.groupBy(*_KEY).agg(F.min("begin").alias("begin"), F.max("end").alias("end")))
    return repeated.join(ranges, _KEY).select("doc_id", "check", (F.col("place") + F.col("begin")).alias("begin"), (F.col("place") + F.col("end")).alias("end"))


def _identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows with a checksum beside their id: rows of one id and different texts are different documents."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("check"), body.alias("text"))


def _spans(part: pa.RecordBatch, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes in the ranges of a slice's rows: row, begin and end in the slice; with words, from a range's first word to the end of its last one."""
    lists = part.column("ranges")
    owner = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(lists.offsets)) if lists.null_count == 0 else [len(x) if x is not None else 0 for x in lists.to_pylist()])
    flat = lists.flatten()
    begin, end = flat.field("begin").to_numpy(zero_copy_only=False), flat.field("end").to_numpy(zero_copy_only=False)
    of_words = np.zeros(len(owner), bool)
    if flat.type.num_fields == 3:
        of_words = flat.field("words").to_numpy(zero_copy_only=False).astype(bool)
        texts.words()
    begin, end = begin.astype(np.int64), end.astype(np.int64)
    if of_words.any():
        w = owner[of_words]
        first, last = texts.word_offsets[w] + begin[of_words], texts.word_offsets[w] + end[of_words] - 1
        begin[of_words], end[of_words] = texts.starts[first] - texts.offsets[w], texts.ends[last] - texts.offsets[w]
    begin, end = begin + texts.offsets[owner], end + texts.offsets[owner]
    order = np.lexsort((begin, owner))
    owner, begin, end = owner[order], begin[order], end[order]
    if not len(owner):
        return owner, begin, end
    reach = np.maximum.accumulate(end)  # documents follow one another
    at = np.flatnonzero(np.r_[True, (begin[1:] > reach[:-1]) | (owner[1:] != owner[:-1])])
    return owner[at], begin[at], reach[np.append(at[1:], len(reach)) - 1]


def _rest(texts: Texts, row: int, begin: list[int], end: list[int]) -> list[bytes]:
    """What lies between the spans of a row."""
    first = [int(texts.offsets[row]), *end]
    return [texts.buf[i:j].tobytes() for i, j in zip(first, [*begin, int(texts.offsets[row + 1])])]


def _with_ranges(docs: DataFrame, rules: tuple[Repeats, ...], doc_id: str, text: str, keep: list[str]) -> DataFrame:
    rows = _identified(docs, doc_id, text)
    marks = ["words"] if any(r.words for r in rules) else []
    each = [repeated_ranges(rows, r).withColumns({k: F.lit(r.words) for k in marks}) for r in rules]
    found = reduce(DataFrame.unionByName, each).groupBy("doc_id", "check").agg(F.collect_set(F.struct("begin", "end", *marks)).alias("ranges"))  # bounded by one text
    if keep:
        body = F.coalesce(F.col(text).cast("string"), F.lit(""))
        rows = docs.select(F.struct(*keep).alias("kept_row"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("check"))
    f = found.alias("f")
    r = rows.alias("r")
    none = F.array().cast("array<struct<begin:long,end:long" + (",words:boolean>>" if marks else ">>"))
    columns = [F.col(f"r.{c}") for c in rows.columns if c != "check"]
    return r.join(f, F.expr("r.doc_id <=> f.doc_id and r.check = f.check"), "left").select(*columns, F.coalesce("f.ranges", none).alias("ranges"))


def removed_bytes(docs: DataFrame, rule: Repeats = Repeats(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What dedup takes from each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (byte ranges).

    Texts are UTF-8 bytes; a null text is empty, and a text shorter than
    ``rule.length`` loses nothing.  Rows that repeat are occurrences like any
    other.  Every input row gives one row.
    """
    joined = _with_ranges(docs, (rule,), doc_id, text, [])
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=ANCHOR_SLICE):
            texts = Texts(part.column("text"))
            o = texts.offsets
            row, begin, end = _spans(part, texts)
            at = np.searchsorted(row, np.arange(texts.n + 1))
            n_spans = np.diff(at)
            n_removed = seg_sum(end - begin, at)
            digest, spans = [], []
            for i in range(texts.n):
                x, y = begin[at[i] : at[i + 1]].tolist(), end[at[i] : at[i + 1]].tolist()
                sha = hashlib.sha256()
                for piece in _rest(texts, i, x, y):
                    sha.update(piece)
                digest.append(sha.hexdigest())
                spans.append([{"begin": b - int(o[i]), "end": e - int(o[i])} for b, e in zip(x, y)])
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(o)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest), pa.array(spans, kind)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"],
            )

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<begin:long,end:long>>")


def without_repeats(docs: DataFrame, *rules: Repeats, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with the strings that repeat by any of the rules cut out of their text, all other columns unchanged.

    A cut that would fall inside a character is moved to the characters inside
    the repeat, so texts stay valid UTF-8.  Null texts stay null.
    """
    names = docs.columns
    joined = _with_ranges(docs, rules or (Repeats(),), doc_id, text, names)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = lambda b: [b.column("kept_row"), b.column("kept_row").field(text), b.column("ranges")]
        rows = (pa.RecordBatch.from_arrays(columns(b), ["kept_row", "text", "ranges"]) for b in batches)
        for part in slices(rows, limit=ANCHOR_SLICE):
            texts = Texts(part.column("text"))
            row, begin, end = _spans(part, texts)
            # a character goes only if all its bytes do
            for _ in range(3):
                begin = begin + (((texts.buf[begin] & 0xC0) == 0x80) & (begin < end))
                inside = end < texts.offsets[row + 1]
                end = end - (inside & ((texts.buf[end] & 0xC0) == 0x80) & (begin < end))
            at = np.searchsorted(row, np.arange(texts.n + 1))
            row = part.column("kept_row")
            was = row.field(text)
            left = [b"".join(_rest(texts, i, begin[at[i] : at[i + 1]].tolist(), end[at[i] : at[i + 1]].tolist())).decode("utf-8", "replace") if was[i].is_valid else None for i in range(texts.n)]
            cut = pa.array(left, pa.string())
            yield pa.RecordBatch.from_arrays([cut if n == text else row.field(n) for n in names], names)

    return joined.select("kept_row", "ranges").mapInArrow(run, docs.schema)
