"""Text work on whole Arrow batches: code points of all texts of a batch in one numpy array, strings cut from its buffers.

These give what the Column functions of :mod:`functions.text` give, which are
slow where each character or syllable is a string of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..config import SANDHI_CONSONANTS, VISARGA_VOICED, VOWEL_SANDHI


def points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after another, and where each text begins, with the end; a null text is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    chars = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])  # characters before each byte
    return chars, begins[offsets - offsets[0]]


#: Bytes of text that are laid out at once: arrays take some twenty times as many.
SLICE = 4 << 20


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes together; a longer text is one by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    i = 0
    while i < len(texts):
        done = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + most, "right")))
        yield i, j
        i = j


def in_slices(change: Callable[[pa.Array], pa.Array], texts: pa.Array) -> pa.Array:
    """Texts changed slice by slice."""
    return pa.concat_arrays([change(texts.slice(i, j - i)).cast(pa.string()) for i, j in slices(texts)] or [pa.array([], pa.string())])


def translated(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """Texts whose characters below the table's length are replaced by it."""
    chars, bounds = points(texts)
    return strings(np.where(chars < len(table), table[np.minimum(chars, len(table) - 1)], chars), bounds, texts.is_valid())


def widths(chars: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of code points."""
    return (1 + (chars > 0x7F).astype(np.int8) + (chars > 0x7FF) + (chars > 0xFFFF)).astype(np.int8)


def strings(chars: np.ndarray, bounds: np.ndarray, valid: pa.Array | None = None) -> pa.Array:
    """Strings of code points between bounds; null where ``valid`` is false."""
    data = chars.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    at = np.concatenate([[0], np.cumsum(widths(chars), dtype=np.int64)])[bounds]
    made = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data))
    return made if valid is None else pc.if_else(valid, made, pa.scalar(None, pa.large_string()))


_CONSONANT, _NUKTA, _VIRAMA, _SIGN, _NASAL, _VOWEL = 1, 2, 3, 4, 5, 6
_KINDS = np.zeros(0x80, np.uint8)
_KINDS[0x15:0x3A], _KINDS[0x3C], _KINDS[0x4D], _KINDS[0x3E:0x4D], _KINDS[0x01:0x04], _KINDS[0x04:0x15] = _CONSONANT, _NUKTA, _VIRAMA, _SIGN, _NASAL, _VOWEL


def syllable_starts(chars: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each character begins a segment as the pattern SEGMENT takes them: consonants joined by viramas, each with an optional nukta, then sign and nasal; vowel and nasal; any other character."""
    low = chars - np.uint32(0x900)  # wraps for those below
    kind = np.where(low < 0x80, _KINDS[np.minimum(low, 0x7F)], 0).astype(np.uint8)
    first = np.zeros(len(chars) + 1, bool)
    first[bounds] = True
    first = first[:-1]
    back = lambda x: np.concatenate([[False], x[:-1]]) & ~first  # noqa: E731 - of the character before in the text
    forth = lambda x: np.concatenate([(x & ~first)[1:], [False]])  # noqa: E731 - of the character after
    consonant = kind == _CONSONANT
    after = back(consonant)
    nukta = (kind == _NUKTA) & after
    base = after | back(nukta)  # a consonant, with or without nukta, came before
    virama = (kind == _VIRAMA) & base & forth(consonant)
    sign = (kind == _SIGN) & base
    nasal = (kind == _NASAL) & (base | back(sign) | back(kind == _VOWEL))
    return ~(nukta | virama | (consonant & back(virama)) | sign | nasal)


def segments(texts: pa.Array, mark: str) -> tuple[pa.Array, np.ndarray]:
    """Segments of all texts, a space as its mark, and how many segments lie before each text, with the end."""
    chars, bounds = points(texts)
    starts = syllable_starts(chars, bounds)
    cuts = np.append(np.flatnonzero(starts), len(chars))
    before = np.concatenate([[0], np.cumsum(starts)])[bounds]
    return strings(np.where(chars == 0x20, np.uint32(ord(mark)), chars), cuts), before


_SIGNS = {ord(s): ord(v) for s, v in VOWEL_SANDHI.items()}
_O, _A, _VISARGA = ord("ो"), ord("अ"), ord("ः")


def undo_sandhi(texts: pa.Array) -> pa.Array:
    """As :func:`functions.text.undo_sandhi`: its rules touch different signs, so one pass does."""
    chars, bounds = points(texts)
    first = np.zeros(len(chars) + 1, bool)
    first[bounds] = True
    first = first[:-1]
    after = np.concatenate([[False], np.isin(chars, [ord(c) for c in SANDHI_CONSONANTS])[:-1]]) & ~first
    met = np.isin(chars, list(_SIGNS)) & after
    voiced = np.concatenate([(np.isin(chars, [ord(c) for c in VISARGA_VOICED]) & ~first)[1:], [False]])
    lost = (chars == _O) & ~after & voiced
    size = np.where(met, 4, np.where(lost, 2, 1))
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    at = ends - size
    out[at] = chars
    k = at[met]
    letters = np.zeros(len(k), np.uint32)
    for sign, letter in _SIGNS.items():
        letters[chars[met] == sign] = letter
    out[k], out[k + 1], out[k + 2], out[k + 3] = _A, 0x20, chars[met], letters
    k = at[lost]
    out[k], out[k + 1] = _VISARGA, 0x20
    return strings(out, np.concatenate([[0], ends])[bounds], texts.is_valid())


def coded(values: pa.Array) -> tuple[np.ndarray, list]:
    """Numbers of values, and the distinct values, null among them."""
    d = values.dictionary_encode(null_encoding="encode")
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def _counts(pieces: pa.Array, before: np.ndarray, groups: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """How often each piece occurs in the texts of each group, as columns; ``before`` tells how many pieces lie before each text."""
    number = pieces.dictionary_encode()
    group = groups.dictionary_encode(null_encoding="encode")
    of = group.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    both = np.repeat(of, np.diff(before)) * len(number.dictionary) + number.indices.to_numpy(zero_copy_only=False)
    counts = np.bincount(both, minlength=len(group.dictionary) * len(number.dictionary))
    k = np.flatnonzero(counts)
    n = max(1, len(number.dictionary))
    return group.dictionary.take(pa.array(k // n)), number.dictionary.take(pa.array(k % n)), pa.array(counts[k], pa.int64())


def segment_counts(texts: pa.Array, groups: pa.Array, mark: str) -> tuple[pa.Array, pa.Array, pa.Array]:
    """How often each segment occurs in the texts of each group: columns (group, segment, n)."""
    return _counts(*segments(texts, mark), groups)


#: What Python's str.split takes for white space, as WHITE.
_WHITE = np.zeros(0x3001, bool)
for _a, _b in ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
    _WHITE[_a : _b + 1] = True


def word_counts(texts: pa.Array, groups: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """How often each word between white space occurs in the texts of each group: columns (group, word, n)."""
    chars, bounds = points(texts)
    solid = ~_WHITE[np.minimum(chars, 0x3000)] | (chars > 0x3000)
    first = np.zeros(len(chars) + 1, bool)
    first[bounds] = True
    starts = solid & (first[:-1] | ~np.concatenate([[False], solid[:-1]]))
    cuts = np.append(np.flatnonzero(starts[solid]), int(solid.sum()))
    return _counts(strings(chars[solid], cuts), np.concatenate([[0], np.cumsum(starts)])[bounds], groups)


def mapped(texts: pa.Array, groups: pa.Array, tables: Mapping[object, Mapping[str, str]], other: Mapping[str, str]) -> pa.Array:
    """Texts with each segment replaced that the table of the text's group has; ``other`` is the table of groups without one."""
    pieces, before = segments(texts, " ")
    number, distinct = coded(pieces)
    group, names = coded(groups)
    use = np.repeat(group, np.diff(before)) * len(distinct) + number
    each = [t.get(x, x) for t in (tables.get(g, other) for g in names) for x in distinct]
    joined = pa.array(each, pa.large_string()).take(pa.array(use))
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[: len(joined) + 1] if len(joined) else np.zeros(1, np.int64)
    data = joined.buffers()[2] if len(joined) and joined.buffers()[2] is not None else pa.py_buffer(b"")
    made = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets[before].tobytes()), data)
    return pc.if_else(texts.is_valid(), made, pa.scalar(None, pa.large_string()))


def sign_counts(texts: pa.Array, groups: pa.Array, signs: tuple[int, int]) -> Iterator[tuple[object, int, int, int, int, int]]:
    """Of the texts of each group: (group, texts, characters, segments, vowel signs, vowel signs that begin a segment)."""
    chars, bounds = points(texts)
    starts = syllable_starts(chars, bounds)
    sign = (chars >= signs[0]) & (chars <= signs[1])
    group, names = coded(groups)
    of = np.repeat(group, np.diff(bounds))
    each = [np.bincount(group, minlength=len(names)), *(np.bincount(of[m], minlength=len(names)) for m in (slice(None), starts, sign, sign & starts))]
    for k, name in enumerate(names):
        yield name, *(int(x[k]) for x in each)


def _shingles(chars: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct character n-grams of texts that have one, as rows of code points; each n-gram's number, and how many lie before each text."""
    count = np.maximum(np.diff(bounds) - n + 1, 0)
    before = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(before[-1]) + np.repeat(bounds[:-1] - before[:-1], count)
    _, codes = np.unique(chars, return_inverse=True)
    alphabet = int(codes.max()) + 1 if len(codes) else 1
    bits = max(1, (alphabet - 1).bit_length())
    key = np.zeros(len(at), np.int64)
    for k in range(n):
        if bits * (k + 1) > 62:  # too wide for one number: number what is there
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key << bits | codes[at + k]
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    return np.stack([chars[at[first] + k] for k in range(n)], 1) if len(at) else np.zeros((0, n), np.uint32), number, before


def least_values(texts: pa.Array, n: int, coefficients: Sequence[tuple[int, int]], prime: int) -> list[np.ndarray]:
    """The least value of each hash function over the character n-grams of each text, all of it where it is shorter: 28 bits of an MD5 sum, times a number and so on."""
    chars, bounds = points(texts)
    grams, number, before = _shingles(chars, bounds, n)
    short = lambda x: int(md5(x).hexdigest()[:7], 16)
    hashed = np.array([short(g.tobytes().decode("utf-32-le").encode()) for g in grams.astype("<u4")], np.int64)
    has = np.flatnonzero(np.diff(before) > 0)
    rest = np.flatnonzero(np.diff(before) == 0)
    whole = np.array([short((texts[int(i)].as_py() or "").encode()) for i in rest], np.int64)
    out = []
    for a, b in coefficients:
        value = np.zeros(len(texts), np.int64)
        if len(has):
            value[has] = np.minimum.reduceat(((a * hashed + b) % prime).astype(np.int32)[number], before[:-1][has])
        value[rest] = (a * whole + b) % prime
        out.append(value)
    return out
