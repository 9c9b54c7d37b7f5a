"""Small tables of awkward rows, and brute-force versions of the operators."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, `check` string, ids string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    stock = ["the", "of", "and", "in", "house", "river", "stone", "é", "walks", "again", "über", "mill", "grain", "bread", "years"]
    return " ".join(r.choice(stock) + str(r.randrange(40)) for _ in range(words))


def documents() -> list[tuple]:
    """Nulls in every column, empty, blank, very long and repeated texts, ties, and columns with clashing names."""
    base, passage = prose(1, 300), prose(2, 120)
    texts = [
        None, "", "   \n\t", "one", "two words", "a b c d", base, base, base + " changed", base.replace("mill", "MILL"), prose(3, 60) + " " + passage + " " + prose(4, 60),
        prose(5, 40) + " " + passage, "x" * 3000, "ab" * 1500, prose(6, 30_000), "a<|endoftext|>b ▁ \x00 é😀", "line one here\nline one here\n\nline one here", "the same five words again " * 30, "é" * 500,
        prose(7, 3), "ΣΑΣ ñ İ     z",
    ]
    rows = [(i, t, ["en", "fr", None, "xx"][i % 4], None if i % 5 == 0 else f"s{i % 3}", None, "clash", "1", "c", "[]") for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, base, "en", None, None, None, None, None, None), (None, "no id here", None, None, 1, None, None, None, None), (3, "same id other text", "en", "s", 1, "k", "s", "c", "i")]
    return rows


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lowered(text: str | None) -> str:
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


def quality(text: str | None) -> tuple[int, int, int, int, int]:
    w = words(text)
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    marked: set[int] = set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            marked.update(range(i, i + 5))
    lines, dup = set(), 0
    for x in (text or "").split("\n"):
        if words(x):
            dup += x in lines
            lines.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked)


def removed(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out.append((len(b), sum(mark), sum(1 for k, _ in itertools.groupby(mark) if k), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text: str | None) -> frozenset:
    w = words(lowered(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(sets: list[frozenset], percent: int) -> list[int]:
    """The least index reachable of each set."""
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))]


# -- hashes in whole numbers, for features ---------------------------------------

M = (1 << 64) - 1


def mix(x: int) -> int:
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def hashed(b: bytes, seed: int = 0) -> int:
    h = (len(b) + seed) * 0x9E3779B97F4A7C15 & M
    for i in range(0, max(len(b), 1), 8):
        h = mix(((h ^ int.from_bytes(b[i : i + 8], "little")) * 0xBF58476D1CE4E5B9 + 0x9E3779B97F4A7C15) & M)
    return h


def features(text: str | None, bits: int, shortest: int = 3, longest: int = 5) -> collections.Counter:
    """Buckets of words, of pairs of words and of character n-grams of marked words, and the end feature."""
    bucket = lambda h: 1 + mix(h) % ((1 << bits) - 1)
    out, w = collections.Counter([0]), words(text)
    for i, x in enumerate(w):
        h = hashed(x.encode())
        out[bucket(h ^ 0x632BE59BD9B4E019)] += 1
        if i + 1 < len(w):
            out[bucket(mix((h * 0x9E3779B97F4A7C15 + hashed(w[i + 1].encode())) & M) ^ 0x8CB92BA72F3D8DD7)] += 1
        marked = f"<{x}>"
        for n in range(shortest, longest + 1):
            for j in range(len(marked) - n + 1):
                out[bucket(hashed(marked[j : j + n].encode(), n))] += 1
    return out


# -- overlaps --------------------------------------------------------------------


def tokens(text: str | None) -> list[str]:
    """Lower-cased words without marks at their edges, three at most, of which something is left."""
    out = []
    for w in words(lowered(text)):
        for _ in range(3):
            if len(w.encode()) > 1 and w[-1] in ".,;:!?'\"()[]{}-_*":
                w = w[:-1]
            if len(w.encode()) > 1 and w[0] in ".,;:!?'\"()[]{}-_*":
                w = w[1:]
        out.append(w)
    return out


def overlap(doc: list[str], item: list[str], masks: tuple[str, ...], least: float, share: tuple[int, int] = (4, 5)) -> tuple | None:
    """The overlap with most agreeing words on any diagonal with a seed: (first word, word of the item, words, agreeing ones)."""
    best = None
    for shift in range(1 - len(item), len(doc)):
        first, last = max(shift, 0), min(shift + len(item), len(doc))
        same = [doc[k] == item[k - shift] for k in range(first, last)]
        seeded = any(all(same[i + k] for k, c in enumerate(m) if c == "1") for m in masks for i in range(len(same) - len(m) + 1))
        if not seeded:
            continue
        found = None
        for i in range(len(same)):
            for j in range(i + 1, len(same) + 1):
                n = sum(same[i:j])
                if n >= least and share[1] * n >= share[0] * (j - i) and (found is None or (n, i - j, -j) > found[0]):
                    found = ((n, i - j, -j), (first + i, first + i - shift, j - i, n))
        if found and (best is None or found[1][3] > best[3]):
            best = found[1]
    return best


# -- deleted interpolation ---------------------------------------------------------


def interpolated(rows: list[tuple[int | None, str | None]], deleted_in: int, rounds: int, buckets: int, step: int) -> list[float]:
    """log10 probability of each text under the mixture, with weights learned on the deleted part by expectation-maximisation over binned estimates."""
    import math
    import zlib

    crc = [zlib.crc32(("" if i is None else str(i)).encode()) for i, _ in rows]
    part = ["held" if c % 7 == 2 else "deleted" if c // 7 % deleted_in == 0 else "counted" for c in crc]
    texts = [[*words(lowered(t)), None] for _, t in rows]

    def counts(parts: set[str]):
        one, two = collections.Counter(), collections.Counter()
        for p, t in zip(part, texts):
            if p in parts:
                one.update(t)
                two.update(zip([None, *t], t))
        return one, two

    bucket = lambda c: min(c.bit_length(), buckets - 1)
    bins = lambda p: max(math.floor(math.log(p) * step), -step * 60) if p > 0 else 1
    one, two = counts({"counted"})
    n = sum(one.values())
    cells: dict[tuple, list] = {}
    for p, t in zip(part, texts):
        if p == "deleted":
            for a, b in zip([None, *t], t):
                p2, p1 = two[a, b] / max(one[a], 1), one[b] / max(n, 1)
                cell = cells.setdefault((bucket(one[a]), bins(p2), bins(p1)), [0, 0.0, 0.0])
                cell[0] += 1
                cell[1] += p2
                cell[2] += p1
    flat = 1 / (len(one) + 1)
    weights = {b: (1 / 3, 1 / 3, 1 / 3) for b in range(buckets)}
    have = sorted({k[0] for k in cells})
    for _ in range(rounds):
        gathered = {b: [0.0, 0.0, 0.0] for b in have}
        for (b, _, _), (c, s2, s1) in cells.items():
            each = [w * p for w, p in zip(weights[b], (s2 / c, s1 / c, flat))]
            for k in range(3):
                gathered[b][k] += c * each[k] / max(sum(each), 1e-300)
        for b, g in gathered.items():
            if sum(g) > 0:
                weights[b] = tuple(x / sum(g) for x in g)
    for b in range(buckets):
        if have and b not in have:
            weights[b] = weights[min(have, key=lambda x: (abs(x - b), x))]
    weights[0] = (0.0, *weights[0][1:])
    for b, w in weights.items():
        w = (w[0], max(w[1], 1e-6), max(w[2], 1e-6))
        weights[b] = tuple(x / sum(w) for x in w)
    one, two = counts({"counted", "deleted"})
    n, v = sum(one.values()), len(one)
    out = []
    for t in texts:
        total = 0.0
        for a, b in zip([None, *t], t):
            w = weights[bucket(one[a])]
            total += math.log10(w[0] * two[a, b] / max(one[a], 1) + w[1] * one[b] / max(n, 1) + w[2] / (v + 1))
        out.append(total)
    return out


# -- the pipeline ------------------------------------------------------------------


def cut(texts: list[str | None], length: int, width: int) -> list[str | None]:
    """Texts without strings of ``length`` bytes, and without windows of ``width`` words, that occur twice or more; characters go whole."""
    raw = [(t or "").encode() for t in texts]
    spans = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in raw]
    window = lambda b, s, i: tuple(b[x:y] for x, y in s[i : i + width])
    strings = collections.Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    windows = collections.Counter(window(b, s, i) for b, s in zip(raw, spans) for i in range(len(s) - width + 1))
    out: list[str | None] = []
    for t, b, s in zip(texts, raw, spans):
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if strings[b[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        for i in range(len(s) - width + 1):
            if windows[window(b, s, i)] > 1:
                mark[s[i][0] : s[i + width - 1][1]] = b"\1" * (s[i + width - 1][1] - s[i][0])
        left, p = [], 0
        for c in t or "":
            n = len(c.encode())
            if not all(mark[p : p + n]):
                left.append(c)
            p += n
        out.append(None if t is None else "".join(left))
    return out


def leaks(doc: list[str], item: list[str], masks: tuple[str, ...], least: float) -> bool:
    """Whether a diagonal with a seed has a stretch of so many agreeing words, four fifths of it or more."""
    places = collections.defaultdict(list)
    for k, w in enumerate(item):
        places[w].append(k)
    diagonals = collections.Counter(i - k for i, w in enumerate(doc) for k in places.get(w, ()))
    for shift, n in diagonals.items():
        if n < least:
            continue
        first, last = max(shift, 0), min(shift + len(item), len(doc))
        same = [doc[k] == item[k - shift] for k in range(first, last)]
        seeded = any(all(same[i + k] for k, c in enumerate(m) if c == "1") for m in masks for i in range(len(same) - len(m) + 1))
        if seeded and any(sum(same[i:j]) >= least and 5 * sum(same[i:j]) >= 4 * (j - i) for i in range(len(same)) for j in range(i + 1, len(same) + 1)):
            return True
    return False
