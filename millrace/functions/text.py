"""Text functions from Column to Column; all run inside the JVM, but for those that say they work on Arrow arrays."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import (
    CATEGORY_LINES,
    COMPOUND_PREFIXES,
    DEVANAGARI,
    FILE_LINKS,
    HEADER_LINES,
    REDIRECT_LINES,
    SEGMENT,
    SPACE_MARK,
    VOWEL_SIGNS,
    WHITE,
    NearDedup,
    ScriptSpec,
)
from . import arrays


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for a row, however often and in whatever lambda it is used."""
    return F.transform(F.array(value), use)[0]


def replace_all(c: Column, *rules: tuple[str, str]) -> Column:
    """Rewrites one after another: (pattern, replacement)."""
    return reduce(lambda x, r: F.regexp_replace(x, F.lit(r[0]), F.lit(r[1])), rules, c)


def strip(c: Column) -> Column:
    """Without white space at both ends, white space as in Python's str."""
    printed = lambda x: (x >= "!") & (x <= "~")  # noqa: E731 - a character of ASCII that shows
    bare = lambda x: printed(F.substring(x, 1, 1)) & printed(F.right(x, F.lit(1)))
    return let(c, lambda x: F.when(bare(x), x).otherwise(replace_all(x, (f"^[{WHITE}]+|[{WHITE}]+$", ""))))


def words(c: Column) -> Column:
    """Words between white space, as in Python's str.split; an empty array for an empty text."""
    return F.filter(F.split(c, f"[{WHITE}]+"), lambda w: w != "")


def nfc(c: Column) -> Column:
    """Normalisation form C, by the library that Spark's collations use; null stays null, ASCII texts are in it already."""
    return let(c, lambda x: F.when(F.octet_length(x) == F.length(x), x).when(x.isNotNull(), _composed(x)))


def _composed(c: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(c, F.lit("")), F.lit(False))


def strip_boilerplate(c: Column) -> Column:
    """Without urls, e-mail tokens, entities and long punctuation runs; patterns run where a line can fit them."""
    where = lambda x, part, use: let(x, lambda y: F.when(F.contains(y, F.lit(part)), use(y)).otherwise(y))
    c = where(c, "://", lambda x: replace_all(x, (r"https?://[^" + WHITE + "]+", "")))
    kept = lambda x: F.array_join(F.transform(F.split(x, " "), lambda w: F.when(F.contains(w, F.lit("@")) & F.contains(w, F.lit(".")), "").otherwise(w)), " ")
    c = where(c, "@", kept)
    c = where(c, "&", lambda x: replace_all(x, (r"&[a-zA-Z]+;", " "), (r"&#\p{Nd}+;", " ")))
    return strip(replace_all(c, (r"[।,.!?;:]{3,}", "।"), (r"[ \t]{2,}|\t", " ")))


def clean_line(c: Column, script: ScriptSpec = DEVANAGARI) -> Column:
    """A line cut to its greatest length, normalised and without boilerplate."""
    return strip_boilerplate(nfc(F.substring(c, 1, script.max_line)))


def script_ratio(c: Column, script: ScriptSpec = DEVANAGARI) -> Column:
    """Share of letters in the script; 0 for a text without letters.  Marks and digits are no letters."""
    own = lambda x: F.length(F.regexp_replace(x, f"[^{script.ranges}]+", ""))
    return let(F.regexp_replace(c, r"[^\p{L}]+", ""), lambda x: F.when(x == "", 0.0).otherwise(own(x) / F.length(x)))


def line_status(cleaned: Column, script: ScriptSpec) -> Column:
    """What becomes of a cleaned line: blank, short, script (rejected for it) or keep; the first that fits."""
    return (
        F.when(cleaned == "", "blank")
        .when(F.length(cleaned) < script.min_line, "short")
        .when(script_ratio(cleaned, script) < script.min_ratio, "script")
        .otherwise("keep")
    )


def strip_wiki_markup(c: Column) -> Column:
    """Plain text of wiki markup: tags, templates, links, headings and list marks go, and so do category and redirect lines."""
    files = "|".join(FILE_LINKS)
    c = replace_all(
        c,
        (r"<[^>]+>", " "),
        (r"\{\{[^}]*\}\}", " "),
        (rf"(?iu)\[\[(?:{files}):[^\]]*\]\]", " "),
        (r"\[\[([^\]|]*\|)?([^\]]*)\]\]", "$2"),
        (r"\[https?://[^\]]*\]", " "),
        (r"\[[^\]]*\]", " "),
        (r"'{2,}", ""),
        (r"={2,}[^=]+={2,}", " "),
        (r"(?m)^[*#:;]+", ""),
        (r"\|", " "),
        (r"[ \t]+", " "),
    )
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: (x != "") & ~is_category_line(x))
    return F.array_join(lines, "\n")


def is_category_line(line: Column) -> Column:
    """Whether a line of plain text only names a category or redirects."""
    category = line.rlike(rf"(?iu)^(?:{'|'.join(CATEGORY_LINES)})[{WHITE}]*:")
    return reduce(lambda x, y: x | line.startswith(y), REDIRECT_LINES, category)


def is_header_line(line: Column) -> Column:
    return line.rlike(rf"(?iu)^(?:{'|'.join(HEADER_LINES)})") | (line == "")


def body_of_edition(c: Column) -> Column:
    """Text without its leading header lines and without blank or number-only lines."""
    lines = F.transform(F.split(c, "\n"), strip)
    # position of the first line that is no header, past the end if there is none
    first = F.array_position(F.transform(lines, is_header_line), False)
    body = F.when(first > 0, F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.size(lines))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.filter(body, lambda x: (x != "") & ~x.rlike(r"^[\p{Nd}.]+$")), "\n")


def aksharas(c: Column) -> Column:
    """Orthographic syllables and single other characters; a space is given as its mark."""
    return F.transform(F.regexp_extract_all(c, F.lit(SEGMENT), F.lit(0)), lambda s: F.when(s == " ", SPACE_MARK).otherwise(s))


def is_akshara(segment: Column) -> Column:
    """Whether a segment gets a code point of its own: several characters, or one of the Devanagari block."""
    return (F.length(segment) > 1) | segment.rlike(r"^[\x{0900}-\x{097F}]$")


def starts_with_vowel_sign(piece: Column) -> Column:
    """Whether a token piece, without its markers, begins with a dependent vowel sign."""
    return piece.rlike(f"^▁*Ġ*#*[{VOWEL_SIGNS}]")


def token_text(piece: Column) -> Column:
    """A token piece without the markers of the usual tokenizers at its start."""
    return replace_all(piece, ("^▁+", ""), ("^Ġ+", ""), ("^#+", ""))


def vowel_signs(c: Column) -> Column:
    return F.length(F.regexp_replace(c, f"[^{VOWEL_SIGNS}]", ""))


def split_compound(word: Column) -> Column:
    """A word split after its longest fitting compound prefix; short words stay."""
    longest_first = sorted(COMPOUND_PREFIXES, key=len, reverse=True)
    cut = F.regexp_replace(word, rf"^({'|'.join(longest_first)})([\x{{0904}}-\x{{10FFFF}}](?s:.){{2,}})$", "$1 $2")
    return F.when(F.length(word) < 4, word).otherwise(cut)


def split_compounds(c: Column) -> Column:
    return F.array_join(F.transform(words(c), split_compound), " ")


def undo_sandhi(c: Column) -> Column:
    """Vowel signs in which two vowels met, and o for a visarga, taken apart by rule, on Arrow arrays; no stage uses it by itself.  Null stays null."""
    return F.arrow_udf(lambda x: arrays.in_slices(arrays.undo_sandhi, x), "string")(c)


def translate(c: Column, of: str, to: str) -> Column:
    """Characters replaced one by one, those of ``of`` being ASCII, on Arrow arrays.  Null stays null."""
    table = np.arange(128, dtype=np.uint32)
    for a, b in zip(of, to, strict=True):
        table[ord(a)] = ord(b)
    return F.arrow_udf(lambda x: arrays.in_slices(lambda y: arrays.translated(y, table), x), "string")(c)


def graphemes(c: Column) -> Column:
    """Extended grapheme clusters by Java's rules, which part a conjunct after its virama; an empty array for an empty text."""
    return F.regexp_extract_all(c, F.lit(r"(\X)"), 1)


def head_and_tail(c: Column, limit: int) -> Column:
    """A text over ``limit`` characters as its first and last halves of that."""
    half = limit // 2
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, half), F.right(c, F.lit(half)))).otherwise(c)


def shingles(c: Column, n: int) -> Column:
    """Distinct character n-grams; a shorter text is one whole.

    One pass of a pattern that looks ahead from each character; the class keeps
    it from starting inside a surrogate pair.
    """
    each = F.regexp_extract_all(c, F.lit(rf"(?s)(?=([^\x{{DC00}}-\x{{DFFF}}].{{{n - 1}}}))"), F.lit(1))
    return F.when(F.length(c) < n, F.array(c)).otherwise(F.array_distinct(each))


def short_hash(c: Column) -> Column:
    """28 bits of an MD5 sum."""
    return F.conv(F.substring(F.md5(c), 1, 7), 16, 10).cast("long")


def minhash_signature(c: Column, spec: NearDedup = NearDedup()) -> Column:
    """Least value of each hash function over the shingles of a text."""
    hashed = F.transform(shingles(head_and_tail(c, spec.max_chars), spec.ngram), short_hash)
    functions = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in spec.coefficients()])
    return F.transform(functions, lambda f: F.array_min(F.transform(hashed, lambda h: (f["a"] * h + f["b"]) % spec.prime)))


def signature_matches(a: Column, b: Column) -> Column:
    """Places at which two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def utf8_prefix(c: Column, limit: int | Column) -> Column:
    """The longest prefix of whole characters within ``limit`` UTF-8 bytes."""
    cut = F.substring(F.encode(c, "UTF-8"), F.lit(1), F.lit(limit).cast("int"))
    tail = F.regexp_extract(F.hex(cut), r"(?:[0-7].|F[0-7](?:[89AB].){0,3}|E.(?:[89AB].){0,2}|[CD].(?:[89AB].)?)$", 0)
    need = F.when(tail.startswith("F"), 4).when(tail.startswith("E"), 3).when(tail.rlike("^[CD]"), 2).otherwise(1)
    have = (F.length(tail) / 2).cast("int")
    whole = F.when((have > 0) & (have < need), F.octet_length(cut) - have).otherwise(F.octet_length(cut))
    return F.decode(cut.substr(F.lit(1), whole), "UTF-8")
