"""Scripts, thresholds and codec settings of the curation and measurement operators."""

from __future__ import annotations

from dataclasses import dataclass

#: What Python's str.strip and str.split take for white space.
WHITE = r"\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

#: An orthographic syllable of Devanagari: consonants joined by
#: viramas, each with an optional nukta, then vowel sign and nasal or visarga.
CONSONANT = r"[\x{0915}-\x{0939}]\x{093C}?"
AKSHARA = rf"{CONSONANT}(?:\x{{094D}}{CONSONANT})*[\x{{093E}}-\x{{094C}}]?[\x{{0901}}-\x{{0903}}]?"
INDEPENDENT_VOWEL = r"[\x{0904}-\x{0914}][\x{0901}-\x{0903}]?"
SEGMENT = rf"{AKSHARA}|{INDEPENDENT_VOWEL}|(?s:.)"
#: Dependent vowel signs.
VOWEL_SIGNS = r"\x{093E}-\x{094C}"
SPACE_MARK = "▁"

#: Prefixes at which compounds are split.
COMPOUND_PREFIXES = ["महा", "सु", "दुर", "दुः", "प्र", "उप", "अनु", "परि", "अभि", "सम", "वि", "अव", "निर", "निस", "आ", "उत", "प्रति", "अधि"]

#: Beginnings of header lines of plain text editions.
HEADER_LINES = ["##", r"<\?", "<!", "encoding", "GRETIL", "http", "Input", "This", "Based", "Göttingen"]
#: Prefixes of file links and of category lines in wiki markup.
FILE_LINKS = ["File", "Image", "चित्र", "फ़ाइल", "संचिका"]
CATEGORY_LINES = ["श्रेणी", "Category", "वर्ग", "विभाग"]
REDIRECT_LINES = ["REDIRECT", "#REDIRECT", "#पुनर्प्रेषित", "पुनर्प्रेषित"]

#: Private use ranges from which syllables get code points.
PRIVATE_USE = [(0xE000, 0xF8FF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD)]


@dataclass(frozen=True)
class ScriptSpec:
    """A script: its characters as a regular expression class, and the least share of letters in it."""

    name: str
    ranges: str
    min_ratio: float = 0.70
    min_line: int = 20
    max_line: int = 20_000


DEVANAGARI = ScriptSpec("devanagari", r"\x{0900}-\x{097F}\x{A8E0}-\x{A8FF}\x{1CD0}-\x{1CFF}")
LATIN = ScriptSpec("latin", r"A-Za-z\x{00C0}-\x{00FF}")


@dataclass(frozen=True)
class NearDedup:
    """Shingles, signatures and window of paragraph near-dedup."""

    ngram: int = 5
    threshold: float = 0.8
    hashes: int = 32
    bands: int = 8
    window: int = 200
    min_chars: int = 30
    max_chars: int = 4000
    prime: int = 2_147_483_647
    seed: int = 12345

    @property
    def matches(self) -> int:
        """Least number of equal signature places of near duplicates."""
        return next(m for m in range(self.hashes + 1) if m / self.hashes >= self.threshold)

    def coefficients(self) -> list[tuple[int, int]]:
        """Multiplier (30 bits) and offset of each hash function, by a linear congruential rule."""
        out, x = [], self.seed
        for _ in range(self.hashes):
            x = (x * 1103515245 + 12345) % (1 << 31)
            a = 1 + x % ((1 << 30) - 1)
            x = (x * 1103515245 + 12345) % (1 << 31)
            out.append((a, x % self.prime))
        return out


#: Vowel signs after a consonant and the second of the two vowels that met, and voiced letters before which a visarga became o.
SANDHI_CONSONANTS = "कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसह"
VOWEL_SANDHI = {"े": "इ", "ो": "उ", "ै": "ए", "ौ": "ओ"}
VISARGA_VOICED = "गघदधबभ"
TRAIN_RATIO = 0.95
SEED = 42
SAMPLE_SENTENCES = 5000
MAX_WORDS = 100_000
#: Characters held out at a corpus's end, and the most that train.
HOLDOUT_CHARS, HOLDOUT_TRAIN_CHARS = 200_000, 20_000_000
PURITY_LINES = 10_000
#: Characters of the test part that a model is measured on.
MODEL_CHARS = 50_000
CONTEXT_TOKENS = 512
#: Levels of the classical codecs (None: the codec's default).
CODEC_LEVELS = {"gzip": 9, "bzip2": 9, "lzma": None, "zstd": 19}
HYBRID_CODECS = {"gzip_bzip2": ("gzip", "bzip2"), "gzip_lzma": ("gzip", "lzma")}
