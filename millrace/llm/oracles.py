"""Queries of this subpackage that SQL can express, written for DuckDB."""

from __future__ import annotations

from .quality_rules import CLASSES, COMMON_WORDS, Limits

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def quality_rules_sql(limits: Limits = Limits()) -> str:
    """Base counts, distances to the references of all documents, verdict."""
    vocabulary = ", ".join(f"('{w}')" for w in sorted({w for words in COMMON_WORDS.values() for w in words.split()}))
    marks = "('.', ',', ';', ':', '!', '?', '''', '\"', '(', ')', '-')"
    cut = "CASE WHEN length(w) > 1 AND {0}(w, 1) IN " + marks + " THEN {1} ELSE w END AS w"
    trims = ""
    source = "raw_words"
    for k in range(2):
        trims += f"r{k} AS (SELECT doc_id, lang, {cut.format('right', 'left(w, length(w) - 1)')} FROM {source}),\n"
        trims += f"l{k} AS (SELECT doc_id, lang, {cut.format('left', 'substr(w, 2)')} FROM r{k}),\n"
        source = f"l{k}"
    kind = r"""CASE WHEN c IN ('a', 'e', 'i', 'o', 'u') THEN 'vowel' WHEN regexp_matches(c, '^[a-z]$') THEN 'consonant' WHEN regexp_matches(c, '^[A-Z]$') THEN 'upper'
  WHEN regexp_matches(c, '^[0-9]$') THEN 'digit' WHEN regexp_matches(c, '^[\x20\x09-\x0D]$') THEN 'space' WHEN c IN MARKS THEN 'stop' WHEN regexp_matches(c, '^[#*$%&|<>]$') THEN 'symbol'
  WHEN unicode(c) < 128 THEN 'other_ascii' ELSE 'beyond_ascii' END""".replace("MARKS", marks)

    def distance(name: str, counts: str, bins: str, least: int) -> str:
        """CTEs that end in ``name`` (doc_id, lang, distance)."""
        term = "CASE WHEN {0} > 0 THEN {0} * log2({0} / ((p + q) / 2)) ELSE 0 END"
        return f"""
{name}_total AS (SELECT doc_id, lang, sum(n)::DOUBLE AS total FROM {counts} GROUP BY ALL),
{name}_ref AS (SELECT lang AS ref, bin, sum(n)::DOUBLE / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM {counts} WHERE coalesce(lang, '') <> '' GROUP BY lang, bin),
{name}_pair AS (SELECT doc_id, lang, total, ref FROM {name}_total t JOIN (SELECT DISTINCT ref FROM {name}_ref) r ON r.ref = t.lang OR t.lang IS NULL OR t.lang NOT IN (SELECT ref FROM {name}_ref) WHERE total >= {least}),
{name}_cell AS (SELECT d.doc_id, d.ref, b.bin, coalesce(c.n / d.total, 0) AS p, coalesce(r.q, 0) AS q FROM {name}_pair d CROSS JOIN ({bins}) b
  LEFT JOIN {counts} c ON c.doc_id = d.doc_id AND c.bin = b.bin LEFT JOIN {name}_ref r ON r.ref = d.ref AND r.bin = b.bin),
{name} AS (SELECT doc_id, min(js) AS distance FROM (SELECT doc_id, ref, sqrt(greatest(least(sum({term.format('p')} + {term.format('q')}) / 2, 1), 0)) AS js FROM {name}_cell GROUP BY doc_id, ref) GROUP BY doc_id)"""

    return f"""
WITH docs AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
listed AS (SELECT doc_id, lang, text, {_WORDS.format('text')} AS ws FROM docs),
raw_words AS (SELECT doc_id, lang, unnest(ws) AS w FROM listed),
{trims}
common AS (SELECT unnest([{', '.join(v[1:-1] for v in vocabulary.split(', '))}]) AS v),
word_counts AS (SELECT doc_id, lang, coalesce(v, '~') AS bin, count(*) AS n FROM {source} LEFT JOIN common ON v = {_LOW.format('w')} GROUP BY ALL),
class_counts AS (SELECT doc_id, lang, {kind} AS bin, count(*) AS n FROM (SELECT doc_id, lang, unnest(string_split(text, '')) AS c FROM docs WHERE text <> '') GROUP BY ALL),
{distance('class_distance', 'class_counts', f"SELECT unnest({CLASSES}) AS bin", limits.min_class_chars)},
{distance('word_distance', 'word_counts', "SELECT v AS bin FROM common UNION ALL SELECT '~'", limits.min_common_words)},
ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM docs),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM ls WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
placed AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n, ws FROM listed),
wins AS (SELECT doc_id, i, CASE WHEN i + 4 <= n THEN array_to_string(ws[i:i + 4], ' ') END AS k FROM placed),
often AS (SELECT doc_id, i, k IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, k) > 1 AS o FROM wins),
rep AS (SELECT doc_id, count_if(c)::BIGINT AS n_repeat_words FROM (SELECT doc_id, bool_or(o) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM often) GROUP BY doc_id),
base AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM listed LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
judged AS (SELECT b.*, n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.max_repeat_percent} * n_words AS base_failed, c.distance AS cd, w.distance AS wd
  FROM base b LEFT JOIN class_distance c USING (doc_id) LEFT JOIN word_distance w USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(cd > {limits.max_class_distance}, false) AND NOT coalesce(wd > {limits.max_word_distance} + {limits.word_noise} / sqrt(greatest(n_words, 1)), false) AS kept,
  round(cd, 4) AS class_distance, round(wd, 4) AS word_distance FROM judged"""


def near_duplicates_sql(percent: int = 85) -> str:
    """All pairs by shared shingles, then what each document reaches."""
    return f"""
WITH RECURSIVE listed AS (SELECT doc_id, {_WORDS.format(_LOW.format("coalesce(text, '')"))} AS ws FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM listed),
coded AS (SELECT doc_id, dense_rank() OVER (ORDER BY g) AS g FROM grams),
sizes AS (SELECT doc_id, count(*) AS n FROM coded GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM coded x JOIN coded y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * k >= {percent} * (s.n + t.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, c = d.doc_id AS kept FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id"""


def byte_shards_sql(shards: int = 40, overhead: int = 16) -> str:
    """Running bytes in the order of ids, cut at equal targets; the checksum is folded over the bytes of the text."""
    bit = "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""
WITH crc AS (SELECT list(list_reduce(list_concat([i::BIGINT], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), {bit}) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
raw AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
bytes AS (SELECT doc_id, strlen(text) + {overhead} AS size, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM raw),
summed AS (SELECT doc_id, size, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM bytes, crc),
placed AS (SELECT *, sum(size) OVER o - size AS before, sum(size) OVER () AS total, row_number() OVER o AS r FROM summed WINDOW o AS (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT *, least((2 * before + size) * {shards} // (2 * total), {shards} - 1)::INT AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (r - min(r) OVER (PARTITION BY shard))::BIGINT AS slot, CAST(NULL AS INT) AS grown_shard FROM cut"""
