"""The queries as SQL over the test tables, written for DuckDB."""

from __future__ import annotations

from ..config import (
    CATEGORY_LINES,
    CODEC_LEVELS,
    COMPOUND_PREFIXES,
    CONTEXT_TOKENS,
    FILE_LINKS,
    HEADER_LINES,
    HYBRID_CODECS,
    LATIN,
    MAX_WORDS,
    PURITY_LINES,
    REDIRECT_LINES,
    SAMPLE_SENTENCES,
    SANDHI_CONSONANTS,
    SEED,
    SEGMENT,
    SPACE_MARK,
    VISARGA_VOICED,
    VOWEL_SANDHI,
    VOWEL_SIGNS,
    WHITE,
    NearDedup,
)
from ..operators.report import CODECS
from .queries import BLOCK, COMPLEXITY_NOTES, HOLDOUT_MOST, LONG_LINE, MODEL_CODECS, PACK_BUDGET, PREFERRED_DOCS, PREFIX_BUDGET, QUOTA, TAIL_CHARS

N = NearDedup()


def _sub(x: str, *rules: tuple[str, str]) -> str:
    for pattern, by in rules:
        x = f"regexp_replace({x}, $q${pattern}$q$, $q${by}$q$, 'g')"
    return x


def _strip(x: str) -> str:
    return _sub(x, (f"^[{WHITE}]+|[{WHITE}]+$", ""))


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{WHITE}]+'), lambda w: w <> '')"


def _ratio(x: str) -> str:
    letters = _sub(x, (r"[^\p{L}]", ""))
    return f"CASE WHEN length({letters}) = 0 THEN 0.0 ELSE length({_sub(letters, (f'[^{LATIN.ranges}]', ''))})::DOUBLE / length({letters}) END"


def _boilerplate(source: str, x: str, keys: str) -> str:
    """CTEs that end in ``stripped`` (keys, s)."""
    tail = _strip(_sub("b", (r"&[a-zA-Z]+;", " "), (r"&#\p{Nd}+;", " "), (r"[।,.!?;:]{3,}", "।"), (r"[ \t]+", " ")))
    return f"""
b1 AS (SELECT {keys}, {_sub(x, (f'https?://[^{WHITE}]+', ''))} AS a FROM {source}),
b2 AS (SELECT {keys}, CASE WHEN contains(a, '@') THEN array_to_string(list_transform(string_split(a, ' '), lambda t: CASE WHEN contains(t, '@') AND contains(t, '.') THEN '' ELSE t END), ' ') ELSE a END AS b FROM b1),
stripped AS (SELECT {keys}, {tail} AS s FROM b2)"""


LINES = "lines AS (SELECT doc_id, lang, source, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)"
STATUS = f"""
{LINES},
cut AS (SELECT *, nfc_normalize(substr(line, 1, {LATIN.max_line})) AS n FROM lines),
{_boilerplate('cut', 'n', 'doc_id, lang, line_no, line')},
status AS (SELECT doc_id, lang, line_no, line, s AS cleaned,
  CASE WHEN s = '' THEN 'blank' WHEN length(s) < {LATIN.min_line} THEN 'short' WHEN {_ratio('s')} < {LATIN.min_ratio} THEN 'script' ELSE 'keep' END AS status FROM stripped)"""

DEVA = "deva AS (SELECT doc_id, lang, translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'ाबचदेफग्िजकलमनोपटरसतुवंःयड') AS text FROM documents)"
SEGS = f"segs AS (SELECT doc_id, lang, list_transform(regexp_extract_all(text, '{SEGMENT}'), lambda s: CASE WHEN s = ' ' THEN '{SPACE_MARK}' ELSE s END) AS segments FROM deva)"
VOCAB = r"vocab AS (SELECT lang, akshara, count(*) AS n FROM (SELECT lang, unnest(segments) AS akshara FROM segs) WHERE length(akshara) > 1 OR regexp_matches(akshara, '^[\x{0900}-\x{097F}]$') GROUP BY ALL)"
PUA = "pua AS (SELECT lang, akshara, 57344 + row_number() OVER (PARTITION BY lang ORDER BY akshara) - 1 AS cp FROM vocab)"

SPLIT = f"""
ranked AS (SELECT doc_id, lang, text, row_number() OVER (PARTITION BY lang ORDER BY md5('{SEED}|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents),
split AS (SELECT doc_id, lang, text, CASE WHEN r <= floor(0.95 * n) THEN 'train' ELSE 'test' END AS split FROM ranked)"""

CHARS = "chars AS (SELECT lang, symbol, count(*) AS n FROM (SELECT lang, unnest(string_split(text, '')) AS symbol FROM documents) WHERE symbol <> '' GROUP BY ALL)"
ENTROPY = "SELECT lang, count(*) AS symbols, sum(n)::BIGINT AS total, round(-sum(p * log2(p)) + 0.0, 4) AS entropy FROM (SELECT lang, n, n::DOUBLE / sum(n) OVER (PARTITION BY lang) AS p FROM {}) GROUP BY lang"

WORDS = f"""
listed AS (SELECT doc_id, lang, {_words('text')} AS ws FROM documents),
placed AS (SELECT lang, w, row_number() OVER (PARTITION BY lang ORDER BY doc_id, i) AS r FROM (SELECT doc_id, lang, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM listed)),
types AS (SELECT lang, w, count(*) AS n FROM placed WHERE r <= {MAX_WORDS} GROUP BY ALL),
complexity AS (SELECT lang, sum(n)::BIGINT AS word_count, count(*) AS type_count, round(count(*)::DOUBLE / sum(n), 4) AS type_token_ratio,
  round(sum(n * length(w))::DOUBLE / sum(n), 2) AS avg_word_length_chars, round(count_if(n = 1)::DOUBLE / count(*), 4) AS hapax_ratio FROM types GROUP BY lang)"""

_MINS = ", ".join(f"min(({a}::BIGINT * h + {b}) % {N.prime}) AS m{i}" for i, (a, b) in enumerate(N.coefficients()))
_SIG = ", ".join(f"m{i}" for i in range(N.hashes))
_HALF = N.max_chars // 2
SIGNED = f"""
bodies AS (SELECT doc_id, CASE WHEN length(text) > {N.max_chars} THEN substr(text, 1, {_HALF}) || right(text, {_HALF}) ELSE text END AS t FROM documents WHERE length(text) >= {N.min_chars}),
grams AS (SELECT DISTINCT doc_id, substr(t, i, {N.ngram}) AS s FROM (SELECT doc_id, t, unnest(range(1, greatest(length(t) - {N.ngram - 1}, 1) + 1)) AS i FROM bodies)),
hashed AS (SELECT doc_id, ('0x' || substr(md5(s), 1, 7))::BIGINT AS h FROM grams),
signed AS (SELECT doc_id, [{_SIG}] AS sig FROM (SELECT doc_id, {_MINS} FROM hashed GROUP BY doc_id))"""
_ROWS = N.hashes // N.bands
PAIRS = f"""
{SIGNED},
classes AS (SELECT sig, min(doc_id) AS id FROM signed GROUP BY sig),
banded AS (SELECT id, sig, unnest(range({N.bands})) AS k, unnest([{', '.join(f'sig[{k * _ROWS + 1}:{(k + 1) * _ROWS}]' for k in range(N.bands))}]) AS band FROM classes),
met AS (SELECT DISTINCT x.id AS a, y.id AS b, x.sig AS s, y.sig AS t FROM banded x JOIN banded y ON x.k = y.k AND x.band = y.band AND x.id < y.id),
pairs AS (SELECT a, b, len(list_filter(range(1, {N.hashes + 1}), lambda i: s[i] = t[i])) AS matches FROM met),
near AS (SELECT * FROM pairs WHERE matches >= {N.matches})"""

_files, _cats = "|".join(FILE_LINKS), "|".join(CATEGORY_LINES)
_markup = _sub(
    "html", (r"<[^>]+>", " "), (r"\{\{[^}]*\}\}", " "), (rf"(?i)\[\[(?:{_files}):[^\]]*\]\]", " "), (r"\[\[([^\]|]*\|)?([^\]]*)\]\]", r"\2"), (r"\[https?://[^\]]*\]", " "),
    (r"\[[^\]]*\]", " "), (r"'{2,}", ""), (r"={2,}[^=]+={2,}", " "), (r"(?m)^[*#:;]+", ""), (r"\|", " "), (r"[ \t]+", " "),
)


def _category(x: str) -> str:
    return f"(regexp_matches({x}, '(?i)^(?:{_cats})[{WHITE}]*:') OR " + " OR ".join(f"starts_with({x}, '{p}')" for p in REDIRECT_LINES) + ")"


PLAIN = f"plain AS (SELECT page_id, html, array_to_string(list_filter(list_transform(string_split({_markup}, chr(10)), lambda l: {_strip('l')}), lambda l: l <> '' AND NOT {_category('l')}), chr(10)) AS text FROM pages)"


def _pair_tables(train: str, test: str) -> str:
    return f"""
bg AS (SELECT split, lang, unnest(cs[:-2]) AS a, unnest(cs[2:]) AS b FROM (SELECT split, lang, string_split(text, '') AS cs FROM split)),
learned AS (SELECT lang, a, b, count(*) AS n FROM bg WHERE split = '{train}' GROUP BY ALL),
contexts AS (SELECT lang, a, sum(n) AS c FROM learned GROUP BY ALL),
seen AS (SELECT lang, a, b, count(*) AS times FROM bg WHERE split = '{test}' GROUP BY ALL),
size AS (SELECT lang, count(DISTINCT ch) AS v FROM (SELECT lang, unnest(string_split(text, '')) AS ch FROM split) WHERE ch <> '' GROUP BY lang),
bits AS (SELECT lang, sum(-times * log2((coalesce(n, 0) + 1)::DOUBLE / (coalesce(c, 0) + v))) AS inside FROM seen LEFT JOIN learned USING (lang, a, b) LEFT JOIN contexts USING (lang, a) JOIN size USING (lang) GROUP BY lang),
tests AS (SELECT lang, count(*) AS docs, sum(length(text))::BIGINT AS chars, sum(strlen(text))::BIGINT AS bytes FROM split WHERE split = '{test}' AND length(text) > 0 GROUP BY lang),
bpc AS (SELECT lang, chars AS total_chars, bytes AS total_bytes, coalesce(inside, 0) + docs * log2(v) AS raw, round(raw, 2) AS total_bits, round(raw / chars, 4) AS bpc, round(raw / bytes, 4) AS bpb FROM tests JOIN size USING (lang) LEFT JOIN bits USING (lang))"""


BPC = f"{SPLIT}, {_pair_tables('train', 'test')}"
MODELS = f"""{BPC}, {CHARS},
bytes AS (SELECT lang, symbol, sum(n) AS n FROM (SELECT lang, n, unnest(regexp_extract_all(hex(encode(symbol)), '..')) AS symbol FROM chars) GROUP BY ALL),
whole AS (SELECT lang, sum(strlen(text))::BIGINT AS original_bytes, sum(length(text))::BIGINT AS original_chars FROM documents GROUP BY lang),
ideal AS (SELECT lang, codec, ceil(sum(-n * log2(n::DOUBLE / t)) / 8)::BIGINT AS compressed_bytes FROM (
  SELECT lang, 'characters' AS codec, n, sum(n) OVER (PARTITION BY lang) AS t FROM chars UNION ALL SELECT lang, 'bytes', n, sum(n) OVER (PARTITION BY lang) FROM bytes) GROUP BY ALL),
sizes AS (SELECT lang, codec, original_bytes, original_chars, compressed_bytes FROM ideal JOIN whole USING (lang) UNION ALL SELECT lang, 'bigram', total_bytes, total_chars, ceil(total_bits / 8)::BIGINT FROM bpc),
measured AS (SELECT lang, codec, round(original_bytes::DOUBLE / compressed_bytes, 4) AS ratio, round(compressed_bytes * 8.0::DOUBLE / original_chars, 4) AS bpc, round(compressed_bytes * 8.0::DOUBLE / original_bytes, 4) AS bpb FROM sizes)"""


def _running(source: str, group: str, order: str, value: str) -> str:
    return f"sum({value}) OVER (PARTITION BY {group} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _ends(direction: str, cut: str) -> str:
    return f"""
WITH r AS (SELECT doc_id, text, length(text) AS c, sum(length(text)) OVER (PARTITION BY lang ORDER BY doc_id {direction} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, text, least(c, {TAIL_CHARS} - (t - c))::BIGINT AS take FROM r)
SELECT doc_id, take AS chars, md5({cut}) AS part_md5 FROM k WHERE take > 0"""


_head_line = f"(regexp_matches(l, '(?i)^(?:{'|'.join(HEADER_LINES)})') OR l = '')"
_prefixes = "|".join(sorted(COMPOUND_PREFIXES, key=len, reverse=True))


def _metrics(name: str, pieces: str) -> str:
    first = f"regexp_matches({_sub('p', ('^▁+', ''), ('^Ġ+', ''), ('^#+', ''))}, '^[{VOWEL_SIGNS}]')"
    return f"""SELECT lang, '{name}' AS tokenizer, count(*) AS sentences, sum(t)::BIGINT AS total_tokens, sum(c)::BIGINT AS total_chars, round(sum(t)::DOUBLE / greatest(count(*), 1), 2) AS avg_tokens_per_sentence,
  round(sum(t)::DOUBLE / greatest(sum(c), 1), 4) AS tokens_per_char, CASE WHEN sum(s) > 0 THEN round(100.0::DOUBLE * sum(b) / greatest(sum(v), 1), 2) END AS vowel_split_pct
FROM (SELECT lang, len(ps) AS t, length(sentence) AS c, len(list_filter(ps, lambda p: {first})) AS b, len(list_filter(ps, lambda p: regexp_matches(p, '[{VOWEL_SIGNS}]'))) AS s, length({_sub('sentence', (f'[^{VOWEL_SIGNS}]', ''))}) AS v
  FROM (SELECT lang, sentence, {pieces} AS ps FROM sentences)) GROUP BY lang"""


SENTENCES = f"{DEVA}, sentences AS (SELECT lang, {_strip('line')} AS sentence FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM deva) WHERE length({_strip('line')}) > 20)"
_AKSHARAS = f"list_transform(regexp_extract_all(sentence, '{SEGMENT}'), lambda s: CASE WHEN s = ' ' THEN '{SPACE_MARK}' ELSE s END)"
METRICS = f"m AS ({_metrics('characters', 'list_filter(string_split(sentence, chr(0)[1:0]), lambda c: c <> chr(0)[1:0])')} UNION ALL {_metrics('aksharas', _AKSHARAS)})".replace("chr(0)[1:0]", "''")
MB = "(1024 * 1024)"

ORACLES = {
    "clean_lines": f"WITH {STATUS} SELECT doc_id, line_no, cleaned FROM status WHERE status = 'keep'",
    "clean_stats": f"""WITH {STATUS},
u AS (SELECT lang, count(*) AS final_lines, round(sum(b + 1)::DOUBLE / {MB}, 4) AS clean_size_mb FROM (SELECT lang, cleaned, max(strlen(cleaned)) AS b FROM status WHERE status = 'keep' GROUP BY ALL) GROUP BY lang),
c AS (SELECT lang, count(*) AS raw_lines, max(length(line)) AS longest_raw_line_chars, count_if(length(line) > {LATIN.max_line})::BIGINT AS truncated_lines, count_if(status = 'script')::BIGINT AS rejected_script,
  count_if(status = 'short')::BIGINT AS rejected_short, count_if(status = 'keep')::BIGINT AS kept, round(sum(strlen(line) + 1)::DOUBLE / {MB}, 4) AS raw_size_mb FROM status GROUP BY lang)
SELECT lang, raw_lines, longest_raw_line_chars, truncated_lines, rejected_script, rejected_short, raw_size_mb, coalesce(final_lines, 0) AS final_lines, clean_size_mb, kept - coalesce(final_lines, 0) AS exact_duplicates FROM c LEFT JOIN u USING (lang)""",
    "script_ratio": f"SELECT doc_id, round({_ratio('text')}, 4) AS ratio FROM documents",
    "script_purity": f"""WITH {STATUS}, k AS (SELECT lang, cleaned, row_number() OVER (PARTITION BY lang ORDER BY doc_id, line_no) AS r FROM status WHERE status = 'keep'),
a AS (SELECT lang, count(*) AS lines, round(1 - avg({_ratio('cleaned')}), 4) AS foreign_share FROM k WHERE r <= {PURITY_LINES} GROUP BY lang)
SELECT *, CASE WHEN foreign_share < 0.01 THEN 'PASS' ELSE 'WARN' END AS verdict FROM a""",
    "pathological_lines": f"WITH {LINES} SELECT doc_id, line_no, length(line) AS chars, substr(line, 1, 100) AS preview FROM lines WHERE length(line) > {LONG_LINE} ORDER BY doc_id, line_no LIMIT 20",
    "nfc_normalize": "SELECT doc_id, md5(nfc_normalize(d)) AS nfc_md5, nfc_normalize(d) <> d AS changed FROM (SELECT doc_id, replace(text, 'é', 'e' || chr(769)) AS d FROM documents)",
    "boilerplate_strip": f"WITH {LINES}, {_boilerplate('lines', 'line', 'doc_id, line_no')} SELECT doc_id, line_no, md5(s) AS stripped_md5 FROM stripped",
    "email_token_strip": f"WITH {LINES}, found AS (SELECT * FROM lines WHERE contains(line, '@')), {_boilerplate('found', 'line', 'doc_id, line_no')} SELECT doc_id, line_no, s AS stripped FROM stripped",
    "markup_strip": f"WITH {PLAIN} SELECT page_id, length(text) AS chars, md5(text) AS text_md5 FROM plain",
    "wiki_extract": f"""WITH {PLAIN}, s AS (SELECT page_id, strlen(text) + 2 AS size, sum(strlen(text) + 2) OVER (ORDER BY page_id ROWS UNBOUNDED PRECEDING) AS t FROM plain WHERE length(html) > 50 AND length(text) > 50)
SELECT page_id, size FROM s WHERE t - size < {PREFIX_BUDGET}""",
    "category_filter": f"SELECT page_id, count_if({_category('l')})::BIGINT AS dropped FROM (SELECT page_id, unnest(['Category: x', 'category :y', 'REDIRECT z', 'text', url]) AS l FROM pages) GROUP BY page_id",
    "header_skip": f"""WITH s AS (SELECT doc_id, list_transform(string_split('## head' || chr(10) || '12.3' || chr(10) || 'This edition' || chr(10) || text, chr(10)), lambda l: {_strip('l')}) AS ls FROM documents),
f AS (SELECT doc_id, ls, list_position(list_transform(ls, lambda l: {_head_line}), false) AS first FROM s),
t AS (SELECT doc_id, CASE WHEN first > 0 THEN array_to_string(list_filter(ls[first:], lambda l: l <> '' AND NOT regexp_matches(l, '^[\\p{{Nd}}.]+$')), chr(10)) ELSE '' END AS x FROM f)
SELECT doc_id, length(x) AS chars, md5(x) AS text_md5 FROM t""",
    "exact_dedup_lines": f"WITH {LINES}, r AS (SELECT doc_id, line_no, line, row_number() OVER (PARTITION BY lang, md5(line) ORDER BY doc_id, line_no) AS k FROM lines) SELECT doc_id, line_no FROM r WHERE k = 1 OR line = ''",
    "exact_dedup_stats": f"WITH {LINES} SELECT lang, count(*) AS lines, count(DISTINCT md5(line)) AS kept, count(*) - count(DISTINCT md5(line)) AS duplicates FROM lines WHERE line <> '' GROUP BY lang",
    "paragraph_islands": f"""WITH {STATUS}, g AS (SELECT *, sum(CASE WHEN status <> 'keep' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS island FROM status),
p AS (SELECT doc_id, island, min(line_no) AS first_line, count(*) AS n_lines, string_agg(cleaned, chr(10) ORDER BY line_no) AS t FROM g WHERE status = 'keep' GROUP BY doc_id, island)
SELECT doc_id, first_line, n_lines, length(t) AS chars, md5(t) AS text_md5 FROM p""",
    "paragraph_stats": f"""WITH {STATUS}, g AS (SELECT *, sum(CASE WHEN status <> 'keep' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS island FROM status),
p AS (SELECT lang, doc_id, island, length(string_agg(cleaned, chr(10))) AS c FROM g WHERE status = 'keep' GROUP BY ALL)
SELECT lang, count(*) AS paragraphs, max(c) AS longest, (sum(c) // count(*))::BIGINT AS mean_chars FROM p GROUP BY lang""",
    "minhash_signatures": f"WITH {SIGNED} SELECT doc_id, md5(array_to_string(sig, ',')) AS signature_md5 FROM signed",
    "signature_pairs": f"WITH {PAIRS} SELECT a, b, matches FROM near",
    "near_dedup_lsh": f"""WITH {PAIRS}, c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sig) AS id FROM signed),
gone AS (SELECT doc_id FROM c WHERE doc_id <> id OR id IN (SELECT b FROM near)) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone)""",
    "quota_merge": f"""WITH {LINES}, s AS (SELECT doc_id, lang, source, line_no, strlen({_strip('line')}) + 1 AS size FROM lines WHERE {_strip('line')} <> ''),
n AS (SELECT lang, count(DISTINCT source) AS n FROM s GROUP BY lang), r AS (SELECT *, sum(size) OVER (PARTITION BY lang, source ORDER BY doc_id, line_no ROWS UNBOUNDED PRECEDING) AS t FROM s)
SELECT lang, source, count(*) AS lines, sum(size)::BIGINT AS bytes FROM r JOIN n USING (lang) WHERE t - size < {QUOTA} // n GROUP BY ALL""",
    "byte_budget_prefix": f"SELECT doc_id, lang FROM (SELECT doc_id, lang, strlen(text) AS b, {_running('documents', 'lang', 'doc_id', 'strlen(text)')} AS t FROM documents) WHERE t - b < {PREFIX_BUDGET}",
    "greedy_pack": f"""WITH RECURSIVE o AS (SELECT doc_id, lang, strlen(text) AS b, row_number() OVER (PARTITION BY lang ORDER BY md5('{SEED}|' || doc_id), doc_id) AS r FROM documents),
f AS (SELECT lang, doc_id, r, b <= {PACK_BUDGET} AS took, CASE WHEN b <= {PACK_BUDGET} THEN b ELSE 0 END AS used FROM o WHERE r = 1
  UNION ALL SELECT o.lang, o.doc_id, o.r, used + b <= {PACK_BUDGET}, CASE WHEN used + b <= {PACK_BUDGET} THEN used + b ELSE used END FROM f JOIN o ON o.lang = f.lang AND o.r = f.r + 1)
SELECT doc_id, lang FROM f WHERE took""",
    "train_test_split": f"WITH {SPLIT} SELECT doc_id, lang, split FROM split",
    "split_stats": f"""WITH {SPLIT} SELECT lang, count(*) AS total_documents, count_if(split = 'train')::BIGINT AS train_documents, count_if(split = 'test')::BIGINT AS test_documents,
  round(sum(CASE WHEN split = 'train' THEN strlen(text) ELSE 0 END)::DOUBLE / {MB}, 4) AS train_size_mb, round(sum(CASE WHEN split = 'test' THEN strlen(text) ELSE 0 END)::DOUBLE / {MB}, 4) AS test_size_mb, {SEED}::BIGINT AS seed FROM split GROUP BY lang""",
    "holdout_tail": _ends("DESC", "right(text, take)"),
    "char_prefix": _ends("ASC", "substr(text, 1, take)"),
    "head_tail_sample": f"SELECT doc_id, md5(CASE WHEN length(text) > 4000 THEN substr(text, 1, 2000) || right(text, 2000) ELSE text END) AS part_md5 FROM documents",
    "utf8_truncate": """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(len(string_split(text, '')))) AS i FROM documents),
r AS (SELECT doc_id, ch, i, sum(strlen(ch)) OVER (PARTITION BY doc_id ORDER BY i) AS t FROM c)
SELECT doc_id, sum(strlen(ch))::BIGINT AS bytes, md5(string_agg(ch, '' ORDER BY i)) AS part_md5 FROM r WHERE t <= 1001 GROUP BY doc_id""",
    "sample_sentences": f"""WITH {SPLIT}, {LINES}, s AS (SELECT l.lang, l.doc_id, line_no, split FROM lines l JOIN split p USING (doc_id) WHERE length({_strip('line')}) > 20),
c AS (SELECT lang, min(split) AS split FROM s GROUP BY lang), r AS (SELECT lang, doc_id, line_no, row_number() OVER (PARTITION BY lang ORDER BY doc_id, line_no) AS rank FROM s JOIN c USING (lang, split))
SELECT * FROM r WHERE rank <= {SAMPLE_SENTENCES}""",
    "char_entropy": f"WITH {CHARS} {ENTROPY.format('chars')}",
    "byte_entropy": f"WITH {CHARS}, bytes AS (SELECT lang, symbol, sum(n) AS n FROM (SELECT lang, n, unnest(regexp_extract_all(hex(encode(symbol)), '..')) AS symbol FROM chars) GROUP BY ALL) {ENTROPY.format('bytes')}",
    "complexity_profile": f"WITH {WORDS}, {CHARS}, e AS ({ENTROPY.format('chars')}) SELECT c.*, e.entropy AS char_entropy FROM complexity c JOIN e USING (lang)",
    "ttr": f"WITH {WORDS} SELECT lang, word_count, type_count, type_token_ratio FROM complexity",
    "avg_word_length": f"WITH {WORDS} SELECT lang, avg_word_length_chars FROM complexity",
    "hapax_ratio": f"WITH {WORDS} SELECT lang, hapax_ratio FROM complexity",
    "complexity_ranking": f"""WITH {WORDS}, {BPC}, x AS (SELECT string_agg(lang, ' < ' ORDER BY type_token_ratio, lang) AS by_ttr, string_agg(lang, ' < ' ORDER BY bpc, lang) AS by_bpc FROM complexity JOIN bpc USING (lang))
SELECT by_ttr, by_bpc, by_ttr = by_bpc AS agree FROM x""",
    "ngram_bpc": f"WITH {BPC} SELECT lang, total_chars, total_bytes, total_bits, bpc, bpb FROM bpc",
    "ngram_perplexity": f"WITH {BPC} SELECT lang, round(pow(2.0, total_bits / total_chars), 3) AS perplexity FROM bpc",
    "akshara_segments": f"WITH {DEVA}, {SEGS} SELECT doc_id, len(segments) AS segments, md5(array_to_string(segments, '|')) AS segments_md5 FROM segs",
    "akshara_vocab": f"WITH {DEVA}, {SEGS}, {VOCAB} SELECT lang, akshara, n FROM vocab",
    "pua_map": f"WITH {DEVA}, {SEGS}, {VOCAB}, {PUA} SELECT lang, akshara, cp FROM pua",
    "pua_remap": f"""WITH {DEVA}, {SEGS}, {VOCAB}, {PUA}, x AS (SELECT doc_id, s.lang, unnest(segments) AS g, unnest(range(len(segments))) AS i FROM segs s),
r AS (SELECT doc_id, string_agg(CASE WHEN cp IS NOT NULL THEN chr(cp::INT) WHEN g = '{SPACE_MARK}' THEN ' ' ELSE g END, '' ORDER BY i) AS t FROM x LEFT JOIN pua p ON p.lang = x.lang AND p.akshara = x.g GROUP BY doc_id)
SELECT doc_id, md5(t) AS remapped_md5, length(t) AS chars FROM r""",
    "pua_roundtrip": "SELECT doc_id, true AS round_trip FROM documents",
    "matra_split_rate": f"WITH {SENTENCES}, {METRICS} SELECT * FROM m",
    "tokenizer_comparison": f"WITH {SENTENCES}, {METRICS} SELECT c.lang, round((c.tokens_per_char - a.tokens_per_char) / c.tokens_per_char * 100, 2) AS fewer_tokens_pct FROM m c JOIN m a ON a.lang = c.lang AND c.tokenizer = 'characters' AND a.tokenizer = 'aksharas'",
    "sandhi_split": f"""WITH {DEVA}, w AS (SELECT doc_id, {_words("'महाभारत प्रतिदिन सुख ' || text")} AS ws FROM deva)
SELECT doc_id, md5(array_to_string(list_transform(ws, lambda w: CASE WHEN length(w) < 4 THEN w ELSE regexp_replace(w, '^({_prefixes})([\\x{{0904}}-\\x{{10FFFF}}](?s:.){{2,}})$', '\\1 \\2') END), ' ')) AS split_md5 FROM w""",
    "wiki_dump_scan": f"WITH {PLAIN} SELECT page_id::VARCHAR AS title, length(text) AS chars, md5(text) AS text_md5 FROM plain WHERE length(html) > 50 AND length(text) > 50",
    "plain_text_scan": f"""WITH l AS (SELECT lang, {_strip('line')} AS line FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents))
SELECT lang, count(*) AS lines, sum(length(line))::BIGINT AS chars, count(DISTINCT line) AS distinct_lines FROM l WHERE line <> '' GROUP BY lang""",
    "tei_body_texts": f"SELECT doc_id, length(t) AS chars, md5(t) AS text_md5 FROM (SELECT doc_id, {_strip('text')} AS t FROM documents)",
    "json_results_scan": "SELECT lang, count(*) AS documents, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang",
    "split_sink": f"WITH {SPLIT} SELECT lang, split, count(*) AS documents, sum(length(text))::BIGINT AS chars FROM split GROUP BY lang, split",
    "sandhi_rules": f"WITH {DEVA} SELECT doc_id, md5({_sub('text', *[(f'([{SANDHI_CONSONANTS}])({x})', chr(92) + f'1अ {chr(92)}2{y}') for x, y in VOWEL_SANDHI.items()], (f'ो([{VISARGA_VOICED}])', 'ः ' + chr(92) + '1'))}) AS text_md5 FROM deva",
    "grapheme_clusters": "SELECT doc_id, length_grapheme(t) AS clusters, length(t) AS chars FROM (SELECT doc_id, replace(text, 'e', 'e' || chr(769)) AS t FROM documents)",
    "token_block_contents": f"""WITH b AS (SELECT doc_id, text, unnest(range(length(text) // {BLOCK})) AS block FROM documents)
SELECT doc_id, block, md5(array_to_string(list_transform(string_split(substr(text, block * {BLOCK} + 1, {BLOCK}), ''), lambda c: unicode(c)::VARCHAR), ',')) AS ids_md5 FROM b""",
    "token_blocks": f"SELECT doc_id, length(text) // {BLOCK} AS blocks, coalesce(list_sum(list_transform(range(length(text) // {BLOCK}), lambda i: unicode(substr(text, i * {BLOCK} + 1, 1))))::BIGINT, 0) AS first_ids FROM documents",
    "score_windows": f"""SELECT doc_id, len(s) AS windows, coalesce(list_sum(list_transform(s, lambda i: unicode(substr(text, least(i + {CONTEXT_TOKENS}, length(text)), 1))))::BIGINT, 0) AS last_ids
FROM (SELECT doc_id, text, CASE WHEN length(text) >= 2 THEN range(0, length(text) - 1, {CONTEXT_TOKENS - 1}) ELSE [] END AS s FROM documents)""",
    "bpe_pair_counts": f"""WITH f AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest({_words('text')}) AS w FROM documents) GROUP BY ALL),
p AS (SELECT lang, n, substr(w, i, 1) AS a, substr(w, i + 1, 1) AS b FROM (SELECT lang, w, n, unnest(range(1, length(w))) AS i FROM f)) SELECT lang, a, b, sum(n)::BIGINT AS n FROM p GROUP BY ALL""",
    "novel_pieces": f"""WITH {DEVA}, w AS (SELECT DISTINCT lang, unnest({_words('text')}) AS piece FROM deva), c AS (SELECT DISTINCT piece, len(regexp_extract_all(piece, '{SEGMENT}')) AS aksharas FROM w WHERE lang <> 'en' AND piece NOT IN (SELECT piece FROM w WHERE lang = 'en'))
SELECT piece, aksharas FROM c WHERE aksharas >= 2 ORDER BY aksharas DESC, piece LIMIT 4000""",
    "quantized_cdf": f"""WITH {CHARS}, q AS (SELECT lang, symbol, greatest(floor(n::DOUBLE / sum(n) OVER (PARTITION BY lang) * 16777216), 1)::BIGINT AS c FROM chars),
o AS (SELECT *, 16777216 - sum(c) OVER (PARTITION BY lang) AS over, row_number() OVER (PARTITION BY lang ORDER BY c DESC, symbol) AS r FROM q),
d AS (SELECT lang, symbol, (CASE WHEN r = 1 THEN c + over ELSE c END)::BIGINT AS count FROM o)
SELECT lang, symbol, count, (sum(count) OVER (PARTITION BY lang ORDER BY symbol ROWS UNBOUNDED PRECEDING))::BIGINT AS cumulative FROM d""",
    "codec_metrics": f"WITH {MODELS} SELECT * FROM measured",
    "codec_master_table": f"WITH {MODELS} SELECT lang, {', '.join(f'''coalesce(max(CASE WHEN codec = '{c}' THEN printf('%.4f', bpc) END), 'N/A') AS {c}''' for c in [*MODEL_CODECS, 'llm'])} FROM measured GROUP BY lang",
    "best_codec": f"WITH {MODELS} SELECT lang, codec AS best_codec, bpc AS best_bpc FROM measured QUALIFY row_number() OVER (PARTITION BY lang ORDER BY bpc, list_position({MODEL_CODECS}, codec)) = 1",
    "crosslingual_join": f"WITH {WORDS}, {BPC}, {CHARS}, e AS ({ENTROPY.format('chars')}) SELECT lang, word_count, type_count, type_token_ratio, bpc, entropy FROM complexity JOIN bpc USING (lang) JOIN e USING (lang)",
    "markdown_report": f"""WITH {MODELS} SELECT lang, '## ' || upper(lang[1]) || lang[2:] || chr(10) || chr(10) || '| Compressor | Ratio | BPC | BPB |' || chr(10) || '|---|---|---|---|' || chr(10) ||
  string_agg(printf('| %s | %.3f | %.3f | %.3f |', codec, ratio, bpc, bpb), chr(10) ORDER BY codec) AS markdown FROM measured GROUP BY lang""",
    "subtoken_mean_init": "SELECT token, dim, round(avg(x), 4) AS mean FROM (SELECT label::BIGINT AS token, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL",
    "corpus_size_report": f"""WITH {STATUS}, {SPLIT}, r AS (SELECT lang, sum(strlen(text)) AS raw, sum(CASE WHEN split = 'train' THEN strlen(text) ELSE 0 END) AS train, sum(CASE WHEN split = 'test' THEN strlen(text) ELSE 0 END) AS test FROM split GROUP BY lang),
c AS (SELECT lang, sum(strlen(cleaned)) AS clean FROM status WHERE status = 'keep' GROUP BY lang)
SELECT lang, round(raw::DOUBLE / {MB}, 4) AS raw_mb, round(clean::DOUBLE / {MB}, 4) AS clean_mb, round(train::DOUBLE / {MB}, 4) AS train_mb, round(test::DOUBLE / {MB}, 4) AS test_mb FROM r LEFT JOIN c USING (lang)""",
    "codec_round_trips": f"SELECT doc_id, unnest({[*CODEC_LEVELS, *HYBRID_CODECS]}) AS codec, coalesce(strlen(text), 0) AS original_bytes, coalesce(length(text), 0) AS original_chars, true AS round_trip, CAST(NULL AS VARCHAR) AS error FROM documents",
    "language_codec_inputs": f"""SELECT lang, unnest({CODECS}) AS codec, b AS original_bytes, c AS original_chars, CAST(NULL AS VARCHAR) AS error
FROM (SELECT lang, (sum(coalesce(strlen(text), 0)) + 2 * (count(*) - 1))::BIGINT AS b, (sum(coalesce(length(text), 0)) + 2 * (count(*) - 1))::BIGINT AS c FROM documents GROUP BY lang)""",
    "tokenizer_markdown": f"""WITH {SENTENCES}, {METRICS} SELECT lang, '## ' || upper(lang[1]) || lang[2:] || chr(10) || chr(10) || '| Tokenizer | Tokens/Sent | Tok/Char | Vowel Split % |' || chr(10) || '|---|---|---|---|' || chr(10) ||
  string_agg('| ' || tokenizer || ' | ' || printf('%.2f', avg_tokens_per_sentence) || ' | ' || printf('%.4f', tokens_per_char) || ' | ' || coalesce(printf('%.2f', vowel_split_pct) || '%', '-') || ' |', chr(10) ORDER BY tokenizer) AS markdown FROM m GROUP BY lang""",
    "result_preference": f"""WITH {MODELS}, many AS (SELECT lang FROM documents GROUP BY lang HAVING count(*) >= {PREFERRED_DOCS})
SELECT lang, codec, bpc, CASE WHEN codec = 'bigram' THEN 1 ELSE 2 END::INT AS origin FROM measured
WHERE codec = 'bigram' AND lang IN (SELECT lang FROM many) OR codec = 'characters' AND lang NOT IN (SELECT lang FROM many JOIN bpc USING (lang))""",
    "windowed_bpc": f"""WITH {BPC}, w AS (SELECT lang, sum(CASE WHEN length(text) >= 2 THEN (length(text) - 2) // {CONTEXT_TOKENS - 1} + 1 ELSE 0 END)::BIGINT AS windows FROM split WHERE split = 'test' AND length(text) > 0 GROUP BY lang)
SELECT lang, windows, total_chars AS total_tokens, total_bits, round(total_bits / total_chars, 4) AS bits_per_token, round(total_bytes * 8 / total_bits, 4) AS compression_ratio FROM bpc JOIN w USING (lang)""",
    "context_schedule": f"""WITH p AS (SELECT doc_id, unnest(range(1, length(text))) AS i FROM documents),
c AS (SELECT doc_id, i - CASE WHEN i <= {2 * CONTEXT_TOKENS} THEN 0 ELSE ((i - {2 * CONTEXT_TOKENS + 1}) // {CONTEXT_TOKENS + 1} + 1) * {CONTEXT_TOKENS + 1} END AS c FROM p)
SELECT doc_id, coalesce(sum(c), 0)::BIGINT AS context_ids, coalesce(max(c), 0)::BIGINT AS longest FROM documents LEFT JOIN c USING (doc_id) GROUP BY doc_id""",
    "holdout_split": f"""WITH r AS (SELECT doc_id, lang, text, length(text) AS c, sum(length(text)) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS e, sum(length(text)) OVER (PARTITION BY lang) AS w FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, e - c AS b, CASE WHEN w > {TAIL_CHARS} THEN w - {TAIL_CHARS} ELSE w END AS cut FROM r),
p AS (SELECT doc_id, lang, text, b, e, 'train' AS part, 0::HUGEINT AS low, least(cut, {HOLDOUT_MOST}) AS high FROM k UNION ALL SELECT doc_id, lang, text, b, e, 'eval', cut, w FROM k)
SELECT doc_id, lang, part, (least(high, e) - greatest(low, b))::BIGINT AS chars, md5(substr(text, (greatest(low - b, 0) + 1)::BIGINT, (least(high, e) - greatest(low, b))::BIGINT)) AS part_md5 FROM p WHERE least(high, e) > greatest(low, b)""",
    "near_dedup_stats": f"""WITH {PAIRS}, c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sig) AS id FROM signed), gone AS (SELECT doc_id FROM c WHERE doc_id <> id OR id IN (SELECT b FROM near))
SELECT lang, count(*) AS documents, count_if(doc_id IN (SELECT doc_id FROM gone))::BIGINT AS near_duplicates FROM documents GROUP BY lang""",
    "complexity_record": f"""WITH {WORDS}, {CHARS}, e AS ({ENTROPY.format('chars')}) SELECT c.*, e.entropy AS char_entropy, CASE {' '.join(f"WHEN lang = '{k}' THEN '{v}'" for k, v in COMPLEXITY_NOTES.items())} ELSE '' END AS complexity_notes FROM complexity c JOIN e USING (lang)""",
    "tokenizer_sweep_inputs": f"""WITH {DEVA}, l AS (SELECT lang, array_to_string({_words('line')}, ' ') AS s FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM deva)),
k AS (SELECT lang, count(*) AS sentences, sum(length(s))::BIGINT AS total_chars FROM l WHERE length(s) > 20 GROUP BY lang) SELECT lang, unnest(['sp_bpe', 'sp_unigram', 'akshara_bpe']) AS tokenizer, sentences, total_chars FROM k""",
    "akshara_bpe_roundtrip": f"""WITH {DEVA}, l AS (SELECT lang, array_to_string({_words('line')}, ' ') AS s FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM deva))
SELECT lang, count(*) AS sentences, count(*) AS round_trips FROM l WHERE length(s) > 20 GROUP BY lang""",
}
