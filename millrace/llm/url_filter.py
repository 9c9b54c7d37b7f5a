"""URL filters: a weighted vocabulary searched by Aho-Corasick.

One pass of the automaton over a lower-cased url gives all occurrences of all
terms; an occurrence counts if no letter or digit adjoins it.  One strict term
rejects, and so do distinct soft terms whose weights together reach the limit,
which no single one does.  Host and path rules come first; the longest fitting
rule decides.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbatch import small_batches

#: Terms of which a single one rejects a url.
STRICT_TERMS = ("adult", "adult-x", "bet365", "camgirls", "casino", "escort", "gambling", "hardcore", "hentai", "milf", "nsfw", "nude", "poker", "porn", "porno", "pornhub", "sex", "sexcam", "slots", "torrent", "viagra", "warez", "webcamsex", "xvideos", "xxx")
#: Terms of which several distinct ones together reject a url, and their weights.
SOFT_TERMS = {
    "adserver": 2, "bet": 2, "bets": 2, "cam": 2, "crack": 2, "dating": 2, "escorts": 2, "girls": 2, "keygen": 2, "pills": 2, "popup": 2, "sexy": 2, "spam": 2, "tracker": 2,
    "ad": 1.5, "ads": 1.5, "affiliate": 1.5, "banner": 1.5, "bonus": 1.5, "coupon": 1.5, "farm": 1.5, "loan": 1.5, "loans": 1.5, "pixel": 1.5, "promo": 1.5, "redirect": 1.5, "sponsor": 1.5, "track": 1.5, "tracking": 1.5, "win": 1.5,
    "buy": 1, "cheap": 1, "click": 1, "deal": 1, "deals": 1, "download": 1, "free": 1, "hot": 1, "live": 1, "sale": 1,
}
#: Two terms of middle weight reach it, two light ones do not.
SOFT_LIMIT = 2.5

Rule = tuple[str, str, str]

_UPPER = {c: c + 32 for c in range(65, 91)}
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://`` and for null."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), *_LETTERS), part(2)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null without one; a rule fits its host and that host's subdomains."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for told, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, told).otherwise(verdict)
    return name, verdict


@lru_cache(maxsize=8)
def automaton(strict: tuple[str, ...], soft: tuple[tuple[str, float], ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for term, weight in soft:
        a.add_word(term, (term, weight))
    for term in strict:
        a.add_word(term, (term, 0))  # 0: strict
    a.make_automaton()
    return a


def vocabulary_hits(url: str | None, auto) -> tuple[int, dict[str, float]]:
    """Number of strict occurrences, and the weight of each distinct soft term."""
    text = (url or "").translate(_UPPER)
    strict, soft = 0, {}
    for end, (term, weight) in auto.iter(text):
        start = end - len(term)
        if (start >= 0 and text[start] in _ALNUM) or (end + 1 < len(text) and text[end + 1] in _ALNUM):
            continue
        if weight:
            soft[term] = weight
        else:
            strict += 1
    return strict, soft


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule] = (),
    strict: Sequence[str] = STRICT_TERMS,
    soft: Mapping[str, float] = SOFT_TERMS,
    soft_limit: float = SOFT_LIMIT,
    page_id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """Verdict of each url: its rule's, else the vocabulary's.

    Rules are (verdict, host, path) with a path that starts with ``/``.  A null
    or empty url has no host, no path, no hit, and is allowed.  Every input row
    gives one row.  Hosts, paths and rules are found in generated code; a url that
    repeats in a batch goes through the automaton once.
    """
    small_batches(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url")).withColumns({"host": host, "path": path})
    name, told = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "told": told})
    terms = (tuple(strict), tuple(soft.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(*terms)
        for b in batches:
            urls = b.column("url").dictionary_encode()
            hits = [vocabulary_hits(u, auto) for u in urls.dictionary.to_pylist()] + [(0, {})]
            at = [len(hits) - 1 if i is None else i for i in urls.indices.to_pylist()]
            bad = [bool(hard) or sum(light.values()) >= soft_limit for hard, light in hits]
            verdicts = [v or ("block" if bad[i] else "allow") for v, i in zip(b.column("told").to_pylist(), at)]
            counts = [pa.array([f(hits[i]) for i in at], pa.int64()) for f in (lambda x: x[0], lambda x: len(x[1]))]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in ("page_id", "host", "path", "rule")], pa.array(verdicts, pa.string()), *counts], ["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_terms"])

    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, strict_hits long, soft_terms long")


def verdict_sql(table: str, rules: Sequence[Rule], strict: Sequence[str] = STRICT_TERMS, soft: Mapping[str, float] = SOFT_TERMS, soft_limit: float = SOFT_LIMIT) -> str:
    """The query of :func:`filter_urls` as SQL (page_id, host, path, rule, verdict)."""
    whole = "(^|[^a-z0-9]){}([^a-z0-9]|$)"
    hard = f"regexp_matches(low, '{whole.format('(' + '|'.join(strict) + ')')}')"
    light = " + ".join(f"CASE WHEN regexp_matches(low, '{whole.format(t)}') THEN {w} ELSE 0 END" for t, w in soft.items())
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN " for _, h, p in ordered]
    rule = "CASE " + " ".join(f + f"'{h}{p}'" for f, (_, h, p) in zip(fits, ordered)) + " END" if rules else "CAST(NULL AS VARCHAR)"
    told = " ".join(f + f"'{v}'" for f, (v, _, _) in zip(fits, ordered))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH raw AS (SELECT page_id, coalesce(url, '') AS u FROM {table}),
parts AS (
  SELECT page_id, translate(u, '{upper}', '{lower}') AS low,
    translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{upper}', '{lower}') AS host,
    regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM raw)
SELECT page_id, host, path, {rule} AS rule,
  CASE {told} WHEN {hard} OR ({light}) >= {soft_limit} THEN 'block' ELSE 'allow' END AS verdict
FROM parts"""
