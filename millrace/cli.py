"""Command line: stages 1 (curate), 2 (tokenizers), 2d (pieces to extend a tokenizer by), 3 (compress), 4 (benchmark), 5 (reports), or all but 2d.

python -m millrace.cli --stage all --lang hindi=data/hindi.txt --out out
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .config import DEVANAGARI, LATIN
from .operators.tokenizers import Training
from .plans import stages
from .sources import readers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--stage", choices=["1", "2", "2d", "3", "4", "5", "all"], default="all")
    p.add_argument("--lang", action="append", required=True, metavar="NAME=PATH", help="a language and its text file or folder; repeat for more")
    p.add_argument("--out", required=True)
    p.add_argument("--target-bytes", type=int, default=100 << 20)
    p.add_argument("--script", choices=["devanagari", "latin"], default="devanagari")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--vocab-size", type=int, default=32_000)
    p.add_argument("--tokenizer-file", action="append", default=[], metavar="NAME=PATH", help="a tokenizer to measure beside the trained ones")
    p.add_argument("--base-tokenizer", help="stage 2d: the tokenizer file to extend; single characters without one")
    p.add_argument("--global-near-dedup", action="store_true", help="bands over the whole corpus in place of the last 200 paragraphs")
    p.add_argument("--classical-only", action="store_true", help="stages 3 and 4 without the n-gram model")
    p.add_argument("--verify", action="store_true", help="stage 3: also code and decode the measured characters")
    p.add_argument("--table-only", action="store_true", help="stage 4: only the tables of what is stored")
    p.add_argument("--diagnose", action="store_true", help="only list very long lines")
    p.add_argument("--again", action="store_true", help="run stages whose output exists")
    return p


def corpus(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    """Stage 1: the splits of all languages that have a source, stored and exported; None with ``--diagnose`` or without sources."""
    script = {"devanagari": DEVANAGARI, "latin": LATIN}[a.script]
    docs = None
    for item in a.lang:
        lang, path = item.split("=", 1)
        lines = stages.read_sources(spark, lang, {"text": [path]}, 3 * a.target_bytes)
        if lines is None:
            continue
        if a.diagnose:
            lines.where(f"length(line) > {script.max_line}").selectExpr("line_no", "length(line) AS chars", "substring(line, 1, 100) AS preview").limit(20).show(truncate=False)
            continue
        made = stages.stored(spark, f"{a.out}/corpus/{lang}", lambda lines=lines: stages.split(stages.clean(lines, script, not a.global_near_dedup), a.target_bytes, seed=a.seed), a.again)
        for part in ("train", "test"):
            if a.again or not readers.complete(spark, f"{a.out}/text/{lang}/{part}"):
                readers.export_text(made.where(f"split = '{part}'"), f"{a.out}/text/{lang}/{part}")
        docs = made if docs is None else docs.unionByName(made)
    if docs is not None and (a.again or not readers.complete(spark, f"{a.out}/splits")):
        readers.write_splits(docs, f"{a.out}/splits")
    return docs


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("millrace").getOrCreate()
    docs = corpus(spark, a)
    if docs is None or a.stage == "1":
        return 0
    keep = lambda name, make: stages.stored(spark, f"{a.out}/{name}", make, a.again)
    have = lambda name: spark.read.parquet(f"{a.out}/{name}") if readers.complete(spark, f"{a.out}/{name}") else None
    training = Training(vocab_size=a.vocab_size)
    files = dict(x.split("=", 1) for x in a.tokenizer_file)
    if a.stage in ("2", "all"):
        for name, df in stages.tokenizer_stage(docs, files, training).items():
            readers.write_json(keep(f"tokenizers/{name}", lambda df=df: df), f"{a.out}/json/tokenizers/{name}")
        readers.write_json(stages.syllable_map(docs), f"{a.out}/syllables")
    if a.stage == "2d":
        readers.write_json(stages.extension(docs, a.base_tokenizer, training), f"{a.out}/extension")
    if a.stage in ("3", "all"):
        readers.write_json(keep("compressed", lambda: stages.compression(docs, a.classical_only)), f"{a.out}/json/compressed")
        if a.verify:
            readers.write_json(stages.verified(docs), f"{a.out}/json/verified")
    if a.stage in ("4", "all") and not a.table_only:
        keep("benchmark", lambda: stages.benchmark(docs.where("split = 'test'").select("doc_id", "lang", "text")))
        if not a.classical_only:
            keep("generated", lambda: stages.generated(docs))
    if a.stage in ("4", "5", "all"):
        measured = {k: keep(f"measured/{k}", lambda df=df: df) for k, df in stages.measure(docs).items()}
        if have("benchmark") is None and have("compressed") is None:
            print("run stage 3 or 4 first")
            return 1
        for name, df in stages.reports(measured, have("benchmark"), have("compressed"), have("tokenizers/sweep")).items():
            if a.stage != "4" or name == "master":
                readers.write_json(df, f"{a.out}/reports/{name}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
