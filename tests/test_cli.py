"""The command line from text files to reports."""

from __future__ import annotations

import random

from millrace import cli
from millrace.plans import stages
from millrace.sources import download


def test_all_stages(spark, tmp_path):
    r = random.Random(1)
    for lang in ("one", "two"):
        stock = ["".join(r.choices("abcdefgh", k=r.randrange(2, 7))) for _ in range(60)]
        paras = ["\n".join(" ".join(r.choices(stock, k=9)) for _ in range(3)) for _ in range(60)]
        (tmp_path / f"{lang}.txt").write_text("\n\n".join([*paras, paras[0], "short", "1234 5678 9012 3456 7890 1234"]))
    args = ["--lang", f"one={tmp_path}/one.txt", "--lang", f"two={tmp_path}/two.txt", "--lang", f"none={tmp_path}/none.txt", "--out", f"{tmp_path}/out", "--script", "latin", "--vocab-size", "400"]
    assert cli.main([*args, "--verify", "--tokenizer-file", f"gone={tmp_path}/gone.json"]) == 0
    docs = spark.read.parquet(f"{tmp_path}/out/corpus/one")
    counts = {x["split"]: x["count"] for x in docs.groupBy("split").count().collect()}
    assert counts == {"train": 57, "test": 3}
    read = lambda name: spark.read.json(f"{tmp_path}/out/{name}").collect()
    got = {x["lang"]: x for x in read("reports/comparison")}
    assert set(got) == {"one", "two"} and all(x["best_bpc"] > 0 for x in got.values())
    swept = {(x["lang"], x["tokenizer"]) for x in read("json/tokenizers/sweep")}
    assert len(swept) == 7 and {x["tokenizer"] for x in read("json/tokenizers/sandhi_ablation")} == {"akshara_bpe", "akshara_bpe_sandhi"}
    assert all(x["documents"] == x["round_trips"] > 0 for x in read("json/verified")) and {x["condition"] for x in read("json/compressed")} >= {"gzip", "zstd", "ngram", "ngram_syllables"}
    master = read("reports/master")
    assert len(master) == 2 and all(x["gzip_lzma"] > "0" and x["ngram"] > "0" for x in master) and len(read("reports/tokenizer_markdown")) == 2
    assert spark.read.parquet(f"{tmp_path}/out/splits").where("lang = 'one' and split = 'test'").count() == 3
    assert spark.read.text(f"{tmp_path}/out/text/two/test").where("value != ''").count() == 9
    assert cli.main([*args, "--stage", "2d"]) == 0 and cli.main([*args, "--stage", "4", "--table-only"]) == 0
    assert cli.main([*args, "--global-near-dedup", "--again", "--stage", "1"]) == 0 and cli.main([*args, "--diagnose"]) == 0


def test_half_written_tables_are_made_again(spark, tmp_path):
    path = str(tmp_path / "t")
    assert stages.stored(spark, path, lambda: spark.range(3)).count() == 3
    assert stages.stored(spark, path, lambda: spark.range(9)).count() == 3
    (tmp_path / "t" / "_SUCCESS").unlink()
    assert stages.stored(spark, path, lambda: spark.range(9)).count() == 9


def test_failed_conditions_are_records(spark):
    ok = lambda: spark.createDataFrame([("x", 1, 2, 8.0, 8.0, 4.0)], "lang string, total_chars long, total_bytes long, total_bits double, bpc double, bpb double")

    def fails():
        raise ValueError("no model")

    got = {r["condition"]: r for r in stages.records({"a": ok, "b": fails}, spark).collect()}
    assert got["a"]["bpc"] == 8.0 and got["b"]["error"] == "no model" and got["b"]["lang"] is None


def test_copies_go_on_where_they_broke(spark, tmp_path):
    docs = spark.createDataFrame([(i, "कखग") for i in range(8)], "doc_id long, text string")
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("connection lost")
        return docs

    told = {r["source"]: r for r in download.copy_all(spark, {"a": flaky, "b": lambda: docs.where("false")}, str(tmp_path), 25, pause=0.0).collect()}
    assert told["a"]["status"] == "ok" and told["a"]["bytes"] == 24 and told["b"]["status"] == "incomplete" and len(calls) == 3
    for target in (20, 40):
        assert download.copy_texts(spark, lambda: docs, str(tmp_path / "c"), target, pause=0.0) and download.stored_bytes(spark, str(tmp_path / "c")) == target
