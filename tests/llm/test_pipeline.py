"""The pipeline's stages one after another, on awkward rows and on a small table."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from millrace.llm import components, decontam, minhash, oracles

from . import data


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def test_stages(spark, tables, pipeline):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    ids, columns = {r[0] for r in docs.select("doc_id").collect()}, docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables).cache()
        left = {r[0] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and left <= ids and left, name
        ids = left
    out = pipeline.run(spark, tables).collect()
    assert {r["doc_id"] for r in out} == ids and all(r["n_tokens"] == len(r["ids"]) and r["round_trip"] for r in out)


def test_stages_equal_plain_versions(spark, tables, pipeline):
    """Each stage on its own input against SQL or a plain version of it, and run() against all of them in a row."""
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tables}/documents.parquet'")
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert len(rows) == docs.count()

    got = pipeline.quality(spark, docs, tables)
    want = {r[0] for r in c.sql(f"select doc_id from ({oracles.quality_rules_sql()}) where kept").fetchall()}
    assert {r["doc_id"] for r in got.collect()} == want and len(want) > 100

    ids = sorted(want)
    root = data.components([data.shingles(rows[i]["text"]) for i in ids], 80)
    want = [ids[k] for k in sorted(set(root))]
    got = pipeline.near_dedup(spark, docs.where(F.col("doc_id").isin(ids)), tables).collect()
    assert sorted(r["doc_id"] for r in got) == want and 100 < len(want) < len(ids) and all(tuple(r) == tuple(rows[r["doc_id"]]) for r in got)

    texts = dict(zip(want, data.cut([rows[i]["text"] for i in want], 280, 51)))
    third = pipeline.repeat_removal(spark, docs.where(F.col("doc_id").isin(want)), tables)
    assert {r["doc_id"]: r["text"] for r in third.collect()} == texts and all(r["n_chars"] == len(r["text"]) for r in third.collect())
    assert sum(texts[i] != rows[i]["text"] for i in want) > 3

    items = [data.tokens(r["text"]) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    masks = lambda item: (*decontam.MASKS, "1" * len(item)) if len(item) < max(map(len, decontam.MASKS)) else decontam.MASKS
    bad = {i for i in want if any(len(item) >= 4 and data.leaks(data.tokens(texts[i]), item, masks(item), min(12, 0.8 * len(item))) for item in items)}
    fourth = pipeline.decontamination(spark, third, tables)
    assert {r["doc_id"] for r in fourth.collect()} == set(want) - bad

    out = pipeline.run(spark, tables).collect()
    assert {r["doc_id"]: r["decoded"] for r in out} == {i: texts[i].replace("▁", " ") for i in want if i not in bad}
    assert all(r["n_tokens"] == len(r["ids"]) and r["round_trip"] for r in out)
    one = spark.createDataFrame([(i, texts[i]) for i in want if i not in bad], "doc_id long, text string")
    assert sorted((r["doc_id"], r["ids"]) for r in out) == sorted((r["doc_id"], r["ids"]) for r in pipeline.tokens(spark, one, tables).collect())


def test_run_leaves_one_table(spark, tables, pipeline):
    from millrace.llm.textbatch import shared_folder

    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tables")
    listed = lambda: {str(f.getPath()) for f in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)}
    pipeline.run(spark, tables).count()
    before = listed()
    pipeline.run(spark, tables).count()
    assert len(listed() - before) == 1  # what the last stage reads


def test_stages_take_awkward_rows(spark, tables, pipeline):
    docs = spark.createDataFrame(data.documents(), data.SCHEMA)
    for rows in (docs, docs.where("false")):
        for name, stage in pipeline.STAGES:
            assert stage(spark, rows, tables).count() <= rows.count(), name


def test_repeat_removal_cuts_passages_of_short_words(spark, tables, pipeline):
    passage, long_ = " ".join(f"{chr(97 + k % 26)}{k // 26}" for k in range(51)), "字" * 100
    texts = [f"{data.prose(1, 80)} {passage} {data.prose(2, 80)}", f"{data.prose(3, 80)} {passage} {data.prose(4, 80)}", f"one {long_}", f"two {long_}"]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in pipeline.repeat_removal(spark, docs, tables).collect()}
    assert len(passage.encode()) < 280
    assert [got[k].split() for k in (0, 1)] == [(data.prose(a, 80) + " " + data.prose(a + 1, 80)).split() for a in (1, 3)]
    assert [got[2].strip(), got[3].strip()] == ["one", "two"]


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert ("pipeline" in names) == os.path.exists(os.path.join(os.path.dirname(entry.__file__), "corpus_pipeline.py"))


def test_near_dedup_hands_the_planner_no_growing_estimates(spark, tables, pipeline, monkeypatch):
    seen = []
    for module in (minhash, components):

        def noted(df, plain=module.checkpoint):
            seen.append(plain(df))
            return seen[-1]

        monkeypatch.setattr(module, "checkpoint", noted)
    pipeline.near_dedup(spark, spark.read.parquet(f"{tables}/documents.parquet"), tables)
    assert seen and all(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 64 for df in seen)
