"""Edge rows of the text, curation, sampling, segmentation, coding and report operators."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.config import DEVANAGARI, LATIN, NearDedup
from millrace.functions import text as T
from millrace.operators import coding, curate, lockstep, metrics, ngram, ordered, report, sample, segment, vocabulary
from millrace.sources import readers


def value(spark, column, text=""):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("क्षेत्रज्ञान", ["क्षे", "त्र", "ज्ञा", "न"]), ("क ab१।", ["क", "▁", "a", "b", "१", "।"]), ("िक", ["ि", "क"]), ("", []), ("क\nख", ["क", "\n", "ख"]), ("अं😀", ["अं", "😀"])],
)
def test_aksharas(spark, text, want):
    assert value(spark, T.aksharas(F.col("t")), text) == want


def test_text_functions(spark):
    f = lambda c, t: value(spark, c, t)
    t = F.col("t")
    assert f(T.nfc(t), "क़") == "क़" and f(T.nfc(t), "é") == "é" and f(T.nfc(t), None) is None
    assert f(T.script_ratio(t), "कि ab") == pytest.approx(1 / 3) and f(T.script_ratio(t), "१२३ !!") == 0.0
    assert f(T.strip_boilerplate(t), "see a@b.c now") == "see now" and f(T.strip_boilerplate(t), "see a@b now") == "see a@b now"
    assert f(T.strip_boilerplate(t), "क???") == "क।" and f(T.strip_boilerplate(t), "x https://a.b/c y &amp; &#12; z") == "x y z"
    assert f(T.strip_wiki_markup(t), "== a ==\nb\n[[Category:X]]\n[[p|q]] '''r'''") == "b\nq r"
    assert f(T.strip_wiki_markup(t), "{{a {{b}} c}}") == "c}}" and f(T.strip_wiki_markup(t), "[[File:x.png]]* y\n#REDIRECT z") == "* y"
    assert f(T.body_of_edition(t), "## h\nInput by x\n\n12.3\nverse\n45\nThis stays") == "verse\nThis stays" and f(T.body_of_edition(t), "## h") == ""
    assert [f(T.split_compounds(t), w) for w in ("महाभारत", "प्रतिदिन", "सुख", "प्रतिx")] == ["महा भारत", "प्रति दिन", "सुख", "प्र तिx"]
    assert f(T.strip(t), "  x\t ") == "x" and f(T.words(t), " a b\tc ") == ["a", "b", "c"]
    assert f(T.head_and_tail(t, 4), "abcdef") == "abef" and f(T.shingles(t, 5), "abc") == ["abc"] and f(T.shingles(t, 2), "a😀b") == ["a😀", "😀b"]
    for n in range(9):
        s = "aé😀z"
        assert f(T.utf8_prefix(t, n), s) == s.encode()[:n].decode("utf-8", "ignore")


def lines(spark, rows):
    return spark.createDataFrame([(1, "hi", "s", i, x) for i, x in enumerate(rows)], "doc_id long, lang string, source string, line_no long, line string")


def test_undone_sandhi_and_graphemes(spark):
    rows = spark.createDataFrame([(1, "गणेश"), (2, "e\u0301a\r\nb"), (3, ""), (4, None)], "k int, t string")
    got = rows.select(T.undo_sandhi(F.col("t")).alias("u"), T.graphemes(F.col("t")).alias("g")).orderBy("k").collect()
    assert [x["u"] for x in got] == ["गणअ ेइश", "e\u0301a\r\nb", "", None]
    assert [x["g"] for x in got[1:]] == [["e\u0301", "a", "\r\n", "b"], [], None]


def test_line_rules(spark):
    deva = "क" * 20
    got = [r["status"] for r in curate.classify(lines(spark, ["", "क" * 19, deva, "a" * 20, deva + "a" * 5]), DEVANAGARI).orderBy("line_no").collect()]
    assert got == ["blank", "short", "keep", "script", "keep"]
    long = curate.classify(lines(spark, ["क" * 20_001]), DEVANAGARI).first()
    assert len(long["cleaned"]) == 20_000


def test_first_lines_keep_blanks(spark):
    kept = curate.first_lines(lines(spark, ["A", "", "A", ""]))
    assert sorted(r["line_no"] for r in kept.collect()) == [0, 1, 3]
    assert curate.first_lines(kept).count() == 3


def test_paragraphs_split_at_rejected_lines(spark):
    a, b = "क" * 20, "ख" * 21
    p = curate.paragraphs(curate.classify(lines(spark, [a, "x", "", b, a]), DEVANAGARI)).orderBy("first_line").collect()
    assert [r["text"] for r in p] == [a, f"{b}\n{a}"]


def test_sequential_near_dedup_forgets(spark):
    spec = NearDedup(window=3)
    text = lambda i: f"{i} " + " ".join(f"word{i * 37 + k}" for k in range(20))
    rows = [text(0), text(1), text(2), text(3), text(0), text(3), "short", "short"]
    paras = spark.createDataFrame([(1, "hi", i, x) for i, x in enumerate(rows)], "doc_id long, lang string, first_line long, text string")
    got = [r["duplicate"] for r in curate.near_dedup_sequential(paras, spec).orderBy("first_line").collect()]
    assert got == [False, False, False, False, False, True, False, False]
    # the global form drops the far duplicate too
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in curate.near_dedup_lsh(docs).collect()) == [0, 1, 2, 3, 6, 7]


def test_signature_bands_lose_nothing():
    spec = NearDedup()
    assert spec.matches == 26
    r = random.Random(1)
    for _ in range(200):
        wrong = set(r.sample(range(32), 6))
        assert any(not wrong & set(range(4 * b, 4 * b + 4)) for b in range(spec.bands))


def test_greedy_pack_skips(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "hi", s) for i, s in enumerate([5, 9, 2] * 40)], "doc_id long, lang string, size long")
    order = sorted(range(120), key=lambda i: __import__("hashlib").md5(f"42|{i}".encode()).hexdigest())
    for budget, most in ((7, 200_000), (100, 10), (10_000, 10)):
        monkeypatch.setattr(sample, "PACK_ROWS", most)
        room, want = budget, set()
        for i in order:
            if [5, 9, 2][i % 3] <= room:
                room -= [5, 9, 2][i % 3]
                want.add(i)
        assert {r["doc_id"] for r in sample.greedy_pack(rows, budget).collect()} == want


@pytest.mark.parametrize("n", [1, 19, 20, 21])
def test_split_counts(spark, n):
    docs = spark.createDataFrame([(i, "hi") for i in range(n)], "doc_id long, lang string")
    got = sample.train_test_split(docs).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got}.get("train", 0) == math.floor(0.95 * n) and sum(r["count"] for r in got) == n


def test_partitions_do_not_matter(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for q in (lambda d: sample.train_test_split(d), lambda d: curate.first_lines(curate.lines_of(d)).select("doc_id", "line_no"), lambda d: sample.corpus_ends(d, 5000, True)):
        assert sorted(map(str, q(docs.repartition(1)).collect())) == sorted(map(str, q(docs.repartition(7)).collect()))


def test_running_total(spark):
    rows = spark.createDataFrame([(i * i, "g", i) for i in range(300)], "doc_id long, g string, v long")
    got = {r["doc_id"]: r["t"] for r in ordered.by_number(rows, ["g"], ["doc_id"], F.col("v"), "t").collect()}
    assert all(got[i * i] == i * (i + 1) // 2 for i in range(300))


def test_entropy(spark):
    docs = spark.createDataFrame([("a", "aabb"), ("b", "aaa"), ("c", "")], "lang string, text string")
    got = {r["lang"]: r["entropy"] for r in metrics.entropy(metrics.char_counts(docs)).collect()}
    assert got == {"a": 1.0, "b": 0.0} and math.copysign(1, got["b"]) == 1
    words = spark.createDataFrame([(1, "x", "a a b")], "doc_id long, lang string, text string")
    assert metrics.complexity(words).first()["hapax_ratio"] == 0.5


def test_empty_text_has_no_ratio(spark):
    m = metrics.compression_metrics(F.lit(20), F.lit(0), F.lit(0))
    assert all(value(spark, c) is None for c in m.values())


def test_vowel_split_is_null_without_signs(spark):
    rows = spark.createDataFrame([("hi", "कि", ["Ġx", "y"])], "lang string, s string, p array<string>")
    assert metrics.tokenizer_metrics(rows, F.col("p"), F.col("s")).first()["vowel_split_pct"] is None
    rows = spark.createDataFrame([("hi", "कि", ["▁क", "ि"])], "lang string, s string, p array<string>")
    assert metrics.tokenizer_metrics(rows, F.col("p"), F.col("s")).first()["vowel_split_pct"] == 100.0


def test_private_use_ranges(spark):
    vocabulary = spark.range(6402).select(F.lit("hi").alias("lang"), F.lpad(F.col("id").cast("string"), 6, "0").alias("akshara"))
    cps = [r["cp"] for r in segment.pua_map(vocabulary).orderBy("akshara").collect()]
    assert cps[0] == 0xE000 and cps[6399] == 0xF8FF and cps[6400:] == [0xF0000, 0xF0001]


def test_merges(spark):
    words = spark.createDataFrame([("aaab", 5), ("aab", 3), ("b", 9)], "word string, n long")
    assert segment.train_merges(words, 2) == [("a", "a"), ("a", "b")]  # aa: 13, then a b and aa a (in aaab) with 5, aa b with 3
    assert segment.train_merges(words.where("word != 'aaab'"), 3) == [("a", "a"), ("aa", "b")]
    assert value(spark, segment.merge_pair(F.split("t", ""), "a", "a"), "aaab") == ["aa", "a", "b"]


def test_blocks(spark):
    ids = F.sequence(F.lit(1), F.lit(5))
    assert value(spark, segment.token_blocks(ids, 10)) == [] and value(spark, segment.token_blocks(ids, 2)) == [[1, 2], [3, 4]]
    assert value(spark, segment.score_windows(ids, 3)) == [[1, 2, 3], [3, 4, 5]]


def test_arithmetic_coder():
    r = np.random.default_rng(0)
    p = r.random(8)
    table = coding.quantize(p / p.sum())
    ids = r.integers(0, 8, 300).tolist()
    packed = coding.encode_ids(ids, lambda ids, n: table, 8)
    assert coding.decode_ids(packed, lambda ids, n: table, 8) == ids and coding.decode_ids(coding.encode_ids([], lambda ids, n: table, 8), lambda ids, n: table, 8) == []
    model = ngram.BigramModel({1: {2: 50}}, 4)
    seq = [1, 2, 1, 2, 3, 0]
    coder = lambda ids, n: coding.quantize(model.next_probs(ids[:n]))
    assert coding.decode_ids(coding.encode_ids(seq, coder, 4), coder, 4) == seq and model.sample([1], 5, 3) == model.sample([1], 5, 3)


def test_quantizer_has_a_limit():
    p = np.full(48_000, 0.15 / 47_998)
    p[:2] = 0.45, 0.40
    with pytest.raises(ValueError):
        coding.quantize(p, 16)
    assert coding.quantize(p, 24)[-1] == 1 << 24 and np.diff(coding.quantize(p, 24)).min() >= 1


def test_codecs(spark):
    docs = spark.createDataFrame([(1, "hi", "abc " * 50), (2, "hi", ""), (3, "hi", None)], "doc_id long, lang string, text string")
    got = coding.compress_documents(docs).collect()
    assert len(got) == 18 and all(r["round_trip"] for r in got)
    assert all(r["round_trip"] for r in coding.arithmetic_round_trip(docs).collect())
    assert coding.compress_groups(docs, ["gzip"]).first()["original_bytes"] == 204


#: Published sizes of whole test splits (language, bytes, characters).
PUBLISHED_TESTS = [("hindi", 5703559, 2244197), ("marathi", 5290734, 2003464), ("sanskrit", 2298011, 849105)]
#: Published compressed bytes (language, codec, bytes).
PUBLISHED_SIZES = [
    ("hindi", "gzip", 1178348), ("hindi", "bzip2", 802586), ("hindi", "lzma", 835072), ("hindi", "zstd", 850649),
    ("marathi", "gzip", 1098307), ("marathi", "bzip2", 741387), ("marathi", "lzma", 756980), ("marathi", "zstd", 767965),
    ("sanskrit", "gzip", 432484), ("sanskrit", "bzip2", 305170), ("sanskrit", "lzma", 326416), ("sanskrit", "zstd", 331425),
]


def test_lockstep_coder_equals_the_plain_one(monkeypatch):
    r = random.Random(8)
    texts = [b"", b"a", b"ab", b"a" * 3000, bytes(range(256)) * 2, r.randbytes(2000), b"\xff" * 700, "é und ü ".encode() * 90]
    texts += [bytes(r.choices(b"abcdefg h", k=r.randrange(1, 600))) for _ in range(40)]
    want = [coding.encode_ids(t, coding.byte_bigrams(), 256) for t in texts]
    broken = [c[:k] + bytes([c[k] ^ 1 << r.randrange(8)]) + c[k + 1 :] for c in want for k in [r.randrange(len(c))]]
    back = lambda c: bytes(coding.decode_ids(c, coding.byte_bigrams(), 256))
    few = [back(c[:4] + c[4:]) == t for c, t in zip(want[:20], texts)]
    for alone in (0, 5, 1000):
        monkeypatch.setattr(lockstep, "FEW", alone)
        laid = lockstep.Texts(texts)
        assert laid.encode() == want and laid.decodes(want).all() and all(few)
        whole = [i for i, c in enumerate(broken) if c[:4] == want[i][:4]]  # of the right length
        assert [bool(laid.decodes(broken)[i]) for i in whole] == [back(broken[i]) == texts[i] for i in whole]
    began = time.perf_counter()
    lockstep.round_trips([bytes(r.choices(b"abcdefg h", k=2000)) for _ in range(300)])
    assert time.perf_counter() - began < 20  # the plain coder takes some 40 s for so many bytes

def test_published_arithmetic(spark):
    tests = spark.createDataFrame(PUBLISHED_TESTS, "lang string, original_bytes long, original_chars long")
    measured = report.with_metrics(spark.createDataFrame(PUBLISHED_SIZES, "lang string, codec string, compressed_bytes long").join(tests, "lang")).persist()
    got = {(r["lang"], r["codec"]): r for r in measured.collect()}
    r = got["hindi", "gzip"]
    assert (r["ratio"], r["bpc"], r["bpb"]) == (4.8403, 4.2005, 1.6528)
    assert {x["best_codec"] for x in report.best_codec(measured).collect()} == {"bzip2"}


def test_vocabulary(spark):
    lines = spark.createDataFrame([(" ".join(random.Random(i).choices(["ka", "kala", "mala", "lama"], k=8)),) for i in range(200)], "line string")
    model = vocabulary.train_model(lines, vocab_size=100_000)
    got = vocabulary.encode_pieces(lines.select(F.col("line").alias("text")), model).collect()
    assert all(r["roundtrip_ok"] for r in got)
    assert vocabulary.largest_vocabulary("Please set it to a value <= 281.") == 281 and vocabulary.hub_record("x", OSError("gated repo"))["hint"]


def test_readers(spark, tmp_path):
    (tmp_path / "wiki.xml").write_text(
        '<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.10/"><page><title>A</title><revision><text>' + "word " * 30 + "[[Category:X]]</text></revision></page>"
        "<page><title>B</title><revision><text>short</text></revision></page></mediawiki>"
    )
    assert [r["title"] for r in readers.wiki_articles(spark, str(tmp_path / "wiki.xml")).collect()] == ["A"]
    (tmp_path / "a.txt").write_text("## head\n\n" + "verse " * 30 + "\n12\n")
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "b.xml").write_text('<TEI xmlns="http://www.tei-c.org/ns/1.0"><h>no</h><text><body><p>' + "stanza " * 30 + "</p></body></text></TEI>")
    got = readers.tei_texts(spark, str(tmp_path / "a.txt"), str(tmp_path / "x")).orderBy("source_ord").collect()
    assert [r["text"].split()[0] for r in got] == ["verse", "stanza"] and readers.tei_body("<broken") == ""
    assert [r["line"] for r in readers.text_lines(spark, str(tmp_path / "a.txt")).orderBy("line_no").collect()][0] == "## head"
    assert readers.first_source(spark, [str(tmp_path / "none"), str(tmp_path / "a.txt")]).endswith("a.txt") and readers.first_source(spark, []) is None
    assert readers.json_results(spark, [str(tmp_path / "none.json")], "a int").count() == 0
    readers.write_json(spark.range(7).coalesce(1), str(tmp_path / "lines"))
    (tmp_path / "array.json").write_text('[{"id": 1},\n {"id": 2}]')
    assert [readers.json_results(spark, [str(tmp_path / n)], "id long").count() for n in ("lines", "array.json")] == [7, 2]
    odd = spark.createDataFrame([(1, None), (2, "<TEI><body>a &amp; b</body></TEI>"), (2, "<TEI>")], "k int, xml string")
    assert sorted(map(tuple, readers.tei_bodies(odd, "k", "xml").collect())) == [(1, ""), (2, ""), (2, "a & b")]
    steps = spark.createDataFrame([("m/step_9",), ("m/step_10",), ("m/final",)], "path string")
    assert readers.latest_checkpoint(spark, steps).first()["step"] == 10


def test_stream_equals_batch(spark, tables, tmp_path):
    from millrace.streaming import curation

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = curation.clean_stream(readers.document_stream(spark, str(tmp_path / "in"), docs.schema), LATIN)
    curation.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == curate.kept_lines(docs, LATIN).count()


def test_learning_rate(spark):
    rows = ngram.learning_rate(spark.range(0, 11).withColumnRenamed("id", "step"), 1.0, 5, 10).orderBy("step").collect()
    assert rows[5]["rate"] == 1.0 and rows[10]["rate"] == 0.0 and rows[1]["rate"] == pytest.approx(0.2)


def test_runs_without_the_optional_parts(tmp_path):
    """The entry module imports and the library's queries stay when the optional subpackage is gone."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "millrace"), tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and len(e.oracle_sql()) > 50 and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_exact_budget(spark):
    docs = spark.createDataFrame([(i, "hi", "कखग") for i in range(5)], "doc_id long, lang string, text string")
    got = {r["doc_id"]: r["text"] for r in sample.exact_budget(docs, 25).collect()}
    assert got == {0: "कखग", 1: "कखग", 2: "क"}
    assert {r["doc_id"] for r in sample.exact_budget(docs, 30, done=10).collect()} == {1, 2}
