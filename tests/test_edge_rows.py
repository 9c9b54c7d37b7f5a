"""The core operators on nulls, repeated ids and rows, empty texts and tables, and columns with clashing names, against plain Python."""

from __future__ import annotations

import collections
import multiprocessing
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace import config
from millrace.config import LATIN, NearDedup
from millrace.functions import arrays
from millrace.functions import text as T
from millrace.operators import coding, curate, metrics, ngram, ordered, report, sample, segment, tokenizers
from millrace.plans import catalog, queries

SCHEMA = "doc_id long, lang string, source string, text string, size long, _range string, _total string, _before string, _key string, _first string, rank string, cleaned string, part string"
CLASH = ("a", "b", "c", "d", "e", "f", "g", "h")


def rows():
    """Documents in awkward order: null ids, languages, sources, texts and sizes, ids that repeat with the same and other texts, empty texts."""
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdeéfg", k=r.randrange(1, 9)))
    texts = ["\n".join(" ".join(word() for _ in range(r.randrange(0, 12))) for _ in range(r.randrange(1, 6))) for _ in range(40)]
    out = [(i if i % 11 else None, [None, "en", "fr", ""][i % 4], None if i % 7 == 0 else f"s{i % 3}", t, len(t.encode())) for i, t in enumerate(texts)]
    out += [out[5], out[5], (5, "fr", "s1", texts[8], len(texts[8].encode())), (60, "en", None, None, None), (61, None, None, "", 0), (10**12, "en", "s1", texts[9], len(texts[9].encode())), (None, None, None, None, None)]
    return [(*x, *CLASH) for x in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_lang():
    out = collections.defaultdict(list)
    for x in rows():
        out[x[1]].append(x)
    return out


def order(x):
    """Null ids first."""
    return (x[0] is not None, x[0] or 0)


def test_running_totals(docs, empty):
    got = ordered.by_number(docs.where("size is not null"), ["lang"], ["doc_id"], F.col("size"), "t")
    for lang, mine in by_lang().items():
        mine = [x for x in mine if x[4] is not None]
        totals = [t["t"] for t in got.where(F.col("lang").eqNullSafe(F.lit(lang))).orderBy("doc_id", "t").collect()]
        want, run = [], 0
        for x in sorted(mine, key=order):
            run += x[4]
            want.append(run)
        assert len(totals) == len(mine) and max(totals) == run
        if len({x[0] for x in mine}) == len(mine):
            assert totals == want
    assert set(got.columns) == {*docs.columns, "t"} and ordered.by_number(empty, ["lang"], ["doc_id"], F.col("size"), "t").count() == 0


@pytest.mark.parametrize("reverse", [False, True])
def test_running_totals_of_outlying_numbers(spark, reverse):
    r = random.Random(1)
    numbers = [*range(500), *(10**15 + 10**9 * k for k in range(500))]
    r.shuffle(numbers)
    table = spark.createDataFrame([(k, n % 13) for k, n in zip(numbers, range(1000))], "k long, v long").repartition(4)
    got = {x["k"]: x["t"] for x in ordered.by_number(table.withColumn("g", F.lit(None).cast("string")), ["g"], ["k"], F.col("v"), "t", reverse).collect()}
    run = 0
    for k, v in sorted(((x["k"], x["v"]) for x in table.collect()), reverse=reverse):
        run += v
        assert got[k] == run


def test_split_keeps_every_row(docs, empty):
    got = sample.train_test_split(docs)
    counts = collections.Counter((x["lang"], x["split"]) for x in got.collect())
    for lang, mine in by_lang().items():
        assert counts[lang, "train"] == int(0.95 * len(mine)) and counts[lang, "train"] + counts[lang, "test"] == len(mine)
    marked = sample.mark_split(docs)
    assert marked.count() == docs.count() and marked.columns == [*docs.columns, "split"]
    assert sample.train_test_split(empty).count() == sample.mark_split(empty).count() == 0


def test_budgets(docs, empty):
    got = collections.Counter((x["lang"], x["doc_id"]) for x in sample.within_budget(docs, ["lang"], ["doc_id"], "size", 300).collect())
    for lang, mine in by_lang().items():
        run, n = 0, 0
        for x in sorted(mine, key=order):
            n += run < 300
            run += x[4] or 0
        assert abs(sum(v for (g, _), v in got.items() if g == lang) - n) <= 2  # ids that repeat stand in any order
    packed = sample.greedy_pack(docs, 400)
    for lang, mine in by_lang().items():
        assert sum(x["size"] for x in packed.where(F.col("lang").eqNullSafe(F.lit(lang))).collect()) <= 400
    assert sample.greedy_pack(empty, 5).columns == ["lang", "doc_id", "size"] and sample.greedy_pack(empty, 5).count() == 0
    assert sample.within_budget(empty, ["lang"], ["doc_id"], "size", 3).count() == 0


def test_packing_of_repeated_ids(spark, monkeypatch):
    table = spark.createDataFrame([(1, "x", 10)] * 30 + [(2, "x", 7)] * 30 + [(1, "x", 3)] * 20, "doc_id long, lang string, size long").repartition(4)
    for most in (200_000, 5):
        monkeypatch.setattr(sample, "PACK_ROWS", most)
        got = [x["size"] for x in sample.greedy_pack(table, 100).collect()]
        assert 97 < sum(got) <= 100  # nothing that fits is left out: the least size is 3


def test_quota_merge(docs, empty):
    sized = docs.where("size > 0").select("doc_id", "lang", "source", F.lit(0).alias("line_no"), "size", "_range")
    got = sample.quota_merge(sized, 600)
    for lang, mine in by_lang().items():
        mine = [x for x in mine if x[4]]
        quota = 600 // max(1, len({x[2] for x in mine}))
        for source in {x[2] for x in mine}:
            own = [x["size"] for x in got.where(F.col("lang").eqNullSafe(F.lit(lang)) & F.col("source").eqNullSafe(F.lit(source))).collect()]
            assert own and sum(own) - max(own) < quota
    assert sample.quota_merge(empty.withColumn("line_no", F.lit(0)), 5).count() == 0


def test_corpus_ends(docs, empty):
    for tail in (False, True):
        got = sample.corpus_ends(docs, 200, tail).collect()
        for lang, mine in by_lang().items():
            own = [x for x in got if x["lang"] == lang]
            assert sum(x["chars"] for x in own) == min(200, sum(len(x[3] or "") for x in mine)) and all(len(x["part"]) == x["chars"] for x in own)
        assert sample.corpus_ends(empty, 5, tail).count() == 0
    whole = sample.holdout(docs, tail=100, most=250).collect()
    for lang, mine in by_lang().items():
        n = sum(len(x[3] or "") for x in mine)
        part = lambda p: sum(len(x["text"]) for x in whole if x["lang"] == lang and x["part"] == p)
        assert part("eval") == (100 if n > 100 else 0) and part("train") == min(250, n - 100 if n > 100 else n)
    assert sample.exact_budget(docs.where("lang is null"), 77).select(F.sum(F.octet_length("text") + 1)).first()[0] in range(75, 79)  # a cut text's newline comes on top


def test_repeated_ids_do_not_multiply(spark):
    docs = spark.createDataFrame([(1, "x", t) for t in ("abc", "def", "ghi")], "doc_id long, lang string, text string")
    assert sample.corpus_ends(docs, 100, False).count() == 3
    assert {(r["original_bytes"], r["original_chars"]) for r in coding.compress_groups(docs, ["gzip", "zstd"]).collect()} == {(13, 13)}
    assert metrics.first_words(docs, 100).count() == 3


def test_first_lines(docs, empty):
    table = docs.select("doc_id", "lang", "source", F.lit(0).alias("line_no"), F.col("text").alias("line"), "_key", "_first")
    got = collections.Counter((x["lang"], x["line"]) for x in curate.first_lines(table.unionByName(table)).collect())
    want = {(x[1], x[3]) for x in rows() if x[3]}
    assert {k for k in got if k[1]} == want and all(got[k] == 1 for k in want) and got[None, ""] == 2
    same = curate.first_lines(docs.sparkSession.createDataFrame([(1, "x", "s", 0, "l"), (2, "x", "s", 0, "l"), (1, "y", "s", 0, "l")], "doc_id long, lang string, source string, line_no long, line string"))
    assert sorted((r["doc_id"], r["lang"]) for r in same.collect()) == [(1, "x"), (1, "y")]
    assert curate.first_lines(empty.withColumns({"line_no": F.lit(0), "line": F.lit("")})).count() == 0


def test_paragraphs_of_whole_files(spark):
    r = random.Random(2)
    lines = spark.createDataFrame([(k % 2, "x", "s", k * 10**9 if k > 900 else k, r.choice(["keep", "keep", "short"]), f"l{k}") for k in range(1000)], "doc_id long, lang string, source string, line_no long, status string, cleaned string")
    plain = {tuple(x) for x in curate.paragraphs(lines).collect()}
    assert {tuple(x) for x in curate.paragraphs(lines, whole_files=True).collect()} == plain and len(plain) > 100


def test_near_dedup_of_a_common_band(spark):
    """600 texts with mostly equal signatures: those with a near one of lesser id go, as by comparing all."""
    r = random.Random(4)
    base = "".join(r.choices("abcdefgh ", k=300))
    texts = [base[: (k := r.randrange(295))] + r.choice("xyzuvw") * r.randrange(1, 5) + base[k:] for _ in range(600)]
    docs = spark.createDataFrame([*enumerate(texts), (None, base), (None, None), (700, "")], "doc_id long, text string")
    signed = {x["doc_id"]: x["signature"] for x in curate.signatures(docs).collect() if x["doc_id"] is not None}
    need = curate.NearDedup().matches
    gone = {i for i in signed if any(j < i and sum(a == b for a, b in zip(signed[i], signed[j])) >= need for j in signed)}
    left = {x["doc_id"] for x in curate.near_dedup_lsh(docs).collect()}
    assert left - {None} == (set(range(600)) | {700}) - gone and len(gone) > 500
    assert {x["representative"] for x in curate.beaten_classes(curate.signatures(docs), block=32).where("representative is not null").collect()} == {x["representative"] for x in curate.beaten_classes(curate.signatures(docs)).where("representative is not null").collect()}


def test_measures(docs, empty):
    counts = {x["lang"]: x for x in metrics.complexity(docs.select("doc_id", "lang", "text")).collect()}
    for lang, mine in by_lang().items():
        w = [t for x in mine for t in (x[3] or "").split()]
        assert counts[lang]["word_count"] == len(w) and counts[lang]["type_count"] == len(set(w))
    assert metrics.complexity(empty).count() == 0 and metrics.entropy(metrics.char_counts(empty)).count() == 0
    bits = ngram.bits_per_char(docs.where("lang = 'en'"), docs.where("lang = 'en' and doc_id < 20"))
    texts = lambda which: [x["text"] or "" for x in docs.where(which).collect()]
    assert bits.first()["total_bits"] == pytest.approx(ngram.sequential_bits(texts("lang = 'en'"), texts("lang = 'en' and doc_id < 20")), abs=0.01)
    assert ngram.bits_per_char(empty, empty).count() == 0
    made = [x["text"] for x in ngram.generated(docs, 50).where("lang = 'en'").collect()]
    assert made == [x["text"] for x in ngram.generated(docs.repartition(2), 50).where("lang = 'en'").collect()] and len(made[0]) == 50


def test_codecs_stream(docs, empty):
    names = ["gzip", "bzip2", "lzma", "zstd", "gzip_bzip2", "gzip_lzma", "none"]
    got = {(x["lang"], x["codec"]): x for x in coding.compress_groups(docs, names, piece=100).collect()}
    for lang, mine in by_lang().items():
        whole = "\n\n".join(x[3] or "" for x in sorted(mine, key=lambda x: (*order(x), x[3] or "")))
        for n in names[:-1]:
            x = got[lang, n]
            assert (x["original_bytes"], x["original_chars"]) == (len(whole.encode()), len(whole))
            assert x["compressed_bytes"] == len(coding.codec(n)[0](whole.encode()))
        assert got[lang, "none"]["compressed_bytes"] is None and got[lang, "none"]["error"]
    assert coding.compress_groups(empty, names).count() == 0 and coding.compress_parts(docs, ["gzip"], part_bytes=200).count() == 4


def test_each_codec_of_a_language_has_a_task(docs, empty):
    names = ["gzip", "bzip2", "lzma", "none"]
    sizes = coding.compress_groups(docs, names)
    tasks = sizes.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert [x["count"] for x in tasks] == [1] * (4 * len(by_lang()))
    cols = ["lang", "codec", "original_bytes", "original_chars", "error"]
    assert sorted(map(str, coding.codec_inputs(docs, names).select(*cols).collect())) == sorted(map(str, sizes.select(*cols).collect()))
    assert coding.codec_inputs(empty, names).count() == 0


def test_streamed_sizes_of_long_texts(spark):
    r = random.Random(6)
    texts = [" ".join(r.choices(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"], k=60_000)) for _ in range(3)]
    docs = spark.createDataFrame([(i, "x", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    whole = "\n\n".join(texts).encode()
    for x in coding.compress_groups(docs, ["gzip", "bzip2", "lzma", "zstd", "gzip_bzip2"]).collect():
        assert x["compressed_bytes"] == len(coding.codec(x["codec"])[0](whole)), x["codec"]


def test_quantized_counts_have_a_limit(spark):
    counts = spark.createDataFrame([("x", chr(300 + k), 1) for k in range(40)], "lang string, symbol string, n long")
    assert coding.quantized_cdf(counts, 8).agg(F.sum("count")).first()[0] == 256
    with pytest.raises(Exception, match="too many symbols"):
        coding.quantized_cdf(counts, 5).collect()


def test_syllables_and_reports(docs, empty):
    assert segment.akshara_vocabulary(segment.segments(empty, F.col("text"))).count() == 0
    words = segment.word_frequencies(docs, F.col("text"))
    assert segment.novel_pieces(words.select(F.col("word").alias("piece")), words.where("false").select(F.col("word").alias("piece"))).count() > 0
    sizes = docs.sparkSession.createDataFrame([(None, "gzip", 0, 0, 20), ("x", "gzip", 10, 5, 8), ("x", "zstd", 10, 5, 8)], "lang string, codec string, original_bytes long, original_chars long, compressed_bytes long")
    m = report.with_metrics(sizes)
    assert {r["lang"]: r["best_codec"] for r in report.best_codec(m).collect()} == {"x": "gzip"}  # a tie goes to the first
    assert {r["lang"]: r["gzip"] for r in report.master_table(m, ["gzip", "lzma"]).collect()} == {None: "N/A", "x": "12.8000"}
    both = report.preferred(m.where("lang = 'x'"), m).collect()
    assert sorted((str(r["lang"]), r["origin"]) for r in both) == [("None", 2), ("x", 1), ("x", 1)]


def test_tokenizers(spark, tmp_path):
    """Trained models against the library used directly, round trips, errors as records."""
    import sentencepiece

    r = random.Random(7)
    stock = ["क्षेत्र", "ज्ञान", "महाभारत", "प्रतिदिन", "सुख", "ab", "१२"]
    docs = spark.createDataFrame([(i, ["hi", "mr", None][i % 3], " ".join(r.choices(stock, k=12))) for i in range(90)] + [(99, "hi", None), (98, "hi", "")], "doc_id long, lang string, text string")
    sentences = docs.where("text is not null").select("lang", F.col("text").alias("sentence"))
    training = tokenizers.Training(vocab_size=10_000)
    words = tokenizers.word_counts(docs, F.col("text"))
    models = tokenizers.train(words, "sp_bpe", training)
    assert models.where("model is not null").count() == 3
    hi = models.where("lang = 'hi'").first()["model"]
    sp = sentencepiece.SentencePieceProcessor(model_proto=hi)
    for x in tokenizers.encoded(sentences, "sentence", models).where("lang = 'hi'").collect():
        assert x["pieces"] == sp.encode(x["text"], out_type=str) and x["roundtrip_ok"]
    mapping = tokenizers.corpus_mapping(docs, F.col("text"))
    ours = tokenizers.train_akshara(words, mapping, training)
    coded = tokenizers.encoded(sentences, "sentence", ours, mapping).collect()
    assert len(coded) == 91 and all(x["roundtrip_ok"] for x in coded)
    assert not any(p.lstrip("▁")[:1] in set("ािीुूेैोौ") and p.lstrip("▁") for x in coded for p in x["pieces"])  # no syllable is split
    assert {p for x in coded for p in x["pieces"]} >= {"▁महाभारत", "▁सुख"}
    model = tokenizers.Subword(ours.where("lang = 'hi'").first()["model"], segment._table(mapping, "lang")["hi"])
    assert "क्षेत्र" in {p.strip() for p in model.vocabulary()} and tokenizers.piece_text("▁a") == " a"
    mapped = segment.remap(spark.createDataFrame([(1, "hi", ["म", "हा", "▁", "सु"])], "doc_id long, lang string, segments array<string>"), mapping).first()["remapped"]
    assert model.decode(model.encode(mapped)) == "महा सु"
    swept = tokenizers.sweep(docs, sentences, {"gone": str(tmp_path / "gone.json")}, training).collect()
    assert len(swept) == 10 and [x["hint"] for x in swept if x["error"]] == ["no such repository"]
    better = {x["lang"]: x for x in tokenizers.compared(spark.createDataFrame(swept)).collect()}
    assert set(better) == {"hi", "mr"}
    novel = tokenizers.novel_merges(tokenizers.vocabulary_pieces(ours, mapping), list).collect()
    assert [x["aksharas"] for x in novel] == sorted((x["aksharas"] for x in novel), reverse=True) and "महाभारत" in {x["piece"] for x in novel}
    tokenizers.corpus_mapping(docs.where("lang is not null"), F.col("text")).write.json(str(tmp_path / "map"))
    assert segment.load_map(spark, str(tmp_path / "map")).count() > 5
    assert tokenizers.train(words.where("false"), "x", training).count() == 0
    assert {x["tokenizer"] for x in tokenizers.sandhi_ablation(docs, sentences, training).collect()} == {"akshara_bpe", "akshara_bpe_sandhi"}


def test_streams(spark, tmp_path):
    from millrace.streaming import curation

    rows_ = [(1, "a line that is long enough", "2024-01-01 00:00:00"), (2, "a line that is long enough", "2024-01-01 00:10:00"), (3, "another line that is kept", "2024-01-01 00:20:00")]
    table = spark.createDataFrame(rows_, "doc_id long, cleaned string, arrived string").select("doc_id", F.lit("en").alias("lang"), "cleaned", F.col("arrived").cast("timestamp").alias("arrived"))
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    curation.run_available(curation.distinct_stream(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(x["cleaned"] for x in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a line that is long enough", "another line that is kept"]
    q = curation.volume(stream, "arrived", "cleaned").writeStream.format("memory").queryName("volumes").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(x["texts"], x["chars"]) for x in spark.table("volumes").collect()] == [(3, 77)]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_every_query_takes_an_empty_table(spark, tables, tmp_path_factory, name):
    folder = tmp_path_factory.getbasetemp() / "empty"
    if not folder.exists():
        for t in ("documents", "pages", "embeddings"):
            spark.read.parquet(f"{tables}/{t}.parquet").where("false").write.parquet(str(folder / f"{t}.parquet"))
    assert queries.QUERIES[name](spark, str(folder)).count() <= 1


@pytest.mark.parametrize("name", ["clean_lines", "exact_dedup_lines", "paragraph_islands", "quota_merge", "train_test_split", "char_prefix", "codec_round_trips", "akshara_segments", "near_dedup_lsh", "language_codec_inputs", "script_purity", "sample_sentences"])
def test_queries_take_awkward_documents(spark, tmp_path_factory, docs, name):
    folder = tmp_path_factory.getbasetemp() / "awkward"
    if not folder.exists():
        docs.withColumn("n_chars", F.length("text").cast("long")).write.parquet(str(folder / "documents.parquet"))
    got = queries.QUERIES[name](spark, str(folder)).collect()
    assert got
    if name == "clean_lines":
        assert all(len(x["cleaned"]) >= LATIN.min_line for x in got)
    if name in ("train_test_split", "akshara_segments"):
        assert len(got) == len(rows())


def test_arrays_equal_columns(spark):
    r = random.Random(11)
    texts = ["".join(r.choices("क़षजञ्ािोंःअएगदवे़ ▁#aé😀\n", k=r.randrange(0, 60))) for _ in range(300)] + [None, "", "क", "़", "्"]
    rows = spark.createDataFrame([(i, [None, "x", "y"][i % 3], t) for i, t in enumerate(texts)], "doc_id long, lang string, text string").repartition(3)
    text = F.col("text")
    vowels = [(f"([{config.SANDHI_CONSONANTS}])({s})", f"$1अ $2{v}") for s, v in config.VOWEL_SANDHI.items()]
    plain = T.replace_all(text, *vowels, (f"ो([{config.VISARGA_VOICED}])", "ः $1"))
    assert rows.where(~T.undo_sandhi(text).eqNullSafe(plain)).count() == 0
    assert rows.where(~T.translate(text, "a#", "खb").eqNullSafe(F.translate(text, "a#", "खb"))).count() == 0
    segmented = segment.segments(rows, text)
    both = [sorted(map(str, x.select("lang", "akshara", "n").collect())) for x in (segment.akshara_vocabulary(segmented), segment.vocabulary_of(rows, text))]
    assert both[0] == both[1]
    mapping = segment.held(segment.pua_map(segment.vocabulary_of(rows.where("doc_id % 2 = 0"), text)))
    both = [sorted(map(str, x.select("doc_id", "lang", "remapped").collect())) for x in (segment.remap(segmented, mapping), segment.remap_text(rows, text, mapping))]
    assert both[0] == both[1]
    lines = rows.where("text is not null")
    got = {(x["lang"], x["tokenizer"]): x for x in metrics.syllable_metrics(lines, "text").collect()}
    for name, pieces in (("characters", F.filter(F.split("text", ""), lambda c: c != "")), ("aksharas", T.aksharas(text))):
        for x in metrics.tokenizer_metrics(lines, pieces, text).collect():
            assert x.asDict() | {"tokenizer": name} == got[x["lang"], name].asDict()


def test_syllables_are_counted_in_arrays(spark):
    """Plans keep no row for each syllable."""
    docs = spark.createDataFrame([(1, "x", "कखग")], "doc_id long, lang string, text string")
    plan = segment.vocabulary_of(docs, F.col("text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_slices_of_arrays(monkeypatch):
    monkeypatch.setattr(arrays, "SLICE", 10)
    texts = pa.array(["aaaa", None, "bbbbbbbbbbbbbbbbbbbb", "", "cc", "कख"])
    assert list(arrays.slices(texts, 10)) == [(0, 2), (2, 3), (3, 6)] and list(arrays.slices(pa.array([], pa.string()))) == []
    assert arrays.in_slices(lambda x: x, texts).to_pylist() == texts.to_pylist() and arrays.undo_sandhi(texts.slice(3)).to_pylist() == ["", "cc", "कख"]


def test_words_and_tokens_are_counted_in_arrays(spark):
    r = random.Random(12)
    texts = [" ".join("".join(r.choices("कखगिाो्ab1", k=r.randrange(1, 9))) for _ in range(r.randrange(0, 30))) for _ in range(200)] + [None, "", " \t\n", "\u3000क\u00a0\x85ख\u200bग😀 "]
    rows = spark.createDataFrame([(i, [None, "x", "y"][i % 3], t) for i, t in enumerate(texts)], "doc_id long, lang string, text string").repartition(3)
    text = F.col("text")
    plain = rows.select("lang", F.explode(T.words(text)).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    words = segment.word_frequencies(rows, text)
    assert sorted(map(str, words.collect())) == sorted(map(str, plain.select(*words.columns).collect()))
    training = tokenizers.Training(vocab_size=320)
    mapping = segment.held(tokenizers.corpus_mapping(rows, text))
    for models, how in ((tokenizers.train(words, "t", training), None), (tokenizers.train_akshara(words.where("lang = 'x'"), mapping, training), mapping)):
        coded = tokenizers.encoded(rows, "text", models, how).persist()
        got = tokenizers.coded_metrics(rows, "text", models, how)
        want = tokenizers.measured(coded)
        assert got.count() in (1, 3) and sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
        want = coded.groupBy("lang").agg(F.count("*").alias("sentences"), F.count_if("roundtrip_ok").alias("round_trips"))
        assert sorted(map(str, tokenizers.round_trips(rows, "text", models, how).collect())) == sorted(map(str, want.collect()))


def test_unigram_trainers_take_turns(tmp_path):
    def work(k):
        with tokenizers.one_at_a_time():
            began = time.time()
            time.sleep(0.3)
            (tmp_path / str(k)).write_text(f"{began} {time.time()}")

    context = multiprocessing.get_context("fork")
    all_ = [context.Process(target=work, args=(k,)) for k in range(3)]
    for p in all_:
        p.start()
    for p in all_:
        p.join(30)
    times = sorted(tuple(map(float, f.read_text().split())) for f in tmp_path.iterdir())
    assert len(times) == 3 and all(a[1] <= b[0] for a, b in zip(times, times[1:]))


def test_signatures_and_bands_in_arrays(spark, monkeypatch):
    r = random.Random(13)
    base = ["".join(r.choices("abcdé 😀", k=r.randrange(3, 90))) for _ in range(40)]
    texts = [t[: r.randrange(1, 99)] + r.choice(["", "x", "yz"]) for t in base for _ in range(12)]
    rows = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    spec = NearDedup(min_chars=2, max_chars=60)
    plain = rows.where("doc_id is not null and length(text) >= 2").select("doc_id", T.minhash_signature(F.col("text"), spec).alias("signature"))
    signed = curate.signatures(rows, spec=spec).persist()
    assert sorted(map(str, signed.where("doc_id is not null").collect())) == sorted(map(str, plain.collect()))
    found = lambda: sorted(map(str, curate.beaten_classes(signed, spec=spec).collect()))
    once = found()
    monkeypatch.setattr(curate, "FEW", 0)
    assert once == found() and len(once) > 5


def test_lines_are_cleaned_once_and_stripped_alike(spark, docs):
    plan = curate.clean_stats(docs.select("doc_id", "lang", "source", "text"), LATIN)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 1
    r = random.Random(14)
    lines = ["".join(r.choices(" \t 　ab@.&;!?:éक", k=r.randrange(0, 14))) for _ in range(400)] + ["see http://x.y/z now", "a@b.c &amp; &#12; x", "", None]
    rows = spark.createDataFrame([(t,) for t in lines], "t string")
    white = config.WHITE
    strip = lambda c: F.regexp_replace(c, F.lit(f"^[{white}]+|[{white}]+$"), F.lit(""))
    c = T.replace_all(F.col("t"), (r"https?://[^" + white + "]+", ""))
    kept = F.array_join(F.transform(F.split(c, " "), lambda w: F.when(F.contains(w, F.lit("@")) & F.contains(w, F.lit(".")), "").otherwise(w)), " ")
    c = F.when(F.contains(c, F.lit("@")), kept).otherwise(c)
    plain = strip(T.replace_all(c, (r"&[a-zA-Z]+;", " "), (r"&#\p{Nd}+;", " "), (r"[।,.!?;:]{3,}", "।"), (r"[ \t]+", " ")))
    assert rows.where(~T.strip_boilerplate(F.col("t")).eqNullSafe(plain)).count() == 0
    assert rows.where(~T.strip(F.col("t")).eqNullSafe(strip(F.col("t")))).count() == 0
