"""Each operator against a brute-force version, on awkward rows and on small tables."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import classifier, components, decontam, lm_scoring, minhash, quality_rules, queries, sentencepiece_codec, sharding, suffix_dedup, token_counts, url_filter
from millrace.llm.textbatch import Texts

from . import data


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(data.documents(), data.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], data.SCHEMA)


def texts_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_quality_rules(docs, empty):
    got = collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality_rules.quality_rules(docs).collect())
    want = collections.Counter()
    for i, t in texts_of(docs):
        q = data.quality(t)
        want[(i, *q, q[0] < 10 or 100 * q[4] > 20 * q[0])] += 1
    assert got == want
    assert quality_rules.quality_rules(empty).count() == 0
    assert quality_rules.kept_documents(docs).columns == docs.columns
    assert all(r["kept"] is False for r in quality_rules.quality_rules(docs).collect() if r["base_failed"])


@pytest.mark.parametrize("blocks", [4096, 2])
def test_every_label_has_a_reference(spark, blocks):
    """References in the table and in memory give the same distances, also for documents without a usable label."""
    rows = [(k, data.prose(k, 150) + f" {k % 7}" * (k % 7), f"l{k % 7}" if k % 5 else (None, "")[k % 2]) for k in range(70)] + [(70, None, "l9"), (71, data.prose(71, 90), "l8"), (None, "a b", "l8")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    want = quality_rules.quality_rules(docs).collect()
    for most in (1, 3, 0):
        limits = quality_rules.Limits(max_references=most, block_references=blocks)
        got = quality_rules.quality_rules(docs, limits).collect()
        order = lambda x: (x["doc_id"] is None, x["doc_id"])
        assert sorted(got, key=order) == sorted(want, key=order)
        assert sorted(quality_rules.kept_documents(docs, limits).collect()) == sorted(quality_rules.kept_documents(docs).collect())
    assert len({x["class_distance"] for x in want}) > 60


def test_js_distance():
    p = np.array([[0.5, 0.5, 0.0], [1.0, 0.0, 0.0]])
    assert quality_rules.js_distance(p, np.array([0.5, 0.5, 0.0])).tolist()[0] == 0
    assert quality_rules.js_distance(np.array([[1.0, 0.0]]), np.array([0.0, 1.0]))[0] == pytest.approx(1)


@pytest.mark.parametrize("most", [1000, 1])
def test_suffix_dedup(docs, empty, most):
    rule = suffix_dedup.Repeats(length=400, tree_contexts=most)
    rows = texts_of(docs)
    want = collections.Counter((i, *r) for (i, _), r in zip(rows, data.removed([t for _, t in rows], 400)))
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.removed_bytes(docs, rule).collect())
    assert got == want
    assert suffix_dedup.removed_bytes(empty, rule).count() == 0


def test_suffix_dedup_cuts_whole_characters(spark):
    shared = "é" * 250
    docs = spark.createDataFrame([(1, "a" + shared + "b", 1), (2, "c" + shared + "d", 2), (3, None, 3)], "doc_id long, text string, kept_row long")
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(docs, suffix_dedup.Repeats(length=400, anchor=128)).collect()}
    assert got == {1: "ab", 2: "cd", 3: None}


@pytest.mark.parametrize("most", [1000, 4, 1])
def test_suffix_dedup_of_words(spark, most):
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randrange(1, 4)))
    passages = [[word() for _ in range(n)] for n in (51, 52, 60, 120, 50)]
    rows = []
    for k in range(40):
        w = [word() for _ in range(60)]
        w[30:30] = passages[k % 5][: 51 if k in (8, 13) else None]
        rows.append(("\n " if k % 3 else " ").join(w))
    rows += [None, "", "one", rows[0], " ".join(passages[0])]
    windows = collections.Counter(tuple(w[i : i + 51]) for w in ((t or "").split() for t in rows) for i in range(len(w) - 50))
    want = []
    for t in rows:
        w = (t or "").split()
        gone = {i + x for i in range(len(w) - 50) if windows[tuple(w[i : i + 51])] > 1 for x in range(51)}
        want.append([x for i, x in enumerate(w) if i not in gone])
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    rule = suffix_dedup.Repeats(length=51, anchor=12, tree_contexts=most, words=True)
    got = {x["doc_id"]: x["text"] for x in suffix_dedup.without_repeats(table, rule).collect()}
    assert [(got[i] or "").split() for i in range(len(rows))] == want and got[40] is None
    assert sum(len(w) for w in want) < sum(len((t or "").split()) for t in rows)


@pytest.mark.parametrize("most", [5000, 40, 2])
def test_suffix_dedup_of_a_hot_anchor(spark, most):
    """One passage in 3,000 texts whose surroundings all differ, or agree for some bytes: one tree, subtrees and their levels."""
    r = random.Random(31)
    passage = "".join(r.choice("abcdefgh ") for _ in range(90))
    near = ["".join(r.choice("xyz") for _ in range(30)) for _ in range(12)]
    some = lambda: "".join(r.choice("klmn") for _ in range(r.randrange(20, 60)))
    rows = []
    for k in range(3000):
        cut = r.randrange(0, 31)
        rows.append(some() + near[r.randrange(12)][cut:] + passage + near[r.randrange(12)][: r.randrange(0, 31)] + some())
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    rule = suffix_dedup.Repeats(length=80, anchor=32, tree_contexts=most)
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup.removed_bytes(table, rule).collect()}
    assert [got[i] for i in range(len(rows))] == data.removed(rows, 80)


@pytest.mark.parametrize("words", [False, True])
def test_long_texts_are_looked_at_in_pieces(monkeypatch, words):
    r = random.Random(5)
    column = pa.array([" ".join(r.choice(["ab", "c", "def", "gh"]) for _ in range(n)) for n in (4000, 3, 900, 0, 7000)])
    rule = suffix_dedup.Repeats(length=40, anchor=10, words=words)
    want = suffix_dedup.find_anchors(Texts(column), rule)
    for size in (1 << 7, 1000, 5000):
        monkeypatch.setattr(suffix_dedup, "PIECE", size)
        got = suffix_dedup.find_anchors(Texts(column), rule)
        assert all((got[k] == want[k]).all() for k in want) and len(want["place"]) > 100


def test_repeats_join_gives_one_row_an_occurrence(spark):
    passage = data.prose(70, 100)
    rows = [(i, data.prose(i, 40) + " " + passage + " " + data.prose(900 + i % 7, 60)) for i in range(60)]
    table = suffix_dedup._identified(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    for most in (1000, 5, 1):
        rule = suffix_dedup.Repeats(length=200, anchor=64, tree_contexts=most)
        found = suffix_dedup.repeated_ranges(table, rule)
        assert found.count() <= suffix_dedup.anchors(table, rule).count()
        assert found.select("doc_id", "begin", "end").distinct().count() == found.count()


def test_maximal_repeats_lists_all_occurrences():
    before, after = [b"xxab", b"yyab", b"zzab", b"zzzz"], [b"cdef1", b"cdef2", b"cdef3", b"cdef4"]
    groups = list(suffix_dedup.maximal_repeats(np.zeros(4, int), before, after, 6))
    assert any(sorted(m.tolist()) == [0, 1, 2] and e == 4 for m, _, e in groups)
    assert not any(3 in m for m, _, _ in groups)


def test_sharding(docs, empty):
    rows = sharding.byte_shards(sharding.sized(docs), 4).collect()
    want = collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts_of(docs))
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert {r["law"] for r in rows} == {"bytes"} and all(0 <= r["shard"] < 4 for r in rows)
    assert sharding.byte_shards(sharding.sized(empty), 4).count() == 0


def test_shards_are_near_equal(spark):
    r = random.Random(4)
    rows = spark.createDataFrame([(i, "x" * r.randrange(1, 300)) for i in range(2000)], "doc_id long, text string")
    size = collections.Counter()
    for x in sharding.byte_shards(sharding.sized(rows), 10).collect():
        size[x["shard"]] += x["size"]
    assert max(size.values()) - min(size.values()) <= 2 * 316


def test_classifier(spark, docs, empty):
    r = random.Random(3)
    good = [(i, data.prose(i, 60), "en") for i in range(300)]
    bad = [(i, " ".join(f"{w}###" for w in data.prose(i, 60).split()), "en") for i in range(300, 400)]
    rows = good + bad
    r.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(400)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = classifier.score_quality(table, labels).collect()
    held = [x for x in got if x["held_out"]]
    assert len(got) == 400 and all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in got)
    assert np.mean([x["predicted"] == int(x["doc_id"] < 300) for x in held]) > 0.95
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in got)
    assert classifier.score_quality(docs, labels).count() == docs.count()
    assert {round(x["score"], 3) for x in classifier.score_quality(docs, labels.where("false")).collect()} == {0.5}
    assert classifier.score_quality(empty, labels).count() == 0


def test_classifier_scores_are_the_network(spark):
    """The sum of feature scores is the softmax layer over the average of the features' vectors."""
    s = classifier.Settings(bucket_bits=10)
    t = Texts(pa.array(["one two über one", "", "x"]))
    t.words()
    random_ = np.random.default_rng(1)
    vectors, layer = random_.random((1 << 10, 4)), random_.random((2, 4))
    f = classifier.Features(t, s)
    want = [layer @ (share @ vectors[ids]) for ids, share in f.bags()]
    assert np.allclose(f.scores(vectors @ layer.T), want)


def test_classifier_features_and_steps():
    """Features against whole numbers, and a step against the gradient of the loss by differences."""
    s = classifier.Settings(bucket_bits=12)
    texts = [t if t is None or len(t) < 4000 else t[:4000] for _, t, *_ in data.documents()]
    t = Texts(pa.array(texts))
    t.words()
    f = classifier.Features(t, s)
    want = [data.features(x, 12) for x in texts]
    bags = list(f.bags())
    for (ids, share), w in zip(bags, want):
        assert ids.tolist() == sorted(w) and np.allclose(share, [w[i] / w.total() for i in sorted(w)])
    table = np.random.default_rng(2).random((1 << 12, 2))
    assert np.allclose(f.scores(table), [sum(n * table[i] for i, n in w.items()) / w.total() for w in want])

    labels = np.arange(len(bags)) % 2
    random_ = np.random.default_rng(3)
    vectors, layer = random_.random((1 << 12, 3)), random_.random((2, 3))

    def loss(v, q):
        z = [q @ (share @ v[ids]) for ids, share in bags]
        return sum(np.log(np.exp(x).sum()) - x[k] for x, k in zip(z, labels))

    v, q = vectors.copy(), layer.copy()
    batch = classifier._Batch(bags, labels)
    batch.scale = np.ones_like(batch.scale)  # plain gradient
    assert batch.loss(vectors, layer) == pytest.approx(loss(vectors, layer), rel=1e-5)
    batch.step(v, q, 1.0)
    for at in [(0, 0), (0, 2), (int(bags[4][0][1]), 1), (int(bags[7][0][5]), 0)]:
        up, down = vectors.copy(), vectors.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        assert vectors[at] - v[at] == pytest.approx((loss(up, layer) - loss(down, layer)) / 2e-5, abs=1e-4)
    up, down = layer.copy(), layer.copy()
    up[1, 2] += 1e-5
    down[1, 2] -= 1e-5
    assert layer[1, 2] - q[1, 2] == pytest.approx((loss(vectors, up) - loss(vectors, down)) / 2e-5, abs=1e-4)


def test_classifier_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, data.prose(1, 50))] * 300 + [(1, "other text")] + [(i, data.prose(i, 40)) for i in range(2, 60)] + [(60, None)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 61)] + [(1, 0)], "doc_id long, quality int")
    s = classifier.Settings()
    bags, y = classifier.labelled_sample(docs, labels, s, "doc_id", "text", "quality")
    assert len(bags) == 60 and y.sum() == 30
    few = classifier.labelled_sample(docs, labels, classifier.Settings(max_features=5000), "doc_id", "text", "quality")[0]
    assert 0 < len(few) < 60 and sum(len(ids) for ids, _ in few) <= 5000
    assert len(classifier.labelled_sample(docs, labels, classifier.Settings(max_rows=7), "doc_id", "text", "quality")[0]) == 7


RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def test_url_filter(spark):
    cases = {
        "http://a.example.net/en/1": ("example.net/en/", "allow"), "https://NET/": ("net/", "block"), "http://x.net": (None, "allow"), "http://example.com/de/1?q": ("example.com/de/", "block"),
        "http://adult.example.com/en/": (None, "block"), "http://sadults.example.com/en/": (None, "allow"), "http://ads-track.example.com/x": (None, "block"), "http://ads-ads.example.com/x": (None, "allow"),
        "http://free.example.com/hot": (None, "allow"), "http://free.example.com/hot/sale": (None, "block"), "http://free.example.com/spam": (None, "block"), "http://spam.example.com/": (None, "allow"),
        "http://a.org/fr/x#porn": ("org/fr/", "allow"), None: (None, "allow"), "": (None, "allow"), "nothing": (None, "allow"), "http://XXX.org/x": (None, "block"),
    }
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)] + [(None, None, None)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, RULES).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert url_filter.filter_urls(pages.where("false"), RULES).count() == 0
    one = spark.createDataFrame([("http://WWW.É.com:80/a/B?c",)], "u string").select(*url_filter.host_and_path(F.col("u"))).first()
    assert tuple(one) == ("www.É.com:80", "/a/B")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*url_filter.SOFT_TERMS, "casino", "porn", "x", "1", "/", "-", ".", "É"]), max_size=7))
def test_vocabulary_hits(parts):
    """Against a search for each term by itself."""
    text = "".join(parts)
    alone = lambda t: len(re.findall(rf"(?<![a-z0-9])(?={re.escape(t)}(?![a-z0-9]))", text))
    auto = url_filter.automaton(url_filter.STRICT_TERMS, tuple(url_filter.SOFT_TERMS.items()))
    hard, light = url_filter.vocabulary_hits(text, auto)
    assert hard == sum(map(alone, url_filter.STRICT_TERMS)) and light == {t: w for t, w in url_filter.SOFT_TERMS.items() if alone(t)}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, tables, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"create view {t} as select * from '{tables}/{t}.parquet'")
    cur = c.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    rows = sorted(map(str, cur.fetchall()))
    got = queries.QUERIES[name](spark, tables)
    assert sorted(got.columns) == sorted(names)
    assert sorted(str(tuple(r)) for r in got.select(*names).collect()) == rows


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece_codec.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))


def test_codec_equals_the_library(docs, pieces):
    import sentencepiece

    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for i, p in enumerate(model.pieces):
        p.score = float(pieces.score[i])
    lib = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    score = lambda ids: sum(float(pieces.score[i]) for i in ids)
    for r in docs.select("doc_id", "text").join(sentencepiece_codec.encode_decode(docs, pieces), "doc_id").where("text is not null and length(text) < 5000").collect():
        if r["doc_id"] != 3:  # an id with two texts
            want = lib.encode(r["text"])
            assert r["ids"] == want or score(r["ids"]) == pytest.approx(score(want), abs=1e-3)


def test_codec_round_trip(docs, empty, pieces):
    got = sentencepiece_codec.encode_decode(docs, pieces).collect()
    want = collections.Counter((i, (t or "").replace("▁", " ")) for i, t in texts_of(docs))
    assert collections.Counter((r["doc_id"], r["decoded"]) for r in got) == want
    assert [r["doc_id"] for r in got if not r["round_trip"]] == [15]
    assert sentencepiece_codec.encode_decode(empty, pieces).count() == 0


def test_viterbi_is_best():
    """Against all segmentations of short texts."""
    text = ["<unk>", "a", "b", "ab", "ba", "aba", "▁", "▁a", "▁ab", "c"] + [f"<0x{b:02X}>" for b in range(256)]
    r = np.random.default_rng(2)
    p = sentencepiece_codec.Pieces(text, -r.random(len(text)) * 5, np.array([1] + [0] * 9 + [3] * 256))
    codec = sentencepiece_codec.Codec(p)

    def best(s: str) -> float:
        if not s:
            return 0.0
        options = [p.score[i] + best(s[len(t) :]) for i, t in enumerate(text[:10]) if i and s.startswith(t)]
        if s[0] not in text[:10]:
            options.append(codec.unknown_score + best(s[1:]))
        return max(options)

    for s in ("abab", "ba ab", "  a", "abcé", "é", "aba aba ba"):
        ids, _ = codec.encode(pa.array([s]))
        runs = sum(1 for i in ids if not codec.is_byte[i])
        value = sum(p.score[i] for i in ids if not codec.is_byte[i]) + codec.unknown_score * s.count("é")
        assert runs and value == pytest.approx(best("▁" + s.replace(" ", "▁")))
        assert codec.decode(ids, np.array([0, len(ids)])) == [s]
    long = "ab" * 200
    assert codec.decode(codec.encode(pa.array([long]))[0], np.array([0, len(codec.encode(pa.array([long]))[0])])) == [long]


def test_double_array():
    keys = [b"a", b"ab", b"abc", b"b", b"\xe0\xa4\x95", b"\x00"]
    trie = sentencepiece_codec.DoubleArray(keys, list(range(len(keys))))
    assert [trie.find(k) for k in keys] == list(range(len(keys)))
    assert trie.find(b"abcd") == trie.find(b"c") == trie.find(b"\xe0") == -1


@pytest.mark.parametrize("rule", [minhash.Rule(percent=85, rows=5), minhash.Rule(percent=85, rows=5, block=2)])
def test_near_duplicates(docs, empty, rule):
    rows = texts_of(docs)
    sets = [data.shingles(t) for _, t in rows]
    root = data.components(sets, 85)
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, rule).collect())
    want = collections.Counter()
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[k] and rows[j][0] is not None]
        c = min(ids, default=None) if sets[k] else i
        want[(i, len(sets[k]), c, c == i)] += 1
    assert got == want
    assert minhash.near_duplicates(empty, rule).count() == 0


def test_near_duplicates_of_prose(spark):
    r = random.Random(9)
    rows = []
    for g in range(12):
        base = data.prose(g, 150).split()
        for _ in range(8):
            w = list(base)
            for _ in range(r.randrange(0, 6)):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            rows.append(" ".join(w))
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = data.components([data.shingles(t) for t in rows], 85)
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(table, minhash.Rule(block=3)).collect()}
    assert [got[i] for i in range(len(rows))] == want
    left = minhash.without_near_duplicates(table, minhash.Rule(percent=85)).collect()
    assert sorted(x["doc_id"] for x in left) == sorted(set(want))


@pytest.mark.parametrize("rate", [5, 60])
def test_near_duplicates_of_a_dense_group(spark, rate):
    """2,000 different texts that are all near, and 400 of which many are apart from any leader; without ids as well."""
    r = random.Random(rate)
    base = data.prose(77, 220).split()
    rows = []
    for _ in range(2000 if rate == 5 else 250):
        w = list(base)
        for _ in range(r.randrange(0, rate // 5 + 1)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        rows.append(" ".join(w))
    table = spark.createDataFrame([(i if i % 3 else None, t, i) for i, t in enumerate(rows)], "doc_id long, text string, n long").repartition(5)
    sets = [data.shingles(t) for t in rows]
    if rate == 5:
        whole = data.shingles(" ".join(base))
        assert all(100 * len(s & whole) >= 85 * len(s | whole) for s in sets)
        want = [0] * len(rows) if " ".join(base) in rows else data.components(sets, 85)
    else:
        want = data.components(sets, 85)
        assert len(set(want)) > 20
    got = minhash.near_duplicates(table.withColumn("doc_id", table["n"]), minhash.Rule(block=64)).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == {i: c for i, c in enumerate(want)}
    left = minhash.without_near_duplicates(table, minhash.Rule(percent=85, block=64)).collect()
    groups = collections.Counter(want[x["n"]] for x in left)
    assert set(groups) == set(want) and set(groups.values()) == {1}


def test_repeated_rows_without_ids_do_not_multiply(spark):
    near = [" ".join([*data.prose(5, 60).split(), f"end{k}"]) for k in range(6)]
    table = spark.createDataFrame([(None, t) for t in near for _ in range(200)] + [(None, data.prose(6, 60))], "doc_id long, text string")
    got = minhash.near_duplicates(table).collect()
    assert len(got) == 1201 and all(x["component_id"] is None for x in got)
    assert minhash.without_near_duplicates(table).count() == 2


def test_one_of_near_duplicates_stays_whatever_their_ids(spark):
    def near(k):
        w = data.prose(k, 150).split()
        return [" ".join(w[:40] + [f"new{i}"] + w[41:]) for i in range(4)]

    groups = {500: [7] * 4, 501: [None] * 4, 502: [7, 8, None, 7], 503: [9, None, None, 8], 504: [None] * 4}
    rows = [(i, t, g) for g, ids in groups.items() for i, t in zip(ids, near(g))] + [(None, data.prose(600, 80), 600), (7, data.prose(601, 80), 601), (None, None, 602), (7, " ", 603)]
    table = spark.createDataFrame(rows, "doc_id long, text string, g long").repartition(3)
    left = minhash.without_near_duplicates(table, minhash.Rule(percent=80, rows=4)).collect()
    assert sorted((x["g"], x["doc_id"]) for x in left if x["g"] not in (501, 504, 600, 602)) == [(500, 7), (502, 7), (503, 8), (601, 7), (603, 7)]
    assert sorted(x["g"] for x in left if x["doc_id"] is None) == [501, 504, 600, 602]


def test_estimate_is_close():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 1 << 63, 1000).astype(np.uint64), r.integers(0, 1 << 63, 250).astype(np.uint64)
    both = minhash.hyper_registers(np.concatenate([a, a[:750], b]), np.repeat([0, 1], 1000), 2, 960)
    n = np.array([1000])
    assert minhash.estimate(both[:1], both[1:], n, n)[0] == pytest.approx(0.6, abs=0.08)


@pytest.mark.parametrize("few", [1 << 14, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_EDGES", few)
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, r.randrange(101, 200)) for _ in range(90)] + [(7, 7), (300, 301), (301, 300)]
    got = {x["node"]: x["component"] for x in components.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    assert {got[i] for i in range(61)} == {0} and got[301] == 300 and all(got[v] == 100 for u, v in edges if u == 100)
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_estimates_of_size_do_not_grow_with_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "FEW_EDGES", 0)
    monkeypatch.setattr(components, "CONTRACT_ROWS", 1)
    seen, plain = [], components.checkpoint

    def noted(df):
        seen.append(plain(df))
        return seen[-1]

    monkeypatch.setattr(components, "checkpoint", noted)
    path = [(i * 37 % 101, (i + 1) * 37 % 101) for i in range(100)]
    got = components.connected_components(spark.createDataFrame(path, "u long, v long").repartition(20)).collect()
    assert sorted((x["node"], x["component"]) for x in got) == [(i, 0) for i in range(101)]
    assert len(seen) > 9 and all(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 64 for df in seen)


def test_decontamination(spark, docs, empty):
    items = [(i, data.prose(900 + i, 30)) for i in range(6)] + [(6, "tiny exact item phrase"), (7, None), (None, "x y z w v"), (8, "a b")]
    bench = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, doc_id string")
    rows, want = [], set()
    for k in range(40):
        w, item = data.prose(k, 80).split(), k % 6
        p = items[item][1].split()
        if k % 4 == 0:
            want.add((k, item))
        elif k % 4 == 1:  # every ninth word replaced
            p = ["zzz" if i % 9 == 4 else x for i, x in enumerate(p)]
            want.add((k, item))
        elif k % 4 == 2:  # half of the words replaced
            p = ["zzz" if i % 2 else x for i, x in enumerate(p)]
        else:
            p = []
        rows.append((k, " ".join(w[:40] + p + w[40:]), "x"))
    rows.append((50, "before tiny exact item phrase, after", "x"))
    want.add((50, 6))
    table = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    found = decontam.contaminated(table, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    assert {r["doc_id"] for r in decontam.decontaminate(table, bench).collect()} == {r[0] for r in rows} - {d for d, _ in want}
    blocks = decontam.contaminated(table, bench.unionByName(bench), decontam.Overlap(block_tokens=40)).collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, found))
    passage = f"{data.prose(1, 30)} {items[2][1]} {data.prose(2, 30)}"
    awkward = docs.unionByName(docs.sparkSession.createDataFrame([(i, passage) for i in (None, None, 3, 3)], "doc_id long, text string"), allowMissingColumns=True)
    assert collections.Counter((r["doc_id"], r["item_id"]) for r in decontam.contaminated(awkward, bench).collect()) == {(None, 2): 2, (3, 2): 2}
    assert decontam.decontaminate(awkward, bench).count() == docs.count() and decontam.contaminated(empty, bench).count() == 0
    assert decontam.decontaminate(docs, bench.where("false")).count() == docs.count()


def test_stretch_is_the_best_of_all(spark):
    r = random.Random(11)
    items, rows, want = [], [], set()
    for k in range(300):
        n, rate = r.choice([15, 18, 40, 104]), r.choice([0.1, 0.15, 0.2, 0.25])
        same = [r.random() >= rate for _ in range(n)]
        fits = [(sum(same[i:j]), i - j) for i in range(n) for j in range(i + 1, n + 1) if 5 * sum(same[i:j]) >= 4 * (j - i)]
        i, j = decontam.best_stretch(np.array(same), 0.8)
        assert (sum(same[i:j]), i - j) == max(fits)
        items.append((k, " ".join(f"i{k}w{x}" for x in range(n))))
        rows.append((k, " ".join(f"i{k}w{x}" if s else f"new{x}" for x, s in enumerate(same))))
        if max(fits)[0] >= 12:
            want.add((k, k))
    # 20 words as they are, then two substituted of each seven
    items.append((300, " ".join(f"a{x}" for x in range(104))))
    rows.append((300, " ".join(f"a{x}" if x < 20 or (x - 20) % 7 > 1 else "new" for x in range(104))))
    want.add((300, 300))
    found = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]) for x in found} == want and all(x["n_same"] >= 12 and 5 * x["n_same"] >= 4 * x["n_words"] for x in found)
    assert decontam.best_stretch(np.zeros(5, bool), 0.8) == (0, 0)


@pytest.mark.parametrize("hits", [1 << 21, 3])
def test_many_hits_are_taken_in_parts(monkeypatch, hits):
    """Items and documents that share a phrase, with hits and diagonals looked at a few at a time."""
    rule = decontam.Overlap(words=6)
    phrase = "choose the right answer below now"
    index = decontam.Index([(i, f"{phrase} {data.prose(i, 12)}") for i in range(20)], rule)
    t = Texts(pa.array([f"{phrase} {phrase} {data.prose(500 + k, 20)}" for k in range(9)] + [None, "x"]), lower=True)
    t.words()
    want = decontam.overlaps(decontam.tokens_of(t), t.word_offsets, index, rule)
    monkeypatch.setattr(decontam, "HITS", hits)
    assert decontam.overlaps(decontam.tokens_of(t), t.word_offsets, index, rule) == want and len(want) == 180


def test_overlaps_are_the_best_of_all_diagonals(spark):
    """Every column against all stretches of all diagonals that have a seed, with passages moved, substituted, cut and repeated."""
    r = random.Random(19)
    word = lambda: r.choice("abcdefghij") + r.choice("aeiou") + r.choice(["", ",", "."])
    items = [[word() for _ in range(r.choice([5, 9, 14, 25, 40]))] for _ in range(14)]
    rows = []
    for k in range(70):
        doc = [word() for _ in range(r.randrange(0, 50))]
        for _ in range(r.randrange(0, 3)):
            p = [x if r.random() > 0.12 else word() for x in r.choice(items)]
            at = r.randrange(len(doc) + 1)
            doc[at:at] = p[r.randrange(0, 3) :][: r.choice([6, 13, 60])]
        rows.append(" ".join(x.upper() if r.random() < 0.2 else f"({x}" if r.random() < 0.1 else x for x in doc))
    rows += [rows[3], None, ""]
    ids = [i if i % 9 else None for i in range(len(rows))]
    short = {len(i) for i in items if 4 <= len(i) < max(map(len, decontam.MASKS))}
    want = collections.Counter()
    for i, t in zip(ids, rows):
        for k, item in enumerate(items):
            item = data.tokens(" ".join(item))
            masks = (*decontam.MASKS, *("1" * n for n in short if n == len(item)))
            got = data.overlap(data.tokens(t), item, masks, min(12, 0.8 * len(item)))
            if got:
                want[(i, k, *got, round(got[3] / got[2], 6))] += 1
    table = spark.createDataFrame(list(zip(ids, rows)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    found = decontam.contaminated(table, bench).collect()
    assert collections.Counter((x["doc_id"], x["item_id"], x["doc_word"], x["item_word"], x["n_words"], x["n_same"], round(x["share"], 6)) for x in found) == want
    assert sum(want.values()) > 20


@pytest.mark.parametrize("tokens", [1 << 20, 10])
def test_items_without_an_id(spark, tokens):
    items = [(None, data.prose(950, 30)), (None, data.prose(951, 30)), (3, data.prose(952, 30)), (None, None)]
    rows = [(k, f"before {t} after") for k, (_, t) in enumerate(items[:3])] + [(3, data.prose(953, 30))]
    table, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rule = decontam.Overlap(block_tokens=tokens)
    assert {(x["doc_id"], x["item_id"]) for x in decontam.contaminated(table, bench, rule).collect()} == {(0, None), (1, None), (2, 3)}
    assert [x["doc_id"] for x in decontam.decontaminate(table, bench, rule).collect()] == [3]


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    want = collections.Counter()
    for i, t in texts_of(docs):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 2048)] += 1
    assert collections.Counter(tuple(r) for r in token_counts.count_tokens(docs, path).collect()) == want
    assert token_counts.count_tokens(empty, path).count() == 0


def test_token_counts_of_any_letters():
    """Letters, marks and cases of all of Unicode, as the library takes them."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, ours, r = Tokenizer.from_file(path), token_counts.RankMerger(path), random.Random(8)
    stock = [chr(c) for c in [*range(0x21, 0x3000), *range(0xA000, 0xD800, 7), *range(0xE000, 0x33480, 11), 0x3EB95, 0x1DF25, 0x10D4A, 0x11F50]]
    texts = ["İ\U0003EB95", "<|endoftext|>É", "ΑΣ"] + ["".join(r.choice(stock) for _ in range(r.randrange(1, 9))) for _ in range(4000)]
    t = Texts(pa.array(texts))
    t.words()
    got = np.add.reduceat(np.r_[ours.count_words(t), 0], t.word_offsets[:-1]) * (np.diff(t.word_offsets) > 0)
    assert got.tolist() == [len(lib.encode(x, add_special_tokens=False).ids) for x in texts]


def test_lm_scores(docs, empty):
    rows = texts_of(docs)
    tokens = [data.words(data.lowered(t)) + [None] for _, t in rows]
    out = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    c = collections.Counter(w for ws, o in zip(tokens, out) if not o for w in ws)
    n, v = sum(c.values()), len(c)
    want = collections.Counter((i, o, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)) for (i, _), ws, o in zip(rows, tokens, out))
    got = lm_scoring.score_texts(docs, plan=lm_scoring.Plan(block_bytes=50_000)).collect()
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert lm_scoring.score_texts(empty).count() == 0


def test_lm_scores_are_the_mixture(spark):
    """Every score against a plain computation of counts, weights and probabilities."""
    r = random.Random(23)
    stock = [f"w{k}" for k in range(40)]
    rows = [(i if i % 50 else None, None if i == 9 else " ".join(r.choice(stock[: 1 + i % 40]) for _ in range(r.randrange(0, 60)))) for i in range(400)]
    plan = lm_scoring.Plan(block_bytes=9_000, deleted_in=6)
    want = data.interpolated(rows, 6, plan.em_rounds, lm_scoring.BUCKETS, lm_scoring._STEP)
    got = lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), plan=plan).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    ours, plain = sorted([(x["doc_id"], x["score"]) for x in got], key=key), sorted([(i, w) for (i, _), w in zip(rows, want)], key=key)
    assert [x[0] for x in ours] == [x[0] for x in plain] and np.allclose([x[1] for x in ours], [x[1] for x in plain], rtol=1e-9)


def test_lm_beats_its_base(spark):
    rows = spark.createDataFrame([(i, " ".join(f"w{(i + k) % 30} then{(i + k) % 30}" for k in range(40))) for i in range(300)], "doc_id long, text string")
    held = [r for r in lm_scoring.score_texts(rows).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.6 * sum(r["base_score"] for r in held)


def test_weights_are_learned():
    bucket = np.repeat([1, 5], 1000)
    p2, p1 = np.r_[np.zeros(1000), np.full(1000, 0.5)], np.full(2000, 0.1)
    w = lm_scoring.learn_weights(bucket, p2, p1, np.ones(2000), 0.001, 50)
    assert np.allclose(w.sum(1), 1) and w[1, 0] < 0.01 and w[5, 0] > 0.9 and w[0, 0] == 0


def test_packing():
    h = np.sort(np.random.default_rng(3).integers(1 << 62, 1 << 63, 500).astype(np.uint64))
    assert (lm_scoring.unpack_sorted(lm_scoring.pack_sorted(h, 1 << 60), 1 << 60) == h).all()
    c = np.array([0, 1, 70_000, 2**40])
    assert (lm_scoring.unpack_counts(lm_scoring.pack_counts(c)) == c).all()
