"""Language identification and quality resampling: held-out accuracy, brute force, odd rows."""

import re
import zlib

import numpy as np
import pytest

from tidelake.llm import language_id, quality_resampling


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_held_out_accuracy(spark, sf_dir, table):
    rows = language_id.op4_language_id(spark, sf_dir).collect()
    assert len(rows) == len(table)
    right = [r["lang_pred"] == table[r["doc_id"]]["lang"] for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean(right) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def plain_parse(text, sample):
    """Phrases cut off one by one by searching the sample, and how many are symbols that it lacks."""
    phrases, lacking, i = 0, 0, 0
    while i < len(text):
        j = i + 1
        lacking += text[i:j] not in sample
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        phrases, i = phrases + 1, j
    return phrases, lacking


@pytest.mark.parametrize("letters", [4, 40])
def test_phrases_equal_a_plain_parse(letters):
    rng = np.random.default_rng(0)
    sample = rng.integers(1, letters, 600).tolist()
    automaton = language_id.Automaton(sample, letters + 2)
    for n in (1, 2, 7, 50, 400):
        text = rng.integers(0, letters + 2, n)
        phrases, lacking = automaton.phrases(text, np.array([0]), np.array([n]))
        assert (phrases[0], lacking[0]) == plain_parse(bytes(text.tolist()), bytes(sample))


#: Ids of rows that are learnt from.
LEARNT = [i for i in range(10**6, 10**6 + 99) if zlib.crc32(str(i).encode()) % 3 != 1]
ODD = [
    [("q", "zz")],
    [("ok then", "zz")],
    [("??", "yy"), ("e", "aa")],
    [("the ", "aa"), ("a b c d e f g h i j k l m n o p q r s t u v w x y z", "ab")],
    [("".join(chr(0x4E00 + (37 * k + 11 * i * i) % 3000) for i in range(400)), "zh") for k in range(40)],
]


@pytest.mark.parametrize("rows", ODD)
def test_small_and_foreign_labels_take_nothing(spark, rows):
    """A label with a letter or a few words to learn from, or another script with thousands of letters."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(i, *r) for i, r in zip(LEARNT, rows)], "doc_id bigint, text string, lang string")
    both = docs.unionByName(more)
    model = language_id.Model(language_id.training_sample(both))
    assert {lang for _, lang in rows} <= set(model.langs)
    got = language_id.predict(both.withColumn("held_out", language_id.held_out()), model, ["doc_id", "lang", "held_out"]).filter("held_out and lang is not null and lettered").collect()
    own = [r for r in got if r["doc_id"] < 10**6]
    assert len(own) > 250
    assert np.mean([r["lang_pred"] == r["lang"] for r in own]) > 0.99
    if rows[0][1] == "zh":
        foreign = language_id.predict(more, model, ["doc_id"]).collect()
        assert all(r["lang_pred"] == "zh" for r in foreign)


def test_predictions_equal_a_plain_parse(spark, sf_dir, table):
    """The least bits per symbol, with phrases at log2 of the largest sample."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    samples = language_id.training_sample(docs)
    model = language_id.Model(samples)

    def symbols(text):
        return re.sub(r"[^\W\d_]", lambda c: c[0].lower() if len(c[0].lower()) == 1 else c[0], re.sub(r"[\W\d_]+", " ", text))

    held = {lang: symbols(" ".join(texts)) for lang, texts in samples.items()}
    most, letters = max(map(len, held.values())), len(set("".join(held.values())) - {" "})
    rows = {r["doc_id"]: r for r in language_id.op4_language_id(spark, sf_dir).collect()}
    assert model.phrase_bits == np.log2(most)
    checked = 0
    for doc_id, r in sorted(table.items()):
        text = r["text"] or ""
        if not 20 < len(text) < 500 or not any(c.isalpha() for c in text):
            continue
        own, entropy = symbols(text), {}
        for lang, sample in sorted(held.items()):
            phrases, lacking = plain_parse(own, sample)
            entropy[lang] = (phrases * np.log2(most) + lacking * np.log2(2 + letters)) / len(own)
        best = sorted(entropy, key=lambda x: (entropy[x], x))
        if entropy[best[1]] - entropy[best[0]] > 1e-9:
            assert rows[doc_id]["lang_pred"] == best[0]
            assert abs(rows[doc_id]["score"] - entropy[best[1]] / (entropy[best[0]] + entropy[best[1]])) < 1e-9
            checked += 1
    assert checked > 10


def test_log_weights_equal_a_plain_count(spark, sf_dir, table):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}

    def features(text):
        h = [zlib.crc32(w.encode()) for w in re.findall(r"\w+|[^\w\s]+", text or "")]
        both = [((a * 0x9E3779B97F4A7C15) ^ (b * 0xC2B2AE3D27D4EB4F)) % (1 << 64) >> 17 for a, b in zip(h, h[1:], strict=False)]
        return [x % quality_resampling.FEATURES for x in h + both]

    raw, target = (np.full(quality_resampling.FEATURES, quality_resampling.SMOOTHING) for _ in range(2))
    for doc_id, r in table.items():
        np.add.at(raw, features(r["text"]), 1)
        if labels.get(doc_id) == 1:
            np.add.at(target, features(r["text"]), 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    got = quality_resampling.op10_quality_resampling(spark, sf_dir).collect()
    assert len(got) == len(table)
    for r in got:
        own = features(table[r["doc_id"]]["text"])
        assert (r["log_weight"] is None) == (not own)
        assert not own or abs(r["log_weight"] - ratio[own].sum()) < 1e-6 * max(1, len(own))


def test_odd_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.Model(language_id.training_sample(docs))
    rows = [(1, None, 5), (2, "", 5), (3, "123 !?", 5), (4, "the and of with this " * 3000, 5), (5, "中文", 5), (None, "that is the one with the other", 5), (6, "x", 5), (6, "x", 5)]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, score int").selectExpr("*", "'x' AS lang_pred", "true AS lettered")
    got = language_id.predict(odd, model, ["doc_id"]).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 8
    assert [by[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and by[1]["score"] == 0
    assert by[4]["lang_pred"] == by[None]["lang_pred"] == "en"
    assert by[5]["lang_pred"] in model.langs
    assert language_id.predict(odd.filter("false"), model, ["doc_id"]).count() == 0
    nothing = language_id.Model(language_id.training_sample(docs.filter("false")))
    assert {r["lang_pred"] for r in language_id.predict(odd, nothing, ["doc_id"]).collect()} == {"und"}


def test_resampling_prefers_good_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in quality_resampling.op10_quality_resampling(spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    kept = {q: np.mean([rows[x["doc_id"]]["kept"] for x in labels if x["quality"] == q]) for q in (0, 1)}
    assert kept[1] > 0.9 and kept[0] < 0.4


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 1.0])
def test_sample_is_the_top_k(spark, sf_dir, share):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality_resampling.resample(docs, labels, share).collect()
    want = sorted(rows, key=lambda r: (-r["sample_key"], r["doc_id"]))[: round(len(rows) * share)]
    assert {r["doc_id"] for r in rows if r["kept"]} == {r["doc_id"] for r in want}


def test_key_bits_compare_as_the_keys_do():
    rng = np.random.default_rng(0)
    keys = np.concatenate([rng.normal(0, 1e3, 500), rng.normal(0, 1e-300, 100), [0.0, -0.0, 1e12, -1e12, np.nextafter(5.0, 6.0), 5.0, np.inf, -np.inf]])
    bits = quality_resampling.ordered_bits(keys).view(np.uint64)
    assert (np.argsort(bits, kind="stable") == np.argsort(keys, kind="stable")).all()
    assert len(np.unique(bits)) == len(np.unique(keys))


def test_resampling_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "good words"), (4, "good words"), (None, "x"), (5, "x" * 100000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as quality", "'a' as words")
    labels = spark.createDataFrame([(4, 1), (4, 1), (None, 1), (5, None)], "doc_id bigint, quality int")
    got = quality_resampling.resample(docs, labels, 0.5).collect()
    assert len(got) == 7 and sum(r["kept"] for r in got) <= 4
    assert not any(r["kept"] for r in got if r["doc_id"] in (1, 2, 3))
    assert quality_resampling.resample(docs.filter("false"), labels).count() == 0
    assert quality_resampling.resample(docs, labels.filter("false")).count() == 7
