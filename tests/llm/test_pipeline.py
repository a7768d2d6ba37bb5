"""The pipeline against a brute-force version of its stages."""

import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_near_duplicates import brute
from tidelake.llm.secret_scan import BASE_RULES, PREFIX_RULES


def redacted(text):
    spans = []
    for rule in BASE_RULES + PREFIX_RULES:
        spans += [m.span() for m in re.finditer(rule.pattern, text) if len(m[rule.measured]) >= rule.least]
    out, at, end = "", 0, -1
    for a, b in sorted(spans):
        if a >= end:
            out += text[at:a] + "[secret]"
        end = max(end, b)
        at = end
    return out + text[at:]


def expected(rows):
    rows = [r for r in rows if any(c.isalpha() for c in r["text"] or "")]
    best = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", r["text"])
        best[key] = min(best.get(key, (1, 0)), (-len(r["text"]), r["doc_id"]))
    kept = {i for _, i in best.values()}
    rows = [r for r in rows if r["doc_id"] in kept]
    components = brute([(r["doc_id"], r["text"]) for r in rows])
    return {r["doc_id"]: redacted(r["text"]) for r in rows if components[r["doc_id"]][1] == r["doc_id"]}


def test_pipeline(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want, tok = expected(rows), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert len(want) < len(rows)
    pieces = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    assert set(pieces) == set(want)
    for doc_id, text in want.items():
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert b"".join(x for _, x in sorted(pieces[doc_id])) == ids


def test_stages_on_odd_rows(spark, sf_dir):
    rows = [(1, None), (2, ""), (3, "12 !"), (4, "secret: abcdefgh12 and more"), (4, "secret: abcdefgh12 and more"), (None, "no id here"), (None, "no id here"), (5, "secret:   abcdefgh12 and more"), (6, "x" * 100000)]
    docs = spark.createDataFrame([(i, t, None, None, None, "extra") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == corpus_pipeline.COLUMNS
        docs = corpus_pipeline.materialised(docs)
    got = sorted((str(r["doc_id"]), r["text"][:40]) for r in docs.collect())
    assert got == [("5", "[secret] and more"), ("6", "x" * 40), ("None", "no id here")]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), sf_dir).count() == 0


def test_missing_languages_are_filled_in(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", "if(doc_id % 2 = 0, null, lang) AS lang", "source", "n_chars", "1 AS lang_pred")
    known = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = corpus_pipeline.identify_language(spark, docs, sf_dir).collect()
    assert all(r["lang"] == known[r["doc_id"]] for r in got if r["doc_id"] % 2)
    filled = [r["lang"] == known[r["doc_id"]] for r in got if r["doc_id"] % 2 == 0]
    assert np.mean(filled) > 0.97


def test_language_id_without_labels(spark, sf_dir):
    """Nothing to learn from, or only a language named as what has none: what has a letter stays."""
    rows = [(1, None), (2, ""), (3, "12 !"), (4, "some words"), (None, "no id here"), (5, "\u00e9"), (6, "\u6f22\u5b57")]
    for lang in (None, "und"):
        docs = spark.createDataFrame([(i, t, lang, None, None) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
        got = corpus_pipeline.identify_language(spark, docs, sf_dir)
        assert got.columns == corpus_pipeline.COLUMNS
        assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == sorted((str(i), t) for i, t in rows[3:])
