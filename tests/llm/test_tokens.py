"""BPE codec and packing against the tokenizers library itself."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidelake.llm import bpe_codec, packing

TEXTS = [
    None, "", " ", "a", "It's  the\n\n  end's", "x" * 5000, "word " * 9000, "a<|endoftext|>b <|endoftext|><|endoftext|>", "中文 テスト ２３   x", "é É İ ς Σ K",
    "🙂🙂 \U0001fae8 \U00010d4a Ᲊ", "''s 'S 's't", "tabs\t\tand\r\nlines ", "1234 5678", "same", "same",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "z", 0) for i, t in enumerate(TEXTS)] + [(3, "a", "z", 0), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, piece int")


def encoded(name, text):
    return np.array(Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_codec_equals_the_library(docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["ids"]), r["decoded"]) for r in bpe_codec.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), 3, 50).collect())
    want = []
    for r in docs.collect():
        ids = encoded("byte_bpe_50k.json", r["text"])
        want.append((r["doc_id"] is None, r["doc_id"] or 0, ids, tok.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)))
    assert got == sorted(want)


def test_codec_of_a_table(spark, sf_dir):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = bpe_codec.op3_bpe_codec(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def check_layout(rows, least):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in rows)
    assert -(-total // 4096) <= len(by) <= least(-(-total // 4096))


def test_packing_equals_the_library(docs):
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in rows)
    want = []
    for r in docs.collect():
        ids = encoded("word_bpe_49k.json", r["text"]) + np.array([1], "<u4").tobytes()
        want += [(r["doc_id"] is None, r["doc_id"] or 0, k // 16384, k // 4, len(ids[k : k + 16384]) // 4, ids[k : k + 16384]) for k in range(0, len(ids), 16384)]
    assert got == sorted(want)
    check_layout(rows, lambda n: n + 1)


def test_packing_of_a_table(spark, sf_dir):
    rows = packing.op5_best_fit_packing(spark, sf_dir).collect()
    docs = {r["doc_id"]: encoded("word_bpe_49k.json", r["text"]) + np.array([1], "<u4").tobytes() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"] for r in rows} == set(docs)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(docs[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])])
    check_layout(rows, lambda n: n + 1)


def test_empty_table(docs):
    none = docs.filter("false")
    assert bpe_codec.encode_and_decode(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert packing.pack(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_each_piece_once_and_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    counts = {int(k): int(n) for k, n in zip(*np.unique(np.clip(rng.lognormal(6, 1.2, 20000).astype(int), 1, 4096), return_counts=True), strict=True)}
    plan = packing.plan_combinations(counts, 4096)
    used = {}
    for combo, times in plan:
        assert sum(combo) <= 4096
        for x in combo:
            used[x] = used.get(x, 0) + times
    assert used == counts
    total = sum(k * n for k, n in counts.items())
    assert sum(t for _, t in plan) <= -(-total // 4096) + 2


def test_unpackable_lengths_stay_alone():
    assert sum(t for _, t in packing.plan_combinations({3000: 7}, 4096)) == 7
