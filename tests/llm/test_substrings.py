"""Substring dedup and suffix-array dedup against brute force."""

import hashlib
import time

import numpy as np
import pytest

from tidelake.llm import substring_dedup, suffix_dedup, superkmer

PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
ROWS = [
    (5, PASSAGE), (3, f"start {PASSAGE} end"), (9, f"{PASSAGE}\n\n{PASSAGE}"), (4, "tick " * 300), (6, "tick " * 40), (7, None), (8, ""), (10, " \t\n"), (None, PASSAGE), (None, PASSAGE),
    (11, "é " * 14 + "x"), (12, "ü é " + "é " * 14), (5, PASSAGE), (5, "other text under a repeated id " + PASSAGE), (13, "a b c"), (14, "y" * 9000), (15, "z " + "y" * 9000), (16, PASSAGE.replace(" ", " ")),
    (17, "word " * 12 + "last"), (18, "word " * 12 + "last"),
]
BIG = 1 << 62


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in ROWS], "doc_id bigint, text string, start int, spans string")


def brute_words(rows):
    """Windows by dictionary: the smallest document of each."""
    first = {}
    split = [(BIG if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, BIG + 1), i)
    out = []
    for (i, w), (doc_id, _) in zip(split, rows, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        out.append((str(doc_id), len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["sha"]) for r in df.selectExpr("*", "sha2(kept_text, 256) sha").collect())


def test_windows_of_odd_rows(odd):
    assert result(substring_dedup.dedup_windows(odd, 3)) == brute_words(ROWS)
    assert substring_dedup.dedup_windows(odd.filter("false")).count() == 0


def test_windows_of_a_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.op8_substring_dedup(spark, sf_dir).collect())
    want = brute_words(rows)
    assert got == want
    assert sum(x[2] for x in want) > 0


def brute_bytes(rows):
    first = {}
    data = [(BIG if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - 99):
            key = b[k : k + 100]
            first[key] = min(first.get(key, (BIG + 1, 0)), (i, k))
    out = []
    for (i, b), (doc_id, _) in zip(data, rows, strict=True):
        gone, n_spans = bytearray(len(b) + 1), 0
        for k in range(len(b) - 99):
            if first[b[k : k + 100]] < (i, k):
                gone[k : k + 100] = b"\1" * 100
        n_spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((str(doc_id), len(b), sum(gone[:-1]), n_spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest()))
    return sorted(out)


def of_bytes(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n"], r["sha"]) for r in df.selectExpr("*", "sha2(kept, 256) sha", "size(removed) n").collect())


@pytest.mark.parametrize("shard_bytes", [suffix_dedup.SHARD_BYTES, 400])
def test_bytes_of_odd_rows(odd, shard_bytes):
    assert of_bytes(suffix_dedup.dedup_bytes(odd, 3, shard_bytes)) == brute_bytes(ROWS)
    assert suffix_dedup.dedup_bytes(odd.filter("false")).count() == 0


def test_bytes_over_cut_shards(spark):
    """Many different strings around one passage: one minimiser, several shards."""
    core = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(150))
    rows = [(i, f"{i * 7919} {core[i % 5 : 140 + i % 7]} {i * 104729}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert of_bytes(suffix_dedup.dedup_bytes(docs, 1, 900)) == brute_bytes(rows)


def test_bytes_of_a_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.op1_suffix_dedup(spark, sf_dir).collect())
    want = brute_bytes(rows)
    assert got == want
    assert sum(x[2] for x in want) > 0


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for text in (rng.integers(97, 99, 500), np.full(300, 97), rng.integers(97, 123, 50), np.array([97])):
        text = text.astype(np.uint8)
        data = text.tobytes()
        sa = suffix_dedup.suffix_array(text, 1000)
        assert sa.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        shared = suffix_dedup.common_prefixes(text, sa, 100, 7)
        for k in range(1, len(sa)):
            a, b = data[sa[k - 1] :], data[sa[k] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert shared[k] == min(n, 100)


def test_shard_of_long_shared_passages():
    """Passages of 130 to 180 bytes in different contexts, over 16 KB: lanes of prefixes walk more than one position."""
    rng = np.random.default_rng(3)
    some = lambda low, high: rng.integers(97, 99, rng.integers(low, high)).astype(np.uint8).tobytes()
    passages = [some(130, 181) for _ in range(40)]
    strings = sorted({some(0, 20) + passages[i % 40] + some(0, 20) for i in range(400)})
    assert sum(map(len, strings)) > 4 << 14
    ids, first = rng.permutation(len(strings)), {}
    windows = [(i, k, n, s[k : k + 100]) for n, (i, s) in enumerate(zip(ids.tolist(), strings, strict=True)) for k in range(len(s) - 99)]
    for i, k, _, window in windows:
        first[window] = min(first.get(window, (BIG, 0)), (i, k))
    want = [(n, k) for i, k, n, window in windows if first[window] < (i, k)]
    string, offset = suffix_dedup.Shard(strings, ids, np.zeros(len(strings), np.int64)).covered()
    assert list(zip(string.tolist(), offset.tolist(), strict=True)) == want


def test_rows_without_id_have_keys_of_their_own(spark):
    docs = spark.range(30000).selectExpr("cast(null as bigint) doc_id", "concat('text ', id) text")
    assert superkmer.identified(docs).select("text_key").distinct().count() == 30000


def around_one_minimiser(n, seed, copies=0):
    """Different strings of 184 bytes around one m-mer, and copies of some of their windows in others."""
    rng = np.random.default_rng(seed)
    mark = b"</div><div class="[:16]
    sides = rng.integers(97, 123, (n, 168), np.uint8)
    for k in range(copies):
        sides[n - 1 - k, :150] = sides[k, :150]
    return [x[:84].tobytes() + mark + x[84:].tobytes() for x in sides]


def test_a_hot_minimiser_is_cut_by_the_next(monkeypatch):
    strings = around_one_minimiser(400, 1, copies=60)
    order = np.arange(len(strings))
    parcel = superkmer.packed(strings, doc_id=order, text_key=order * 7, start=order * 0, place=order * 0 + 84)
    whole = suffix_dedup._settle([parcel], 10**9)
    for most in (4, 1, 0):
        monkeypatch.setattr(suffix_dedup, "MOST_MINIMISERS", most)
        monkeypatch.setattr(suffix_dedup, "PARTED_BYTES", 10_000)
        parted = suffix_dedup._settle([parcel], 5_000)
        covered = [sorted({(d, i) for d, a, b in zip(f["doc_id"].tolist(), f["start"].tolist(), f["stop"].tolist()) for i in range(a, b)}) for f in (whole, parted)]
        assert covered[0] == covered[1]
    assert len({d for d, _ in covered[0]}) == 60


def test_time_follows_the_size_of_a_hot_minimiser():
    took = []
    for n in (20_000, 60_000):
        strings = around_one_minimiser(n, 2)
        order = np.arange(n)
        parcel = superkmer.packed(strings, 1, doc_id=order, text_key=order, start=order * 0, place=order * 0 + 84)
        began = time.process_time()
        suffix_dedup._settle([parcel])
        took.append(time.process_time() - began)
    assert took[1] < 5 * took[0] + 1
