"""Periodic runs against a plain search over all periods."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from tidelake.llm import periodic_runs


def plain_runs(words):
    """Every stretch of each period, with a check that no smaller period holds."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            if length >= max(24, 3 * q) and not any(words[start : start + length - p] == words[start + p : start + length] for p in range(1, q)):
                out.append((start, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(texts, rewrite=None, ids=None):
    batch = periodic_runs._block(ids or list(range(len(texts))), [t.encode() for t in texts], rewrite)
    return [([(r["start"], r["length"], r["period"]) for r in row["runs"]], row["collapsed"]) for row in batch.to_pylist()]


def collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_a_plain_search(seed):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(12):
        words = []
        while len(words) < rng.integers(0, 260):
            part = [f"w{x}" for x in rng.integers(0, rng.integers(1, 4), rng.integers(1, 14))]
            words += part * int(rng.integers(1, 12))
            words += part[: rng.integers(0, len(part))]
        texts.append(" ".join(words))
    for text, (runs, kept) in zip(texts, found(texts), strict=True):
        words = text.split()
        assert runs == plain_runs(words)
        assert kept == collapsed(words, runs)


def test_edges_of_length_and_period():
    a, b = ["x"] * 23, ["x"] * 24
    nine = [str(k) for k in range(9)]
    texts = [" ".join(a), " ".join(b), " ".join(nine * 3), " ".join((nine * 3)[:-1]), " ".join(nine * 2 + nine[:8] + ["q"]), "", " \t\r\n\v\f "]
    assert [r for r, _ in found(texts)] == [[], [(0, 24, 1)], [(0, 27, 9)], [], [], [], []]


def test_runs_never_cross_documents_and_only_ascii_spaces_part_words():
    texts = ["x " * 20, "x " * 20, " x " * 24, "x " * 30]
    assert [r for r, _ in found(texts)] == [[], [], [(0, 24, 1)], []]


def test_a_long_text_of_one_word_and_nested_runs():
    inner = ["a"] * 30 + ["b"]
    texts = ["z " * 50_000, " ".join(inner * 4), " ".join(str(i) for i in range(60_000))]
    (one, kept), (nested, _), (none, _) = found(texts)
    assert (one, kept) == ([(0, 50_000, 1)], "z")
    assert nested == [(0, 30, 1), (0, 124, 31), (31, 30, 1), (62, 30, 1), (93, 30, 1)]
    assert none == []


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return (
        doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
        hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest(),
    )


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_equals_a_plain_search(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 4000")
    rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
    rows += [(10_000 + k, "one two three four five " * k) for k in range(40)] + [(10_000, "again"), (None, "z " * 40), (None, None), (7, None), (8, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as start", "array(2) as runs").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r[c] for c in COLUMNS) for r in periodic_runs.op13_periodic_runs(spark, str(tmp_path)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[6], r[7])
    assert sorted(got, key=key) == sorted((expected(*r) for r in rows), key=key)
    assert sum(r[1] > 0 for r in got) > 30


def test_empty_table(spark):
    assert periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
