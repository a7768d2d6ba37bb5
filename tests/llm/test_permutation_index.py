"""The permutation index against brute force."""

import numpy as np
import pytest

from tidelake.llm import permutation_index as ann


def brute(ids, vectors, query, k=20):
    score = vectors @ vectors[ids.index(query)]
    order = sorted((-score[j], i) for j, i in enumerate(ids) if i != query)[:k]
    return [(i, -s) for s, i in order]


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(4000, 64)).astype(np.float32)
    return vectors.astype(np.float64), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")


def test_recall_without_clusters(many, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 1500)
    monkeypatch.setattr(ann, "QUERY_ROWS", 90)
    vectors, rows = many
    got = by_query(ann.nearest(rows, rows.filter("vec_id % 20 = 0")).collect())
    assert len(got) == 200 and all(len(x) == 20 for x in got.values())
    ids, hits = list(range(4000)), 0
    for q, found in got.items():
        assert all(abs(s - vectors[q] @ vectors[i]) < 1e-12 for i, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        hits += len({i for i, _ in found} & {i for i, _ in brute(ids, vectors, q)})
    assert hits / 4000 >= 0.9


def test_a_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, vectors = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float64)
    got = by_query(ann.op2_permutation_index(spark, sf_dir).collect())
    assert set(got) == {i for i in ids if i % 20 == 0}
    hits = [len({i for i, _ in found} & {i for i, _ in brute(ids, vectors, q)}) / 20 for q, found in got.items()]
    assert np.mean(hits) >= 0.9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [None, 1.0]), (None, [1.0, 1.0]), (5, [3.0])]
    table = spark.createDataFrame([(i, v, 0, 1.0) for i, v in rows], "vec_id bigint, embedding array<double>, shard int, score double")
    got = by_query(ann.nearest(table, table.filter("vec_id % 20 = 0")).collect())
    if 5 in {i for x in got.values() for i, _ in x}:
        raise AssertionError("vectors of another length take no part")
    assert got == {0: [(1, 1.0), (2, 1.0), (20, 0.0)], 20: [(1, 1.0), (2, 1.0), (0, 0.0)]}
    assert ann.nearest(table.filter("false"), table).count() == 0
    assert ann.nearest(table, table.filter("false")).count() == 0


def test_recall_with_a_third_equal(spark, monkeypatch):
    """The copies are found by smallest ids, and what is not a copy as well as without them."""
    monkeypatch.setattr(ann, "SHARD_ROWS", 1500)
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(3000, 32))
    vectors[1::3] = vectors[1]
    vectors[2::60] = vectors[1] + rng.normal(size=(50, 32)) * 0.3  # nearest to the copies, but not copies
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    assert len(np.unique(ann.draw_pivots(ann.distinct_vectors(ann.valid_vectors(rows), 20)), axis=0)) == ann.PIVOTS
    got = by_query(ann.nearest(rows, rows.filter("vec_id % 20 = 0 or vec_id % 60 = 2 or vec_id in (1, 4, 2998)")).collect())
    ids, hits = list(range(3000)), {}
    for q, found in got.items():
        # equal vectors may differ in the last bit of the brute-force product
        score = np.round(vectors @ vectors[q], 9)
        want = [i for _, i in sorted((-score[j], j) for j in ids if j != q)[:20]]
        kind = "copy" if q % 3 == 1 else "near" if q % 60 == 2 else "other"
        hits.setdefault(kind, []).append(len({i for i, _ in found} & set(want)) / 20)
    assert np.mean(hits["copy"]) >= 0.97 and np.mean(hits["near"]) >= 0.9 and np.mean(hits["other"]) >= 0.9, {k: np.mean(x) for k, x in hits.items()}


def test_one_id_with_two_vectors_counts_once(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [0.9, 0.1]), (1, [0.1, 0.9]), (2, [0.2, 0.8]), (2, [0.2, 0.8])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ann.nearest(table, table.filter("vec_id = 20")).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(20, 1, 1), (20, 2, 2)]
    assert [round(r["score"], 9) for r in got] == [0.9, 0.8]
