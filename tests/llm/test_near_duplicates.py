"""Near-duplicates against all pairs, components against union-find, sketches against the truth."""

import random
import re

import numpy as np
import pytest

from tidelake.llm import components, minhash_dedup


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else ({tuple(words)} if words else set())


def brute(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, shingles(t))
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_a_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.op7_minhash_dedup(spark, sf_dir).collect()}
    assert got == brute(rows)


@pytest.fixture(scope="module")
def families():
    """Chains in which neighbours are similar and ends are not, copies, and texts around the threshold."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = []
    for family in range(12):
        text = [word() for _ in range(120)]
        for _ in range(rng.randint(1, 14)):
            rows.append(" ".join(text))
            if rng.random() < 0.3:
                rows.append("  ".join(text).upper())
            for _ in range(rng.randint(1, 4)):
                text[rng.randrange(len(text))] = word()
    rows += ["", None, " \n", "a", "A", "a b", "a b c", "a b c d", "a b c d e", "x" * 50000, "tick " * 2000, "tick " * 1999]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_families(spark, families):
    docs = spark.createDataFrame([(i, t, 0, "n") for i, t in families], "doc_id bigint, text string, component_id int, kept string")
    got = minhash_dedup.near_duplicates(docs).collect()
    want = brute(families)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == want[r["doc_id"]][1]) for r in got)


def test_members_that_the_leader_does_not_link(spark, families, monkeypatch):
    """With one band of one register nearly all meet in few buckets, and links come from comparing components."""
    docs = spark.createDataFrame(families, "doc_id bigint, text string")
    monkeypatch.setattr(minhash_dedup, "BANDS", 32)
    monkeypatch.setattr(minhash_dedup, "BLOCK_MEMBERS", 3)
    monkeypatch.setattr(minhash_dedup, "PAIRS_PER_COPY", 2)
    monkeypatch.setattr(minhash_dedup, "PRODUCT_WIDTH", 7)
    monkeypatch.setattr(minhash_dedup, "ROWS", 1)
    got = minhash_dedup.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(families)


def test_a_large_group_around_the_threshold(spark):
    """Half of a group links to its middle, the others differ from it too much; those are linked in pairs or not at all."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    middle, rows = [word() for _ in range(150)], []
    for _ in range(400):
        text = list(middle)
        for _ in range(rng.randint(0, 10)):
            text[rng.randrange(len(text))] = word()
        rows.append(" ".join(text))
        if rng.random() < 0.1:
            text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text))
    rows = list(enumerate(rows))
    want = brute(rows)
    n_components = len({c for _, c in want.values()})
    assert 50 < n_components < 300
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_links_of_blocks_against_all_pairs():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.choice(60, rng.integers(1, 50))).astype(np.uint64) for _ in range(40)]
    component, block = rng.integers(0, 30, 40), rng.integers(0, 2, 40)
    for blocks in (block, np.zeros(40, np.int64)):
        x, y = minhash_dedup._linked_pairs(sets, blocks, component)
        got = {(min(p), max(p)) for p in zip(x.tolist(), y.tolist(), strict=True)}
        want = set()
        for i in range(40):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if component[i] != component[j] and (blocks[i] != blocks[j] or not blocks.any()) and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    want.add((j, i))
        assert got == want


def test_odd_rows(spark):
    text = "some words that are long enough to make shingles of four words each"
    docs = spark.createDataFrame([(None, text), (2, text), (2, text), (1, text), (None, None), (3, None)], "doc_id bigint, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in minhash_dedup.near_duplicates(docs).collect())
    assert got == [("1", "1", True), ("2", "1", False), ("2", "1", False), ("3", "3", True), ("None", "None", True), ("None", "None", True)]
    assert minhash_dedup.near_duplicates(docs.filter("false")).count() == 0


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(3)
    for similarity in (0.5, 0.8, 0.95):
        n = 4000
        both = int(2 * n * similarity / (1 + similarity))
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a, b = pool[:n], pool[n - both : 2 * n - both]
        ka, kb = (minhash_dedup.registers(x, np.array([0])) for x in (a, b))
        got = minhash_dedup.estimated_similarity(ka, kb, np.array([n]), np.array([n]))[0]
        assert abs(got - similarity) < 0.15
        union = minhash_dedup.registers(np.unique(np.concatenate([a, b])), np.array([0]))
        assert (np.maximum(ka, kb) == union).all()


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(200, i) for i in range(201, 240)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {x: x for link in links for x in link}
    for _ in range(len(want)):
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want
