"""The digest index over batches: levels, filters, and that batches add up to what one makes."""

import pytest
from pyspark.sql import functions as F

from tidelake.llm import exact_dedup
from tidelake.llm.digest_index import DigestIndex
from tests.llm.test_exact_and_secrets import ROWS, brute


@pytest.fixture
def rows(sf_dir, spark):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(120).collect()
    return [(r["doc_id"] + 1000, r["text"]) for r in table] + [(r["doc_id"] + 5000, r["text"]) for r in table[::3]] + ROWS


def told(frame):
    return sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in frame.collect())


def stands(index):
    return {r["text_sha256"]: (str(r["keep_id"]), r["group_size"]) for r in index.groups().collect()}


@pytest.mark.parametrize("blocks", [4096, 0], ids=["filter", "join"])
def test_batches_add_up_to_one(spark, rows, tmp_path, monkeypatch, blocks):
    monkeypatch.setattr(exact_dedup, "FILTER_BLOCKS", blocks)
    table = lambda some: spark.createDataFrame([(*r, "x") for r in some], "doc_id bigint, text string, digest string")
    whole = DigestIndex(spark, str(tmp_path / "whole"))
    assert told(whole.add(table(rows))) == brute(rows)
    parts = DigestIndex(spark, str(tmp_path / "parts"), fan_out=2)
    for k in range(3):
        parts.add(table(rows[k::4])).count()
    last = told(parts.add(table(rows[3::4])))
    assert stands(parts) == stands(whole)
    assert last == sorted(brute_row(rows, r) for r in rows[3::4])
    assert [(r["level"], r["name"]) for r in parts.runs()] == [(2, "00000006")]  # four batches, merged by twos
    assert told(exact_dedup.exact_dedup(table(rows))) == brute(rows)


def brute_row(rows, row):
    """What the plain version says of a row."""
    return next(x for x in brute(rows) if x[0] == str(row[0]) and x[4] == hash_of(row[1]))


def hash_of(text):
    import hashlib
    import re

    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text or "").encode()).hexdigest()


def test_lookup_takes_nothing_in(spark, tmp_path):
    index = DigestIndex(spark, str(tmp_path / "index"))
    index.add(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id bigint, text string"))
    asked = spark.createDataFrame([(7, "ab"), (8, "zz"), (None, " c")], "doc_id bigint, text string")
    assert sorted(map(str, map(tuple, index.lookup(asked).collect()))) == ["(7, 1, 1)", "(None, 2, 1)"]
    assert index.groups().count() == 2


def test_a_failed_batch_leaves_no_trace(spark, tmp_path):
    index = DigestIndex(spark, str(tmp_path / "index"))
    index.add(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"))
    broken = spark.createDataFrame([(2, "b")], "doc_id bigint, text string").withColumn("text", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        index.add(broken)
    assert [r["name"] for r in index.runs()] == ["00000000"]
    index.add(spark.createDataFrame([], "doc_id bigint, text string"))
    assert stands(index).keys() == {hash_of("a")}
