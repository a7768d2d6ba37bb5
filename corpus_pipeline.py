"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that its predecessor kept, as Parquet, and all but the last return the
columns of documents:

1. language ID rejects documents without any letter, which have no language, and no others: not those
   whose language is unknown because no row offers a label to learn from. A document without lang gets the
   predicted one;
2. exact dedup keeps one document of each group of copies;
3. near dedup keeps the smallest document of each component of near-duplicates;
4. the secret scan replaces every secret by a mark and leaves clean texts as they are;
5. packing lays the token pieces of what is left into sequences.

Defined results: a null or empty text has no letter and goes first; a null doc_id is kept by the dedup stages
as far as its text allows: exact copies go, near copies stay; rows given twice count once; very long texts are
read whole by every stage; an empty table, or one of which nothing is kept, packs into nothing; further columns,
whatever their names, are dropped by the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import exact_dedup, language_id, minhash_dedup, packing, secret_scan
from tidelake.llm.common import documents, materialised

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.Model(language_id.training_sample(docs))
    rows = language_id.predict(docs, model, [c for c in COLUMNS if c != "text"]).filter("lettered")
    return rows.withColumn("lang", F.coalesce("lang", F.nullif("lang_pred", F.lit(language_id.UNDETERMINED)))).select(COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    stays = exact_dedup.exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha256")).distinct()
    keyed = docs.withColumn("sha256", F.sha2(exact_dedup.normalised(), 256))
    same = keyed["doc_id"].eqNullSafe(stays["kept_id"]) & (keyed["sha256"] == stays["kept_sha256"])
    # a row given twice is a copy too
    return keyed.join(stays.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", "sha256"]).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    goes = minhash_dedup.near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(goes.hint("merge"), "doc_id", "left_anti").select(COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, COLUMNS).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", identify_language), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("secret scan", redact_secrets), ("packing", pack_sequences)]

#: SQL can't express language ID, sketches or tokenisation; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
