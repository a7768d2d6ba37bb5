"""What the training-data operators share: reading tables, shared scratch space, small helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_root(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session. Where neither it nor a checkpoint folder is set,
    a session on one machine (tests) gets a temporary folder; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tidelake-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def materialised(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read back: lineage ends there."""
    path = scratch_root(df.sparkSession)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))
