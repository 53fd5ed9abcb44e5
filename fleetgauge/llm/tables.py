"""Helpers the operators share: the input's columns, stored intermediate results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fleetgauge.sources.scratch import shared_folder

# Stands for a null id where joins need a value; a flag or a hash beside it tells the two apart.
NO_ID = "CAST(-9223372036854775808 AS BIGINT)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and whole ``text`` of every row, a null text as the empty one.

    Other columns stay behind, so their names cannot clash with an operator's.
    """
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "coalesce(text, '') AS text")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, computed once and read from there.

    Lineage ends there: a lost executor costs reading a file again, not
    computing it again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
