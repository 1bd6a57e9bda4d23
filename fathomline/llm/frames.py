"""Small DataFrame helpers that the corpus operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, k: int) -> Column:
    """crc32 of the id as text, modulo k."""
    return F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % k


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fits_broadcast(df: DataFrame, most_bytes: int, row_bytes: int) -> bool:
    """Whether the rows of ``df`` are few enough to send to every executor (counted, not guessed)."""
    most = math.ceil(most_bytes / row_bytes)
    return df.limit(most + 1).count() <= most
