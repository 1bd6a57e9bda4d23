"""Queries that apply the operators to the driver's tables, each with its DuckDB twin where SQL can say it.

None of the tables holds frames; each query reads a table as a stand-in, as its docstring or the views below say:
``frames``: events of a user in order of time are a clip's frames; ``pixels``: a vector is an 8 x 8 image.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FRAMES_SQL = "f AS (SELECT user_id AS clip_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame_idx, value, event_type, event_id, ts FROM events)"
PIXELS_SQL = "p AS (SELECT vec_id AS frame, label, CAST((i - 1) // 8 AS INTEGER) AS \"row\", CAST((i - 1) % 8 AS INTEGER) AS col, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) AS r(i))"
SIDE = 8


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id"), (F.row_number().over(w) - 1).alias("frame_idx"), "value", "event_type", "event_id", "ts")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), "label", F.posexplode("embedding").alias("i", "x"))
    return e.filter(F.col("i") < SIDE * SIDE).select("frame", "label", F.floor(F.col("i") / SIDE).cast("int").alias("row"), (F.col("i") % SIDE).cast("int").alias("col"), F.col("x").cast("double").alias("v"))


from fathomline.queries import catalogue, jobs, pixel_work, resume, scalar, scenes, sequence, statistic, stores  # noqa: E402, F401
