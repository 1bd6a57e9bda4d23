"""Depth payloads, probe records and file selections as checked scans."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fathomline.functions.text import sample_aspect
from fathomline.plans.catalogue import first_failing

#: A raw depth payload: a map row by row, with its shape and the type that it was stored in.
RAW_DEPTH = "clip_id BIGINT, frame_idx INT, shape ARRAY<INT>, dtype STRING, `values` ARRAY<FLOAT>"
#: A metric payload: inverse depth, where it holds, and the focal length as a share of the width.
METRIC_DEPTH = "clip_id BIGINT, frame_idx INT, shape ARRAY<INT>, inverse_depth ARRAY<FLOAT>, valid ARRAY<BOOLEAN>, focal_x_normalized FLOAT"
#: What a probe reports of a video.
PROBE = "streams ARRAY<STRUCT<codec_type: STRING, codec_name: STRING, width: INT, height: INT, avg_frame_rate: STRING, nb_frames: STRING, sample_aspect_ratio: STRING>>"


def map_problem(shape: Column, values: Column, dtype: Column, native: tuple[int, int], stored: str | None) -> Column:
    """Why a payload isn't a map of the native shape and stored type (any type if None), else null."""
    checks = [
        ("not a map", F.size(shape) == 2),
        ("shape", (F.get(shape, F.lit(0)) == native[0]) & (F.get(shape, F.lit(1)) == native[1])),
        ("length", F.size(values) == native[0] * native[1]),
        ("type", F.lit(True) if stored is None else dtype == stored),
    ]
    return first_failing(checks)


def read_raw_depth(spark: SparkSession, path: str, native: tuple[int, int], stored: str | None = None) -> DataFrame:
    """Raw payloads under a path; the first one that isn't as stated ends the job. The check is part of the scan and reads nothing twice."""
    raw = spark.read.schema(RAW_DEPTH).parquet(path)
    problem = map_problem(F.col("shape"), F.col("values"), F.col("dtype"), native, stored)
    where = F.concat_ws(" ", problem, F.lit("of raw depth at"), F.col("clip_id"), F.col("frame_idx"))
    return raw.withColumn("values", F.when(problem.isNotNull(), F.raise_error(where).cast("array<float>")).otherwise(F.col("values")))


def read_metric_depth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC_DEPTH).parquet(path)


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    """Only the maps of raw payloads: the scan leaves the other columns unread."""
    return spark.read.schema(RAW_DEPTH).parquet(path).select("clip_id", "frame_idx", "values")


def probe_record(document: Column) -> Column:
    """width, height, fps, frame_count, duration, codec and sample aspect of the first video stream of a probe's report; null without one.

    A rate that can't be read or isn't positive is 0, and so is then the duration.
    """
    video = F.get(F.filter(F.from_json(document, PROBE, {"mode": "PERMISSIVE"})["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    part = lambda i: F.regexp_extract(video["avg_frame_rate"], r"^([0-9]+)/([0-9]+)$", i).try_cast("double")
    fps = F.coalesce(F.try_divide(part(1), part(2)), F.lit(0.0))
    frames = F.coalesce(video["nb_frames"].try_cast("long"), F.lit(0))
    n, d = sample_aspect(video["sample_aspect_ratio"])
    record = F.struct(video["width"].alias("width"), video["height"].alias("height"), fps.alias("fps"), frames.alias("frame_count"), F.coalesce(F.try_divide(frames, fps), F.lit(0.0)).alias("duration"), video["codec_name"].alias("codec"), n.alias("aspect_numerator"), d.alias("aspect_denominator"))
    return F.when(video.isNotNull(), record)


def _pattern(glob: str) -> str:
    """A glob that is matched from the right, as a regular expression: ``*`` and ``?`` stay inside a name."""
    signs = {"*": "[^/]*", "?": "[^/]"}
    return "(^|/)" + "".join(signs.get(p) or (p if p.startswith("[") else re.escape(p)) for p in re.findall(r"\[[^\]]+\]|.", glob, re.S)) + r"\z"


def is_kept(path: Column, patterns: list[str]) -> Column:
    """Whether one of the globs matches the path's last names."""
    kept = F.lit(False)
    for glob in patterns:
        kept = kept | path.rlike(_pattern(glob))
    return kept


def removable(files: DataFrame, path: str, folders: list[str], patterns: list[str]) -> DataFrame:
    """The files in intermediate folders that no pattern keeps. They are listed, not deleted."""
    inside = F.lit(False)
    for folder in folders:
        inside = inside | F.contains(F.concat(F.lit("/"), path), F.lit(f"/{folder}/"))
    return files.filter(inside & ~is_kept(F.col(path), patterns))
