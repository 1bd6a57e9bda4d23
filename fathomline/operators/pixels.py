"""Operators on pixel rows (frame, row, col, value ...): crops, resampling, splatting, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fathomline.functions.depth import LANES
from fathomline.functions.geometry import center_crop, square_crop


def crop_center(df: DataFrame, width: int, height: int, factor: float) -> DataFrame:
    """The rows inside the centred crop, numbered from 0 again. With a factor of 1 nothing is done."""
    if factor >= 1:
        return df
    (x0, x1), (y0, y1) = center_crop(width, factor), center_crop(height, factor)
    return df.filter(F.col("col").between(x0, x1 - 1) & F.col("row").between(y0, y1 - 1)).withColumns({"col": F.col("col") - x0, "row": F.col("row") - y0})


def crop_square(df: DataFrame, width: int, height: int, factor: float) -> DataFrame:
    """The rows inside the square around the inscribed circle; all rows where that is empty."""
    x0, y0, x1, y1 = square_crop(width, height, factor)
    if x1 <= x0 or y1 <= y0:
        return df
    return df.filter(F.col("col").between(x0, x1 - 1) & F.col("row").between(y0, y1 - 1)).withColumns({"col": F.col("col") - x0, "row": F.col("row") - y0})


def crop_square_to(df: DataFrame, width: int, height: int, factor: float, target_width: int, target_height: int, by: list[str], value: str) -> DataFrame:
    """The square around the inscribed circle, brought to a size by bilinear means of places with aligned areas: by, out_row, out_col, out."""
    x0, y0, x1, y1 = square_crop(width, height, factor)
    size = (x1 - x0, y1 - y0) if x1 > x0 and y1 > y0 else (width, height)
    grid = target_grid(df.sparkSession, target_width, target_height)
    tapped = taps(grid, resize_coordinates(F.col("out_col"), size[0], target_width), resize_coordinates(F.col("out_row"), size[1], target_height), *size, "edge")
    return sample(crop_square(df, width, height, factor), tapped, by, F.col(value))


def side_by_side(left: DataFrame, right: DataFrame, width: int, height: int, layout: str = "side_by_side") -> DataFrame:
    """Both eyes in one frame; an unknown layout is side by side."""
    moved = right.withColumn("row", F.col("row") + height) if layout == "over_under" else right.withColumn("col", F.col("col") + width)
    return left.unionByName(moved)


def _reflect(i: Column, n: int) -> Column:
    """Index beyond an edge mirrored at it, the edge itself not repeated."""
    if n == 1:
        return F.lit(0)
    low = F.abs(i)
    return F.when(low >= n, 2 * (n - 1) - low).otherwise(low)


def taps(targets: DataFrame, x: Column, y: Column, width: int, height: int, border: str) -> DataFrame:
    """Four source places (tx, ty) and weights for each target. ``border``: reflect, or edge (clamped coordinates)."""
    if border == "edge":
        x, y = F.greatest(F.lit(0.0), F.least(F.lit(float(width - 1)), x)), F.greatest(F.lit(0.0), F.least(F.lit(float(height - 1)), y))
    fx, fy = F.floor(x).cast("int"), F.floor(y).cast("int")
    wx, wy = x - fx, y - fy
    place = (lambda i, n: F.least(i, F.lit(n - 1))) if border == "edge" else _reflect
    four = [F.struct(place(fx + dx, width).alias("tx"), place(fy + dy, height).alias("ty"), ((wx if dx else 1 - wx) * (wy if dy else 1 - wy)).alias("weight")) for dy in (0, 1) for dx in (0, 1)]
    return targets.withColumn("__t", F.explode(F.array(*four))).withColumns({k: F.col("__t")[k] for k in ("tx", "ty", "weight")}).drop("__t").filter("weight > 0")


def sample(source: DataFrame, tapped: DataFrame, by: list[str], value: Column, valid: Column | None = None) -> DataFrame:
    """Weighted means of the source at the taps: out, and with ``valid`` the total weight of valid places (out is 0 where that is under 0.5).

    The taps are the same for every frame and few, so they are sent to all tasks; frames are not shuffled before the sum.
    """
    hit = source.join(F.broadcast(tapped), (F.col("row") == F.col("ty")) & (F.col("col") == F.col("tx")))
    if valid is None:
        return hit.groupBy(*by, "out_row", "out_col").agg(F.sum(F.col("weight") * value).alias("out"))
    weight = F.sum(F.when(valid, F.col("weight")).otherwise(0.0))
    out = hit.groupBy(*by, "out_row", "out_col").agg(weight.alias("valid_weight"), F.sum(F.when(valid, F.col("weight") * value).otherwise(0.0)).alias("__s"))
    return out.withColumn("out", F.when(F.col("valid_weight") >= 0.5, F.col("__s") / F.col("valid_weight")).otherwise(0.0)).drop("__s")


def target_grid(spark, width: int, height: int) -> DataFrame:
    n = spark.range(width * height)
    return n.select(F.floor(F.col("id") / width).cast("int").alias("out_row"), (F.col("id") % width).cast("int").alias("out_col"))


def resize_coordinates(index: Column, source: int, target: int) -> Column:
    """Source coordinate of a target index when pixel areas, not corners, are aligned."""
    return (index + 0.5) * (source / target) - 0.5


def splat(df: DataFrame, row: list[str], col: str, width: int, offset: Column, near: Column, payload: list[str], valid: Column) -> DataFrame:
    """Every pixel covers its lanes, moved by ``offset``; each lane keeps the nearest pixel, ties go to the lowest column.

    The winner is a maximum of (near, -col) with its payload, combined map-side: one row a lane and task is shuffled.
    """
    lanes = df.filter(valid).withColumn("lane", F.explode(F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda k: F.col(col) * LANES + k + offset)))
    inside = lanes.filter((F.col("lane") >= 0) & (F.col("lane") < width * LANES))
    best = F.max_by(F.struct(F.col(col).alias("source"), *payload), F.struct(near.alias("n"), (-F.col(col)).alias("c")))
    return inside.groupBy(*row, "lane").agg(best.alias("w")).select(*row, "lane", "w.*")


def lane_mean(df: DataFrame, row: list[str], lane: str, value: str, hole: str) -> DataFrame:
    """Pixels from lanes: mean value, whether any lane was valid, whether all were holes."""
    return df.groupBy(*row, F.floor(F.col(lane) / LANES).cast("int").alias("col")).agg(F.avg(value).alias("mean_value"), F.bool_or(~F.col(hole)).alias("any_valid"), F.bool_and(F.col(hole)).alias("all_hole"))


def edge_mask(df: DataFrame, frame: str, value: str, least: float, reach: int) -> DataFrame:
    """Whether a 3x3 neighbourhood spans at least ``least`` anywhere within ``reach`` of a pixel: separable window maxima."""
    across, down = Window.partitionBy(frame, "row").orderBy("col"), Window.partitionBy(frame, "col").orderBy("row")
    near = lambda w, n: w.rowsBetween(-n, n)
    df = df.withColumns({"__h": F.max(value).over(near(across, 1)), "__l": F.min(value).over(near(across, 1))})
    df = df.withColumn("__e", F.max("__h").over(near(down, 1)) - F.min("__l").over(near(down, 1)) >= least)
    df = df.withColumn("__e", F.max(F.col("__e")).over(near(across, reach)))
    return df.withColumn("is_edge", F.max(F.col("__e")).over(near(down, reach))).drop("__h", "__l", "__e")
