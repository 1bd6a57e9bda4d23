"""Pixel operators (P-12 to P-16, J-08, W-10, W-12) on 8 x 8 images."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.functions import depth
from fathomline.operators import pixels as px
from fathomline.queries import PIXELS_SQL, SIDE, pixels, query


@query("p12_center_crop", f"WITH {PIXELS_SQL} SELECT frame, \"row\" - 1 AS \"row\", col - 1 AS col, v FROM p WHERE \"row\" BETWEEN 1 AND 6 AND col BETWEEN 1 AND 6")
def p12(spark, sf):
    return px.crop_center(pixels(spark, sf), SIDE, SIDE, 0.75).select("frame", "row", "col", "v")


@query("p13_square_crop", f"WITH {PIXELS_SQL} SELECT frame, \"row\" - 2 AS \"row\", col - 2 AS col, v FROM p WHERE \"row\" BETWEEN 2 AND 5 AND col BETWEEN 2 AND 5")
def p13(spark, sf):
    return px.crop_square(pixels(spark, sf), SIDE, SIDE, 0.6).select("frame", "row", "col", "v")


@query("p13_square_crop_resized", f"""WITH {PIXELS_SQL}, q AS (SELECT frame, "row" - 2 AS r, col - 2 AS c, v FROM p WHERE "row" BETWEEN 2 AND 5 AND col BETWEEN 2 AND 5),
g AS (SELECT i // 6 AS out_row, i % 6 AS out_col, greatest(0.0::DOUBLE, least(3.0::DOUBLE, (i // 6 + 0.5::DOUBLE) * (4 / 6.0::DOUBLE) - 0.5)) AS y, greatest(0.0::DOUBLE, least(3.0::DOUBLE, (i % 6 + 0.5::DOUBLE) * (4 / 6.0::DOUBLE) - 0.5)) AS x FROM range(36) AS r(i)),
t AS (SELECT CAST(out_row AS INTEGER) AS out_row, CAST(out_col AS INTEGER) AS out_col, least(3, CAST(floor(y) AS INTEGER) + dy) AS ty, least(3, CAST(floor(x) AS INTEGER) + dx) AS tx, (CASE WHEN dx = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE WHEN dy = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS wt FROM g, range(2) AS a(dx), range(2) AS b(dy))
SELECT frame, out_row, out_col, round(sum(wt * v), 8) AS v FROM q JOIN t ON r = ty AND c = tx WHERE wt > 0 GROUP BY ALL""")
def p13_resized(spark, sf):
    """The square around the inscribed circle, enlarged from 4 x 4 to 6 x 6."""
    out = px.crop_square_to(pixels(spark, sf), SIDE, SIDE, 0.6, 6, 6, ["frame"], "v")
    return out.select("frame", "out_row", "out_col", F.round("out", 8).alias("v"))


@query("p14_assembled_views", f"WITH {PIXELS_SQL} SELECT frame, \"row\", col, v FROM p UNION ALL SELECT frame, \"row\", col + 8, -v FROM p")
def p14(spark, sf):
    left = pixels(spark, sf).select("frame", "row", "col", "v")
    return px.side_by_side(left, left.withColumn("v", -F.col("v")), SIDE, SIDE)


@query("p14_stacked_views", f"WITH {PIXELS_SQL} SELECT frame, \"row\", col, v FROM p UNION ALL SELECT frame, \"row\" + 8, col, -v FROM p")
def p14_over_under(spark, sf):
    left = pixels(spark, sf).select("frame", "row", "col", "v")
    return px.side_by_side(left, left.withColumn("v", -F.col("v")), SIDE, SIDE, "over_under")


_TAPS = """g AS (SELECT CAST(i // {n} AS INTEGER) AS out_row, CAST(i % {n} AS INTEGER) AS out_col FROM range({n} * {n}) AS r(i)),
c AS (SELECT out_row, out_col, {x} AS x, {y} AS y FROM g),
t AS (SELECT out_row, out_col, {place_x} AS tx, {place_y} AS ty, (CASE WHEN dx = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE WHEN dy = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS wt FROM c, range(2) AS a(dx), range(2) AS b(dy))"""
_EDGE = _TAPS.format(n=5, x="greatest(0.0, least(7.0, (out_col + 0.5::DOUBLE) * 1.6 - 0.5))", y="greatest(0.0, least(7.0, (out_row + 0.5::DOUBLE) * 1.6 - 0.5))", place_x="least(7, CAST(floor(x) AS INTEGER) + dx)", place_y="least(7, CAST(floor(y) AS INTEGER) + dy)")


def _resize_taps(spark):
    grid = px.target_grid(spark, 5, 5)
    return px.taps(grid, _source_place("out_col"), _source_place("out_row"), SIDE, SIDE, "edge")


def _source_place(name):
    return px.resize_coordinates(F.col(name), SIDE, 5)


@query("p15_bilinear_resize", f"WITH {PIXELS_SQL}, {_EDGE} SELECT frame, out_row, out_col, round(sum(wt * v), 8) AS v FROM p JOIN t ON \"row\" = ty AND col = tx WHERE wt > 0 GROUP BY ALL")
def p15(spark, sf):
    out = px.sample(pixels(spark, sf), _resize_taps(spark), ["frame"], F.col("v"))
    return out.select("frame", "out_row", "out_col", F.round("out", 8).alias("v"))


@query("p16_weighted_resize", f"WITH {PIXELS_SQL}, {_EDGE}, s AS (SELECT frame, out_row, out_col, sum(CASE WHEN v > 0 THEN wt ELSE 0 END) AS w, sum(CASE WHEN v > 0 THEN wt * v ELSE 0 END) AS sv FROM p JOIN t ON \"row\" = ty AND col = tx WHERE wt > 0 GROUP BY ALL) SELECT frame, out_row, out_col, round(w, 8) AS valid_weight, round(CASE WHEN w >= 0.5 THEN sv / w ELSE 0 END, 8) AS v FROM s")
def p16(spark, sf):
    out = px.sample(pixels(spark, sf), _resize_taps(spark), ["frame"], F.col("v"), F.col("v") > 0)
    return out.select("frame", "out_row", "out_col", F.round("valid_weight", 8).alias("valid_weight"), F.round("out", 8).alias("v"))


_REFLECT = "CASE WHEN abs({0}) > 7 THEN 14 - abs({0}) ELSE abs({0}) END"
_REMAP = _TAPS.format(n=8, x="out_col * 1.1::DOUBLE - 0.7", y="out_row * 1.1::DOUBLE - 0.7", place_x=_REFLECT.format("CAST(floor(x) AS INTEGER) + dx"), place_y=_REFLECT.format("CAST(floor(y) AS INTEGER) + dy"))


@query("j08_remap", f"WITH {PIXELS_SQL}, {_REMAP} SELECT frame, out_row, out_col, round(sum(wt * v), 8) AS v FROM p JOIN t ON \"row\" = ty AND col = tx WHERE wt > 0 GROUP BY ALL")
def j08(spark, sf):
    """Bilinear samples at fractional places, mirrored at the edges."""
    grid = px.target_grid(spark, SIDE, SIDE)
    x = lambda n: F.col(n) * F.lit(1.1) - 0.7
    out = px.sample(pixels(spark, sf), px.taps(grid, x("out_col"), x("out_row"), SIDE, SIDE, "reflect"), ["frame"], F.col("v"))
    return out.select("frame", "out_row", "out_col", F.round("out", 8).alias("v"))


@query("w10_splat", f"""WITH {PIXELS_SQL}, l AS (SELECT frame, "row", col, v, col * 16 + k + CAST(ceil(v * 4 * 16 - 0.5) AS INTEGER) AS lane FROM p, range(16) AS r(k) WHERE col % 5 <> 4)
SELECT frame, "row", CAST(lane AS INTEGER) AS lane, arg_max(col, {{'n': v, 'c': -col}}) AS source, max(v) AS v FROM l WHERE lane BETWEEN 0 AND 127 GROUP BY frame, "row", lane""")
def w10(spark, sf):
    """Pixels pushed sideways by their value; in each lane the nearest wins."""
    out = px.splat(pixels(spark, sf), ["frame", "row"], "col", SIDE, depth.lane_offset(F.col("v") * 4), F.col("v"), ["v"], F.col("col") % 5 != 4)
    return out.select("frame", "row", F.col("lane").cast("int").alias("lane"), "source", "v")


@query("w12_edge_mask", f"""WITH {PIXELS_SQL}, h AS (SELECT *, max(v) OVER a AS hi, min(v) OVER a AS lo FROM p WINDOW a AS (PARTITION BY frame, "row" ORDER BY col ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
e AS (SELECT frame, "row", col, max(hi) OVER d - min(lo) OVER d >= 0.45 AS e FROM h WINDOW d AS (PARTITION BY frame, col ORDER BY "row" ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
x AS (SELECT *, bool_or(e) OVER (PARTITION BY frame, "row" ORDER BY col ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS ex FROM e)
SELECT frame, "row", col, bool_or(ex) OVER (PARTITION BY frame, col ORDER BY "row" ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS is_edge FROM x""")
def w12(spark, sf):
    return px.edge_mask(pixels(spark, sf), "frame", "v", 0.45, 1).select("frame", "row", "col", "is_edge")


@query("d08_rendered_rows", f"""WITH {PIXELS_SQL}, l AS (SELECT frame, "row", col, v, col * 16 + k + CAST(ceil(v * 2 * 16 - 0.5) AS INTEGER) AS lane FROM p, range(16) AS r(k)),
w AS (SELECT frame, "row", lane, max(v) AS v FROM l WHERE lane BETWEEN 0 AND 127 GROUP BY ALL)
SELECT frame, "row", CAST(lane // 16 AS INTEGER) AS col, round(avg(v), 8) AS mean_value, count(*) AS lanes FROM w GROUP BY ALL""")
def d08(spark, sf):
    """One eye rendered: offsets, splat, and pixels from lanes, composed of the operators."""
    lanes = px.splat(pixels(spark, sf), ["frame", "row"], "col", SIDE, depth.lane_offset(F.col("v") * 2), F.col("v"), ["v"], F.lit(True))
    return lanes.groupBy("frame", "row", F.floor(F.col("lane") / 16).cast("int").alias("col")).agg(F.round(F.avg("v"), 8).alias("mean_value"), F.count(F.lit(1)).alias("lanes"))
