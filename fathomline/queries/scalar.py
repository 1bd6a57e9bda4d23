"""Scalar transforms (P-*) and text, clock, hash and JSON functions (F-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.functions import depth, geometry, text
from fathomline.plans import settings
from fathomline.queries import FRAMES_SQL, PIXELS_SQL, SIDE, frames, pixels, query, table

_KIND = "CASE event_type WHEN 'click' THEN 'metric_depth' WHEN 'view' THEN 'inverse_depth' ELSE 'relative_depth' END"


@query("p01_depth_score", f"SELECT event_id, {_KIND} AS kind, CASE WHEN event_type = 'click' THEN CASE WHEN value > 0 THEN 1.0 / value END WHEN event_type = 'view' THEN value ELSE -value END AS score FROM events")
def p01(spark, sf):
    e = table(spark, sf, "events").withColumn("kind", F.expr(_KIND))
    return e.select("event_id", "kind", depth.score(F.col("value"), F.col("kind")).alias("score"))


@query("p03_code_round_trip", "SELECT event_id, CAST(round_even(greatest(0, least(1, value / 500.0)) * 65535, 0) AS INTEGER) AS code, CAST(round_even(greatest(0, least(1, value / 500.0)) * 65535, 0) AS INTEGER) / 65535.0::DOUBLE AS decoded FROM events")
def p03(spark, sf):
    e = table(spark, sf, "events").withColumn("code", depth.encode(F.col("value") / 500.0))
    return e.select("event_id", "code", depth.decode(F.col("code")).alias("decoded"))


@query("p04_frame_min_max", f"WITH {PIXELS_SQL} SELECT frame, \"row\", col, round(coalesce((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 0), 9) AS scaled FROM p WINDOW w AS (PARTITION BY frame)")
def p04(spark, sf):
    """Each image is one array, so its bounds need no shuffle."""
    low, high = F.array_min("v"), F.array_max("v")
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame"), F.transform(F.slice("embedding", 1, SIDE * SIDE), lambda x: x.cast("double")).alias("v"))
    scaled = F.transform("v", lambda x: F.round(F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0)), 9))
    return e.select("frame", F.posexplode(scaled).alias("i", "scaled")).select("frame", F.floor(F.col("i") / SIDE).cast("int").alias("row"), (F.col("i") % SIDE).cast("int").alias("col"), "scaled")


_CODE = "CASE WHEN event_id % 7 = 0 THEN 32768 ELSE event_id * 7919 % 65536 END"


@query("p05_midpoint_min_max", f"WITH {FRAMES_SQL}, c AS (SELECT clip_id, event_id, CAST({_CODE} AS INTEGER) AS code FROM f), m AS (SELECT *, min(CASE WHEN code <> 32768 THEN code END) OVER w AS lo, max(CASE WHEN code <> 32768 THEN code END) OVER w AS hi FROM c WINDOW w AS (PARTITION BY clip_id)) SELECT clip_id, event_id, code, CASE WHEN code = 32768 OR lo IS NULL OR lo = hi THEN 0.5::DOUBLE ELSE (code - lo)::DOUBLE / (hi - lo) END AS scaled FROM m")
def p05(spark, sf):
    from pyspark.sql import Window

    c = frames(spark, sf).select("clip_id", "event_id", F.expr(_CODE).cast("int").alias("code"))
    w, real = Window.partitionBy("clip_id"), F.when(F.col("code") != depth.MIDPOINT_CODE, F.col("code"))
    low, high = F.min(real).over(w), F.max(real).over(w)
    return c.select("clip_id", "event_id", "code", F.coalesce(F.try_divide((real - low).cast("double"), high - low), F.lit(0.5)).alias("scaled"))


@query("p06_affine_clip", "SELECT event_id, value / 200.0 * 0.5 + 0.125 AS fitted, greatest(0.0, least(1.0, value / 200.0 * 0.5 + 0.125)) AS clipped FROM events")
def p06(spark, sf):
    fitted = F.col("value") / 200.0 * 0.5 + 0.125
    return table(spark, sf, "events").select("event_id", fitted.alias("fitted"), depth.clip01(fitted).alias("clipped"))


@query("p07_metric_validity", "SELECT event_id, CASE WHEN value - 100 > 0 THEN CAST(1.0::DOUBLE / (value - 100) AS FLOAT)::DOUBLE END AS inverse, value - 100 > 0 AS valid FROM events")
def p07(spark, sf):
    e = table(spark, sf, "events").withColumn("inverse", depth.inverse_metric(F.col("value") - 100))
    return e.select("event_id", F.col("inverse").cast("double").alias("inverse"), F.col("inverse").isNotNull().alias("valid"))


@query("p08_p10_relative_lanes", "SELECT event_id, (value / 500.0 - 0.5) * (3.0 / 100.0) AS disparity, CAST(ceil((value / 500.0 - 0.5) * (3.0 / 100.0) * 1920 * 16 - 0.5) AS INTEGER) AS left_lanes, CAST(ceil((value / 500.0 - 0.5) * (3.0 / 100.0) * 1920 * -16 - 0.5) AS INTEGER) AS right_lanes FROM events")
def p08(spark, sf):
    d = depth.relative_disparity(F.col("value") / 500.0, 0.5, 3.0)
    return table(spark, sf, "events").select("event_id", d.alias("disparity"), depth.lane_offset(d * 1920).alias("left_lanes"), depth.lane_offset(d * 1920, -1).alias("right_lanes"))


@query("p09_metric_disparity", f"WITH {FRAMES_SQL}, d AS (SELECT clip_id, 0.8 / 0.9 * (63.0 / 1000.0) * (1.0 / value - 1.0 / 20.0) AS raw FROM f WHERE value > 0) SELECT clip_id, count(*) AS valid_count, CAST(count_if(abs(raw) > 0.002) AS BIGINT) AS clamped_count, round(sum(greatest(-0.002, least(0.002, raw)) * 0.9), 9) AS render_sum FROM d GROUP BY clip_id")
def p09(spark, sf):
    raw = depth.metric_disparity(F.lit(1.0) / F.col("value"), 0.8, 63.0, 20.0, 0.9)
    d = frames(spark, sf).filter("value > 0").select("clip_id", raw.alias("raw"))
    return d.groupBy("clip_id").agg(F.count(F.lit(1)).alias("valid_count"), F.count_if(F.abs("raw") > 0.002).alias("clamped_count"), F.round(F.sum(F.greatest(F.lit(-0.002), F.least(F.lit(0.002), F.col("raw"))) * 0.9), 9).alias("render_sum"))


@query("p11_fisheye_map", """WITH k AS (SELECT unnest(['stereographic', 'equidistant', 'equisolid', 'orthogonal']) AS kind), g AS (SELECT kind, CAST(i // 32 AS INTEGER) AS y, CAST(i % 32 AS INTEGER) AS x FROM k, range(32 * 24) AS r(i)),
t AS (SELECT *, atan2(y - 12.0, x - 16.0) AS a, sqrt((x - 16.0) * (x - 16.0) + (y - 12.0) * (y - 12.0)) / 12.0 * (radians(180.0) / 2) AS th FROM g),
r AS (SELECT *, CASE kind WHEN 'stereographic' THEN 24 * tan(th / 2) / tan(radians(180.0) / 4) WHEN 'equidistant' THEN 12 * th / (radians(180.0) / 2) WHEN 'equisolid' THEN 24 * sin(th / 2) / sin(radians(180.0) / 4) ELSE 12 * sin(th) / sin(radians(180.0) / 2) END AS rr FROM t)
SELECT kind, x, y, round(greatest(0.0, least(31.0, rr * cos(a) + 16.0)), 5) AS source_x, round(greatest(0.0, least(23.0, rr * sin(a) + 12.0)), 5) AS source_y FROM r""")
def p11(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ("stereographic", "equidistant", "equisolid", "orthogonal")])
    g = spark.range(32 * 24).select(F.explode(kinds).alias("kind"), F.floor(F.col("id") / 32).cast("int").alias("y"), (F.col("id") % 32).cast("int").alias("x"))
    sx, sy = geometry.project(F.col("x"), F.col("y"), 32, 24, 180.0, F.col("kind"))
    return g.select("kind", "x", "y", F.round(sx, 5).alias("source_x"), F.round(sy, 5).alias("source_y"))


@query("p17_map_region", """WITH r AS (SELECT o_orderkey, o_orderkey * 37 % 1900 AS x, o_custkey * 53 % 1000 AS y, o_orderkey % 300 AS w, o_custkey % 200 AS h FROM orders),
b AS (SELECT *, greatest(x, 96) AS ax, least(x + w, 1824) AS bx, greatest(y, 54) AS ay, least(y + h, 1026) AS cy FROM r)
SELECT o_orderkey, CASE WHEN ax < bx THEN CAST(greatest(0, least(floor((ax - 96) * 1280 / 1728.0::DOUBLE), 1280)) AS INTEGER) END AS x0, CASE WHEN ay < cy THEN CAST(greatest(0, least(floor((ay - 54) * 720 / 972.0::DOUBLE), 720)) AS INTEGER) END AS y0,
CASE WHEN ax < bx THEN CAST(greatest(0, least(ceil((bx - 96) * 1280 / 1728.0::DOUBLE), 1280)) AS INTEGER) END AS x1, CASE WHEN ay < cy THEN CAST(greatest(0, least(ceil((cy - 54) * 720 / 972.0::DOUBLE), 720)) AS INTEGER) END AS y1 FROM b""")
def p17(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderkey * 37 % 1900 AS x", "o_custkey * 53 % 1000 AS y", "o_orderkey % 300 AS w", "o_custkey % 200 AS h")
    bounds = geometry.map_region(F.col("x"), F.col("y"), F.col("w"), F.col("h"), (96, 54, 1824, 1026), (1280, 720))
    return o.select("o_orderkey", *[b.alias(n) for b, n in zip(bounds, ("x0", "y0", "x1", "y1"))])


@query("p18_fits_half", "SELECT o_orderpriority, bool_and(abs(o_totalprice) <= 65504) AS fits FROM orders GROUP BY o_orderpriority")
def p18(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(depth.fits_half(F.col("o_totalprice")).alias("fits"))


@query("p19_bounded_statistic", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 - 1e-9 < 0 THEN 0.0 WHEN l_discount * 10 - 1e-9 > 1 THEN 1.0 ELSE l_discount * 10 - 1e-9 END AS snapped FROM lineitem")
def p19(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", depth.bounded(F.col("l_discount") * 10 - 1e-9, 0.0, 1.0, 1e-6).alias("snapped"))


_SIZE = "SELECT p_partkey, CAST(p_size * 97 + 3 AS INTEGER) AS w, CAST(p_partkey * 61 % 2400 + 1 AS INTEGER) AS h FROM part"
_RATIO = "w / h::DOUBLE"


@query("p20_input_size", f"WITH s AS ({_SIZE}), m AS (SELECT *, w * h / 1e6 AS mp, greatest(w, h) AS l FROM s) SELECT p_partkey, w, h, CAST(CASE WHEN mp > 8 THEN least(l, 2160) WHEN mp > 2 THEN least(l, 1080) WHEN mp > 1 THEN least(l, 720) ELSE least(l, 640) END AS INTEGER) AS input_size FROM m")
def p20(spark, sf):
    s = table(spark, sf, "part").selectExpr("p_partkey", "CAST(p_size * 97 + 3 AS INT) AS w", "CAST(p_partkey * 61 % 2400 + 1 AS INT) AS h")
    return s.select("p_partkey", "w", "h", geometry.depth_input_size(F.col("w"), F.col("h")).alias("input_size"))


_PRESET_ROWS = ", ".join(f"('{k}', {w}, {h})" for k, (w, h) in geometry.PRESETS.items())


@query("p21_p22_auto_preset", f"""WITH s AS ({_SIZE}), c AS (SELECT *, CASE WHEN {_RATIO} >= 2.3 THEN 'ultra_wide' WHEN {_RATIO} >= 1.6 THEN 'wide' ELSE 'standard' END AS kind, CASE WHEN {_RATIO} >= 2 THEN 'over_under' ELSE 'side_by_side' END AS layout, w::BIGINT * h AS px FROM s),
a AS (SELECT *, CASE kind WHEN 'ultra_wide' THEN CASE WHEN px >= 8000000 THEN 'cinema-4k' ELSE 'cinema-2k' END WHEN 'wide' THEN CASE WHEN px >= 8000000 THEN '16x9-4k' WHEN px >= 2000000 THEN '16x9-1080p' ELSE '16x9-720p' END ELSE CASE WHEN px >= 8000000 THEN 'square-4k' WHEN px >= 2000000 THEN 'square-2k' ELSE 'square-1k' END END AS preset FROM c),
t(preset, ew, eh) AS (VALUES {_PRESET_ROWS})
SELECT p_partkey, kind, layout, preset, CASE WHEN layout = 'over_under' THEN ew ELSE ew * 2 END AS out_width, CASE WHEN layout = 'over_under' THEN eh * 2 ELSE eh END AS out_height FROM a JOIN t USING (preset)""")
def p22(spark, sf):
    s = table(spark, sf, "part").selectExpr("p_partkey", "CAST(p_size * 97 + 3 AS INT) AS w", "CAST(p_partkey * 61 % 2400 + 1 AS INT) AS h")
    ratio = geometry.aspect_ratio(F.col("w"), F.col("h"))
    s = s.select("p_partkey", geometry.aspect_class(ratio).alias("kind"), geometry.view_layout(ratio).alias("layout"), geometry.auto_preset(F.col("w"), F.col("h")).alias("preset"))
    out_w, out_h = geometry.stacked_size(F.col("eye_width"), F.col("eye_height"), F.col("layout"))
    return s.join(F.broadcast(geometry.presets(spark)), "preset").select("p_partkey", "kind", "layout", "preset", out_w.alias("out_width"), out_h.alias("out_height"))  # 19 rows


@query("p23_chunk_frames", f"WITH s AS ({_SIZE}), g AS (SELECT *, (w::DOUBLE * h * 12 + 518.0 * 518 * 4) / 1073741824 + 0.08 AS gb FROM s) SELECT p_partkey, round(gb, 9) AS frame_gb, CASE WHEN p_partkey % 12 * 0.7 - 2.5 <= 0 THEN 2 ELSE greatest(2, least(24, CAST(trunc((p_partkey % 12 * 0.7::DOUBLE - 2.5) / gb) AS INTEGER))) END AS chunk FROM g")
def p23(spark, sf):
    s = table(spark, sf, "part").selectExpr("p_partkey", "CAST(p_size * 97 + 3 AS INT) AS w", "CAST(p_partkey * 61 % 2400 + 1 AS INT) AS h")
    gb = geometry.frame_gb(F.col("w"), F.col("h"), F.lit(518), 0.08)
    usable = F.col("p_partkey") % 12 * F.lit(0.7) - 2.5
    return s.select("p_partkey", F.round(gb, 9).alias("frame_gb"), geometry.chunk_frames(usable, gb, 2, 24).alias("chunk"))


@query("p23_window_model_chunk_frames", f"WITH s AS ({_SIZE}), g AS (SELECT *, (w::DOUBLE * h * 12 + 518.0 * 518 * 4) / 1073741824 + 0.15 AS gb FROM s) SELECT p_partkey, round(gb, 9) AS frame_gb, CASE WHEN p_partkey % 12 * 0.7 - 3.25 <= 0 THEN 4 ELSE greatest(4, least(32, CAST(trunc((p_partkey % 12 * 0.7::DOUBLE - 3.25) / gb) AS INTEGER))) END AS chunk FROM g")
def p23_windows(spark, sf):
    """The other model: 0.15 GB more a frame, a model larger by 0.3, and bounds of 4 and 32."""
    s = table(spark, sf, "part").selectExpr("p_partkey", "CAST(p_size * 97 + 3 AS INT) AS w", "CAST(p_partkey * 61 % 2400 + 1 AS INT) AS h")
    gb = geometry.frame_gb(F.col("w"), F.col("h"), F.lit(518), 0.15)
    return s.select("p_partkey", F.round(gb, 9).alias("frame_gb"), geometry.chunk_frames(F.col("p_partkey") % 12 * F.lit(0.7) - 3.25, gb, 4, 32).alias("chunk"))


@query("p24_p25_sizes", f"WITH s AS ({_SIZE}) SELECT p_partkey, CAST(trunc(p_partkey * 2.0::DOUBLE * w * h * 0.1) AS BIGINT) AS video_bytes, CAST(trunc(p_partkey * 4000 / 60.0::DOUBLE) AS BIGINT) AS audio_bytes, CAST(trunc(p_partkey::DOUBLE * w * h * 4 * 1.25 + p_partkey::DOUBLE * w * h * 2 * 1.1) AS BIGINT) AS depth_bytes FROM s")
def p24(spark, sf):
    s = table(spark, sf, "part").selectExpr("p_partkey", "CAST(p_size * 97 + 3 AS INT) AS w", "CAST(p_partkey * 61 % 2400 + 1 AS INT) AS h")
    n, w, h = F.col("p_partkey").cast("double"), F.col("w"), F.col("h")
    return s.select("p_partkey", (n * 2.0 * w * h * 0.1).cast("long").alias("video_bytes"), (n * 4000 / 60.0).cast("long").alias("audio_bytes"), (n * w * h * 4 * 1.25 + n * w * h * 2 * 1.1).cast("long").alias("depth_bytes"))


@query("p26_setting_violations", "WITH s AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value FROM events) SELECT event_id, rule FROM (SELECT event_id, unnest([CASE WHEN k IS NULL OR k < 5 OR k > 90 THEN 'k range' END, CASE WHEN value > 100 THEN 'value range' END, CASE WHEN k > 50 AND value > 50 THEN 'k with value' END]) AS rule FROM s) WHERE rule IS NOT NULL")
def p26(spark, sf):
    s = table(spark, sf, "events").select("event_id", "value", F.get_json_object("props", "$.k").try_cast("int").alias("k"))
    bad = lambda ok, name: F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))
    rules = F.array(bad(F.col("k").between(5, 90), "k range"), bad(F.col("value") <= 100, "value range"), F.when((F.col("k") > 50) & (F.col("value") > 50), "k with value"))
    return s.select("event_id", F.explode(F.array_compact(rules)).alias("rule"))


_SETTINGS_DOC = """concat('{"convergence": ', format_string('%d.%d', k % 13 DIV 10, k % 13 % 10), ', "min_scene_frames": ', k % 5, ', "scene_detection": ', if(k % 7 = 0, '"yes"', 'true'), ', "stereo_geometry_mode": "', if(k % 3 = 0, 'metric_camera', 'relative'), '"', CASE k % 4 WHEN 0 THEN ', "temporal_postprocessor": "vdpp"' WHEN 1 THEN ', "temporal_postprocessor": "x"' WHEN 2 THEN ', "temporal_postprocessor": "off"' ELSE '' END, ', "target_fps": ', k % 200, if(k % 11 = 0, ', "surprise": 1', ''), if(k % 10 = 9, ', "baseline": 3', ''), if(k % 17 = 0, '', '}'))"""
_LOOSE = "[CASE WHEN k % 13 > 10 THEN 'convergence' END, CASE WHEN k % 7 = 0 THEN 'scene_detection' END, CASE WHEN k % 5 = 0 THEN 'min_scene_frames' END, CASE WHEN k % 4 = 1 THEN 'temporal_postprocessor' END, CASE WHEN k % 200 NOT BETWEEN 1 AND 120 THEN 'target_fps' END, CASE WHEN k % 3 = 0 AND k % 4 = 0 THEN 'vdpp with metric_camera' END]"
_STRICT = f"list_concat([CASE WHEN k % 10 = 9 THEN 'removed baseline' END, CASE WHEN k % 11 = 0 THEN 'unknown surprise' END], {_LOOSE})"


def _settings_documents(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").alias("k")).withColumn("doc", F.expr(_SETTINGS_DOC))


@query("p26_validated_settings", f"WITH o AS (SELECT o_orderkey, o_orderkey AS k FROM orders) SELECT o_orderkey, array_to_string(CASE WHEN k % 17 = 0 THEN ['unreadable'] ELSE list_filter({_STRICT}, lambda x: x IS NOT NULL) END, '; ') AS violations FROM o")
def p26_documents(spark, sf):
    """Settings documents built from order keys, held to the rules of all settings."""
    return settings.audit(_settings_documents(spark, sf), "doc").select("o_orderkey", F.array_join("violations", "; ").alias("violations"))


@query("f17_settings_migration", f"""WITH o AS (SELECT o_orderkey, o_orderkey AS k, coalesce(nullif(o_custkey % 6, 5), 1) AS version FROM orders),
v AS (SELECT *, CASE WHEN k % 17 = 0 THEN 'unreadable' WHEN version = 4 THEN list_filter({_STRICT}, lambda x: x IS NOT NULL)[1] ELSE list_filter({_LOOSE}, lambda x: x IS NOT NULL)[1] END AS bad FROM o),
p AS (SELECT *, CASE WHEN version < 1 THEN 'version below 1' ELSE coalesce(bad, CASE WHEN version = 4 AND k % 4 = 3 THEN 'temporal_postprocessor is missing' END) END AS problem FROM v)
SELECT o_orderkey, version AS source_version, version < 4 AS migrated, problem, CASE WHEN problem IS NULL THEN CAST(k % 5 AS VARCHAR) END AS min_scene_frames, CASE WHEN problem IS NULL THEN '63.0' END AS virtual_baseline_mm, CASE WHEN version < 4 AND k % 17 <> 0 THEN concat_ws(',', CASE WHEN k % 10 = 9 THEN 'baseline' END, CASE WHEN k % 11 = 0 THEN 'surprise' END) ELSE '' END AS removed FROM p""")
def f17_documents(spark, sf):
    """The same documents with versions: older ones lose keys and gain defaults, those of the present version are held to every rule."""
    d = _settings_documents(spark, sf).join(table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 6 < 5, F.col("o_custkey") % 6).alias("version")), "o_orderkey")
    m = settings.migrate(d, "doc", "version")
    return m.select("o_orderkey", "source_version", "migrated", "problem", F.col("settings")["min_scene_frames"].alias("min_scene_frames"), F.col("settings")["virtual_baseline_mm"].alias("virtual_baseline_mm"), F.array_join("removed_settings", ",").alias("removed"))


@query("p27_capable_requests", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority <> '5-LOW' AND o_custkey % 3 = 0")
def p27(spark, sf):
    """Requests that a backend can serve: mode, format and aspect tested against a small table of capabilities."""
    able = spark.createDataFrame([("F", 0), ("O", 0)], "o_orderstatus string, aspect int")
    o = table(spark, sf, "orders").withColumn("aspect", (F.col("o_custkey") % 3).cast("int"))
    return o.filter("o_orderpriority <> '5-LOW'").join(F.broadcast(able), ["o_orderstatus", "aspect"], "left_semi").select("o_orderkey")  # two rows


@query("f01_clock_seconds", "WITH c AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN CAST(l_orderkey % 60 AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) WHEN 1 THEN '1:' || CAST(l_linenumber AS VARCHAR) || ':30' ELSE CAST(l_orderkey AS VARCHAR) || 's' END AS t FROM lineitem) SELECT l_orderkey, l_linenumber, t, CAST(CASE WHEN len(string_split(t, ':')) = 2 THEN TRY_CAST(string_split(t, ':')[1] AS BIGINT) * 60 + TRY_CAST(string_split(t, ':')[2] AS BIGINT) WHEN len(string_split(t, ':')) = 3 THEN TRY_CAST(string_split(t, ':')[1] AS BIGINT) * 3600 + TRY_CAST(string_split(t, ':')[2] AS BIGINT) * 60 + TRY_CAST(string_split(t, ':')[3] AS BIGINT) END AS BIGINT) AS seconds FROM c")
def f01(spark, sf):
    t = F.expr("CASE l_linenumber % 3 WHEN 0 THEN CAST(l_orderkey % 60 AS STRING) || ':' || CAST(l_linenumber AS STRING) WHEN 1 THEN '1:' || CAST(l_linenumber AS STRING) || ':30' ELSE CAST(l_orderkey AS STRING) || 's' END")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", t.alias("t"), text.clock_seconds(t).alias("seconds"))


@query("f02_frame_range", "WITH r AS (SELECT o_orderkey, o_custkey % 900 + 2 AS total, least(CAST(trunc((o_orderkey % 5 * 60 + 7) * 29.97::DOUBLE) AS BIGINT), o_custkey % 900 + 1) AS a, CAST(trunc((o_orderkey % 7 * 60 + 3) * 29.97::DOUBLE) AS BIGINT) AS b FROM orders) SELECT o_orderkey, greatest(0, a) AS first_frame, greatest(greatest(0, a) + 1, least(b, total)) AS end_frame FROM r")
def f02(spark, sf):
    o = table(spark, sf, "orders").withColumns({"total": F.col("o_custkey") % 900 + 2, "s": F.format_string("%d:07", F.col("o_orderkey") % 5), "e": F.format_string("%d:03", F.col("o_orderkey") % 7)})
    first, end = text.frame_range(F.col("total"), F.lit(29.97), F.col("s"), F.col("e"))
    return o.select("o_orderkey", first.alias("first_frame"), end.alias("end_frame"))


@query("f03_f10_frame_names", "SELECT event_id, printf('frame_%06d.png', event_id) AS frame_name, CAST(CASE WHEN event_id % 2 = 0 THEN event_id END AS INTEGER) AS strict_index FROM events")
def f03(spark, sf):
    name = text.frame_name(F.col("event_id"))
    asked = F.when(F.col("event_id") % 2 == 0, name).otherwise(F.concat(F.lit("x"), name))
    return table(spark, sf, "events").select("event_id", name.alias("frame_name"), text.frame_index(asked).alias("strict_index"))


@query("f04_safe_names", r"""SELECT page_id, trim(regexp_replace(regexp_replace(url, '[<>:"/\\|?*]', '_', 'g'), '_+', '_', 'g'), '_') AS safe, trim(regexp_replace(regexp_replace(url, '[<>:"/\\|?*]', '_', 'g'), '_+', '_', 'g'), '_') || '_3D_side-by-side_1080p.mp4' AS output FROM pages""")
def f04(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.safe_name(F.col("url")).alias("safe"), text.output_name(F.col("url"), F.lit("side_by_side"), F.lit("1080p")).alias("output"))


@query("f05_size_texts", "WITH s AS (SELECT o_orderkey, o_orderkey * o_orderkey * 977 AS b FROM orders) SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0::DOUBLE) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0::DOUBLE) WHEN b < 1099511627776 THEN printf('%.1f GB', b / 1073741824.0::DOUBLE) ELSE printf('%.1f TB', b / 1099511627776.0::DOUBLE) END AS size_text FROM s")
def f05(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", text.size_text(F.col("o_orderkey") * F.col("o_orderkey") * 977).alias("size_text"))


@query("f06_durations", "WITH s AS (SELECT o_orderkey, CAST(floor(o_totalprice / 20) AS BIGINT) AS s FROM orders) SELECT o_orderkey, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS clock, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' END AS remaining FROM s")
def f06(spark, sf):
    s = F.col("o_totalprice") / 20
    return table(spark, sf, "orders").select("o_orderkey", text.clock_text(s).alias("clock"), text.remaining_text(s).alias("remaining"))


@query("f07_sample_aspect", "WITH a AS (SELECT p_partkey, p_size * 4 AS n, p_partkey % 50 AS d FROM part) SELECT p_partkey, CASE WHEN p_partkey % 10 = 3 THEN 1 WHEN n > 0 AND d > 0 THEN n // gcd(n, d) END::BIGINT AS numerator, CASE WHEN p_partkey % 10 = 3 THEN 1 WHEN n > 0 AND d > 0 THEN d // gcd(n, d) END::BIGINT AS denominator FROM a")
def f07(spark, sf):
    t = F.when(F.col("p_partkey") % 10 == 3, F.lit("N/A")).otherwise(F.concat_ws(":", F.col("p_size") * 4, F.col("p_partkey") % 50))
    n, d = text.sample_aspect(t)
    return table(spark, sf, "part").select("p_partkey", n.alias("numerator"), d.alias("denominator"))


@query("f08_custom_sizes", "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 AND p_size * 300 BETWEEN 1 AND 10000 AND p_partkey BETWEEN 1 AND 10000 THEN p_size * 300 END::INTEGER AS width, CASE WHEN p_partkey % 4 <> 0 AND p_size * 300 BETWEEN 1 AND 10000 AND p_partkey BETWEEN 1 AND 10000 THEN p_partkey END::INTEGER AS height FROM part")
def f08(spark, sf):
    t = F.concat(F.when(F.col("p_partkey") % 4 == 0, "size:").otherwise("custom:"), (F.col("p_size") * 300).cast("string"), F.lit("x"), F.col("p_partkey").cast("string"))
    w, h = text.custom_size(t)
    return table(spark, sf, "part").select("p_partkey", w.alias("width"), h.alias("height"))


@query("f09_frame_rate", "SELECT p_partkey, CAST(coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_size END, CASE WHEN p_partkey % 5 = 0 THEN 24 END, 30) AS INTEGER) AS fps FROM part")
def f09(spark, sf):
    positive = lambda c: F.when(c > 0, c)
    asked, stream = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size")), F.when(F.col("p_partkey") % 5 == 0, F.lit(24))
    return table(spark, sf, "part").select("p_partkey", F.coalesce(positive(asked), positive(stream), F.lit(30)).cast("int").alias("fps"))


@query("f11_document_hash", """SELECT event_id, sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS document_hash FROM events""")
def f11(spark, sf):
    return table(spark, sf, "events").select("event_id", text.document_hash([F.col("event_type"), F.col("user_id")]).alias("document_hash"))


@query("f11_f12_canonical_hashes")
def f12(spark, sf):
    """Hashes that need a Python function: canonical JSON, and samples of contents (here of page bodies)."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), text.canonical_hash(F.col("props")).alias("hash"))
    p = table(spark, sf, "pages").select(F.col("page_id").alias("id"), text.content_sample_hash(F.encode("html", "UTF-8")).alias("hash"))
    return e.withColumn("of", F.lit("props")).unionByName(p.withColumn("of", F.lit("page")))


@query("f13_sequence_hash", "SELECT o_custkey, sha256(string_agg(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority || chr(10), '' ORDER BY o_orderkey)) AS sequence_hash FROM orders GROUP BY o_custkey")
def f13(spark, sf):
    item = F.struct("o_orderkey", F.concat(F.concat_ws("|", "o_orderkey", "o_orderstatus", "o_orderpriority"), F.lit("\n")).alias("t"))
    every = F.array_sort(F.collect_list(item))  # one customer's orders
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.sha2(F.array_join(F.transform(every, lambda x: x["t"]), ""), 256).alias("sequence_hash"))


@query("f14_array_hashes", "SELECT page_id, sha256('url<u1[' || octet_length(encode(url)) || ']' || url || 'values<u1[1, ' || octet_length(encode(html)) || ']' || html) AS payload_hash FROM pages")
def f14(spark, sf):
    """An address and a page's bytes as two named arrays."""
    item = lambda name, c, *shape: F.struct(F.lit(name).alias("name"), F.lit("<u1").alias("dtype"), F.array(*shape).alias("shape"), F.encode(c, "UTF-8").alias("body"))
    arrays = F.array(item("values", "html", F.lit(1), F.octet_length("html")), item("url", "url", F.octet_length("url")))
    return table(spark, sf, "pages").select("page_id", text.array_payload_hash(arrays).alias("payload_hash"))


@query("f15_cache_keys")
def f15(spark, sf):
    """Keys of BLAKE2b, which SQL lacks: each event's type as the content's fingerprint, and a document of two settings."""
    doc = F.to_json(F.struct(F.col("user_id").alias("seed"), F.col("event_type").alias("device")))
    return table(spark, sf, "events").select("event_id", text.cache_key(F.col("event_type"), doc).alias("cache_key"))


@query("f16_summaries", "SELECT p_partkey, concat_ws(', ', CASE WHEN p_size > 10 THEN 'size ' || p_size END, CASE WHEN p_retailprice > 1000 THEN 'dear' END, p_type) AS summary, coalesce(TRY_CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER), 0) AS number FROM part")
def f16(spark, sf):
    parts = F.concat_ws(", ", F.when(F.col("p_size") > 10, F.concat(F.lit("size "), F.col("p_size"))), F.when(F.col("p_retailprice") > 1000, "dear"), "p_type")
    return table(spark, sf, "part").select("p_partkey", parts.alias("summary"), F.coalesce(F.regexp_extract("p_brand", "[0-9]+", 0).try_cast("int"), F.lit(0)).alias("number"))


@query("f17_migrated_settings", "SELECT event_id, 4 AS schema_version, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k, 'side_by_side' AS layout FROM events WHERE event_id % 6 <= 4")
def f17(spark, sf):
    """Settings of versions 0 to 4 moved to version 4: unknown keys go, missing ones get defaults; newer versions are turned away."""
    old = table(spark, sf, "events").withColumns({"version": F.col("event_id") % 6, "s": F.from_json("props", "k INT, layout STRING", {"mode": "PERMISSIVE"})})
    return old.filter("version <= 4").select("event_id", F.lit(4).alias("schema_version"), F.coalesce("s.k", F.lit(0)).alias("k"), F.coalesce("s.layout", F.lit("side_by_side")).alias("layout"))
