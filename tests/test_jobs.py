"""Summaries of jobs, advice on resuming, disk bounds, sidecars, and crops that are resized."""

import json
import math

import pytest
from pyspark.sql import functions as F

from fathomline.functions import geometry
from fathomline.operators import pixels
from fathomline.plans import jobs

FILE = "job_id int, folder string, name string, width int, height int"


def summary(spark, variant, *files):
    rows = [(1, *f, *([None] * (4 - len(f)))) for f in files]
    r = jobs.summaries(spark.createDataFrame(rows, FILE), variant).first()
    return r.highest_stage, r.frame_count, r.resolution, r.vr_format, r.has_audio, r.settings_summary


def test_two_ways_to_count(spark):
    files = [("00_original_frames", f"f_{i}.png", 64, 48) for i in range(5)] + [("04_left_frames", "a.png", 32, 24), ("04_left_frames", "b.jpg"), ("04_right_frames", "a.png", 8, 8), ("04_right_frames", "b.png"), ("04_right_frames", "c.png"), ("", "original_audio.flac"), ("odd", "x.png", 1, 1)]
    assert summary(spark, "most", *files) == ("Stereo left frames", 5, "32x24", "unknown", True, "unknown")
    assert summary(spark, "highest", *files) == ("Stereo left frames", 2, "32x24", "unknown", True, "unknown")
    assert summary(spark, "most", ("00_original_frames", "a.png", 64, 48)) == ("none", 1, "64x48", "unknown", False, "unknown")
    assert summary(spark, "highest", ("00_original_frames", "a.png", 64, 48)) == ("none", 0, "unknown", "unknown", False, "unknown")
    assert summary(spark, "highest", ("05_left_distorted", "a.jpg"))[:2] == ("Distorted left frames", 1) and summary(spark, "most", ("05_left_distorted", "a.jpg"))[:2] == ("none", 0)
    with pytest.raises(ValueError):
        summary(spark, "other", ("", "x"))


@pytest.mark.parametrize("w, h, most, highest", [(400, 100, "side_by_side", "side_by_side"), (100, 400, "over_under", "over_under"), (100, 100, "over_under", "square"), (150, 100, "over_under", "square")])
def test_views_by_their_shape(spark, w, h, most, highest):
    files = [("99_vr_frames", "b.png", 1, 1), ("99_vr_frames", "a.png", w, h), ("", "clip.mp4")]
    assert summary(spark, "most", *files) == ("Final VR frames", 2, f"{w}x{h}", most, True, f"{most}, {w}x{h}")
    assert summary(spark, "highest", *files)[3] == highest


def test_advice(spark):
    doc = lambda s: json.dumps({"metadata": {"processing_status": s}})
    rows = [(1, None), (2, "{"), (3, doc("completed")), (4, doc("paused")), (5, doc("failed")), (6, doc("in_progress")), (7, doc("odd")), (8, "[]")]
    files = [(4, "99_vr_frames", "a.png"), (4, "03_disparity_maps", "a.png"), (4, "03_disparity_maps", "b.png"), (5, "03_disparity_maps", "b.png"), (6, "03_disparity_maps", "b.txt"), (3, "99_vr_frames", "a.png")]
    got = {r.job_id: tuple(r)[1:] for r in jobs.advice(spark.createDataFrame(rows, "job_id int, document string"), spark.createDataFrame(files, "job_id int, folder string, name string")).collect()}
    no = (False, 0, False)
    assert got == {
        1: (*no, "No settings file found - cannot resume"), 2: (*no, "Could not load settings file"), 3: (*no, "Processing already completed"), 8: (*no, "Could not load settings file"),
        4: (True, 1, True, "Found 1 processed frames - can resume from where left off"), 5: (True, 1, True, "Found 1 processed frames - can resume from where left off"),
        6: (True, 0, False, "No processed frames found - will restart from beginning"), 7: (*no, None),
    }


def test_disk_bounds(spark):
    one = lambda c: spark.range(1).select(c.alias("b")).first().b
    lit = F.lit
    assert one(jobs.map_bytes(lit(10), lit(20), lit(30), lit(4), lit(True))) == int(10 * 600 * 4 * 1.25 + 10 * 600 * 2 * 1.1)
    assert one(jobs.map_bytes(lit(10), lit(20), lit(30), lit(4), lit(False))) == int(10 * 600 * 4 * 1.25 + 2 * 600 * 4)
    frames = spark.createDataFrame([(48, 64, 512), (24, 33, 8192)], "h int, w int, u int")
    pay = [5 * 48 * 64, 5 * 24 * 33]
    want = (5 * sum(pay) + 3) // 4 + max(16 << 20, 8192 * 2) + (5 * max(pay) + 3) // 4 + 8192
    assert frames.agg(jobs.metric_bytes(F.col("h"), F.col("w"), F.col("u")).alias("b")).first().b == want
    assert frames.filter("h < 0").agg(jobs.metric_bytes(F.col("h"), F.col("w"), F.col("u")).alias("b")).first().b == 0
    png = math.ceil(48 * 64 * 2 * 1.1)
    assert one(jobs.stabilized_bytes(lit(7), lit(3), lit(48), lit(64))) == math.ceil(1.10 * (7 * png + 3 * 48 * 64 * 4 + png + (1 << 20)))


def test_sidecars_are_counted_again(spark):
    good = {"schema_version": 1, "frame_name": "a", "valid_pixel_count": 3, "clamped_pixel_count": 1, "clamped_fraction": 1 / 3}
    cases = {"a": (good, None), "b": ({**good, "frame_name": "b", "clamped_fraction": 0.34}, "fraction"), "c": ({**good, "frame_name": "x"}, "identity"), "d": ({**good, "frame_name": "d", "clamped_pixel_count": 4}, "counts"), "e": ({**good, "frame_name": "e", "more": 1}, "schema"), "f": ("{", "unreadable"), "g": ({**good, "frame_name": "g", "valid_pixel_count": 0, "clamped_pixel_count": 0, "clamped_fraction": 0.0}, None), "z": (good, "no frame")}
    frames = spark.createDataFrame([(1, n) for n in "abcdefgh"], "job int, frame_name string")
    sidecars = spark.createDataFrame([(1, n, d if isinstance(d, str) else json.dumps(d)) for n, (d, _) in cases.items()], "job int, frame_name string, document string")
    got = {r.frame_name: (r.fraction, r.problem) for r in jobs.clamp_fractions(frames, sidecars, ["job"]).collect()}
    assert got == {**{n: (None, p) for n, (_, p) in cases.items()}, "a": (1 / 3, None), "g": (0.0, None), "h": (None, "no sidecar")}


def test_square_crops_are_resized(spark):
    df = spark.createDataFrame([(0, r, c, float(10 * r + c)) for r in range(6) for c in range(8)], "frame int, row int, col int, v double")
    got = {(r.out_row, r.out_col): r.out for r in pixels.crop_square_to(df, 8, 6, 1.0, 3, 3, ["frame"], "v").collect()}
    assert got == {(i, j): pytest.approx(10 * (2 * i + 0.5) + 2 * j + 0.5 + 1) for i in range(3) for j in range(3)}


@pytest.mark.parametrize("kind, curve, half, gain", [("stereographic", math.tan, 0.5, 2), ("equidistant", lambda a: a, 1, 1), ("equisolid", math.sin, 0.5, 2), ("orthogonal", math.sin, 1, 1), ("odd", math.sin, 1, 1)])
def test_projections_move_places_along_their_direction(spark, kind, curve, half, gain):
    at = [(32.0, 24.0), (33.0, 24.0), (10.0, 40.0), (0.0, 0.0)]
    x, y = geometry.project(F.col("x"), F.col("y"), 64, 48, 150, F.lit(kind))
    rim = math.radians(150) / 2
    for r in spark.createDataFrame(at, "x double, y double").select("x", "y", x.alias("u"), y.alias("v")).collect():
        d = math.hypot(r.x - 32, r.y - 24)
        k = gain * 24 * curve(d / 24 * rim * half) / curve(rim * half) / d if d else 0
        assert (r.u, r.v) == (pytest.approx(min(63, max(0, 32 + k * (r.x - 32)))), pytest.approx(min(47, max(0, 24 + k * (r.y - 24)))))
