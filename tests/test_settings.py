"""Settings, payload scans, cache keys."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from fathomline.functions import text
from fathomline.plans import settings
from fathomline.queries import QUERIES
from fathomline.sources import payloads
from tests.conftest import SF


def test_rules_hold_types_and_bounds(spark):
    cases = {
        '{}': [], '{"target_fps": null}': [], '{"target_fps": "original"}': [], '{"target_fps": "121"}': ["target_fps"], '{"target_fps": true}': ["target_fps"], '{"min_scene_frames": 8.0}': ["min_scene_frames"],
        '{"convergence": 1}': [], '{"convergence": null}': ["convergence"], '{"metric_convergence_distance": "auto"}': [], '{"metric_convergence_distance": 0.05}': ["metric_convergence_distance"],
        '{"hole_fill_quality": 1, "zzz": 2}': ["removed hole_fill_quality", "unknown zzz"], '[1]': ["unreadable"], '{': ["unreadable"],
        '{"temporal_postprocessor": "vdpp", "stereo_geometry_mode": "metric_camera"}': ["vdpp with metric_camera"], '{"vr_format": "off"}': ["vr_format"],
    }
    df = spark.createDataFrame([(d,) for d in [*cases, None]], "doc string")
    got = {r.doc: r.violations for r in settings.audit(df, "doc").collect()}
    assert got == cases | {None: ["unreadable"]}


def test_optional_settings_have_rules(spark):
    sizes = ["per_eye_width", "per_eye_height", "vr_output_width", "vr_output_height", "source_width", "source_height"]
    good = {**{k: 1920 for k in sizes}, "enable_live_preview": True, "verbose": False, "preview_update_interval": 2, "model_path": None, "video_path": "a.mp4", "temporal_postprocessor": "off"}
    bad = {**{k: None for k in sizes}, "enable_live_preview": 1, "verbose": "no", "preview_update_interval": -0.5, "model_path": 1, "video_path": True}
    rows = [(json.dumps(good), 4)] + [(json.dumps({**good, k: v}), 4) for k, v in bad.items()]
    got = {r.doc: r for r in settings.migrate(spark.createDataFrame(rows, "doc string, version int"), "doc", "version").collect()}
    assert got[rows[0][0]].problem is None and got[rows[0][0]].settings["per_eye_width"] == "1920"
    assert [got[doc].problem for doc, _ in rows[1:]] == list(bad)
    older = settings.migrate(spark.createDataFrame([(json.dumps({"verbose": True, "zzz": 1}), 2)], "doc string, version int"), "doc", "version").first()
    assert older.settings["verbose"] == "true" and older.removed_settings == ["zzz"]


def test_migration_turns_newer_versions_away(spark):
    rows = [('{"zzz": 1}', None), ('{"zzz": 1}', 4), ("{}", 4), ('{"temporal_postprocessor": "off"}', 4), ("{}", 5), ("{}", 0)]
    out = settings.migrate(spark.createDataFrame(rows, "doc string, version int").coalesce(1), "doc", "version")
    got = out.collect()
    assert [r.problem for r in got] == [None, "unknown zzz", "temporal_postprocessor is missing", None, "newer version", "version below 1"]
    assert got[0].removed_settings == ["zzz"] and got[0].settings["min_scene_frames"] == "8" and "seed" not in got[0].settings
    with pytest.raises(Exception, match="newer version"):
        settings.require(out.filter("source_version = 5")).collect()


def test_raw_depth_scan(spark, tmp_path):
    rows = [(1, 0, [1, 2], "<f4", [0.5, 1.0]), (1, 1, [2, 1], "<f4", [0.5, 1.0])]
    path = f"file://{tmp_path}/raw"
    spark.createDataFrame(rows, payloads.RAW_DEPTH).write.parquet(path)
    with pytest.raises(Exception, match="shape of raw depth at 1 1"):
        payloads.read_raw_depth(spark, path, (1, 2), "<f4").collect()
    assert payloads.read_raw_depth(spark, path, (1, 2)).filter("frame_idx = 0").first()["values"] == [0.5, 1.0]
    assert payloads.read_maps(spark, path).columns == ["clip_id", "frame_idx", "values"]


def test_kept_patterns(spark):
    df = spark.createDataFrame([("a/b.png",), ("b.png",), ("a/xb.png",), ("a/b.png.x",)], "p string")
    assert [r.k for r in df.select(payloads.is_kept(F.col("p"), ["b.p?g"]).alias("k")).collect()] == [True, True, False, False]


def test_cache_keys(spark):
    rows = QUERIES["f15_cache_keys"](spark, SF).join(spark.read.parquet(f"{SF}/events.parquet"), "event_id").limit(50).collect()
    for r in rows:
        body = json.dumps({k: {"seed": r.user_id, "device": r.event_type}.get(k) for k in text.CACHE_SETTINGS}, sort_keys=True)
        assert r.cache_key == hashlib.blake2b((r.event_type + body).encode(), digest_size=16).hexdigest()
