"""The stage graph, audits of single stages, and manifests that verify themselves."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from fathomline.plans import manifests, stages
from fathomline.plans.stages import INVALIDATE, MISSING, PRESERVE, RESUME, Edge

ALL = "frames scene_cuts scenes raw canonical stereo distortion crop upscale assemble".split()


def states(spark, changes, mode="relative", edges=stages.EDGES):
    rows = [(1, s, *changes.get(s, (PRESERVE, "reusable")), mode) for s in [*ALL, "metric", "stabilized"] if changes.get(s) != MISSING]
    own = spark.createDataFrame(rows, "job_id int, stage string, state string, reason string, mode string").select("job_id", "stage", "mode", F.struct("state", "reason").alias("verdict"))
    return {r.stage: (r.state, r.reason) for r in stages.evaluate(own, edges).collect()}


def test_everything_is_kept(spark):
    assert set(s for s, _ in states(spark, {}).values()) == {PRESERVE}


def test_bad_frames_take_all_but_what_is_missing(spark):
    got = states(spark, {"frames": (INVALIDATE, "frame count mismatch"), "crop": MISSING, "metric": MISSING, "stabilized": MISSING})
    assert got["frames"] == (INVALIDATE, "frame count mismatch") and got["scenes"] == (INVALIDATE, "source frames are invalid") and got["raw"][0] == INVALIDATE
    assert got["crop"] == (MISSING, "absent") and got["upscale"] == (PRESERVE, "reusable")  # its need is missing, not invalid
    assert got["assemble"] == (INVALIDATE, "an upstream stage is invalid")


def test_bounds_follow_the_raw_maps(spark):
    got = states(spark, {"raw": (INVALIDATE, "schema mismatch")})
    assert got["scenes"] == (RESUME, "bounds will be recomputed") and got["canonical"] == (INVALIDATE, "scenes are not final")
    assert states(spark, {"scenes": (RESUME, "candidate will be finished"), "raw": (INVALIDATE, "x")})["scenes"] == (RESUME, "candidate will be finished")


def test_partial_stages_go_on(spark):
    got = states(spark, {"raw": (RESUME, "partly complete"), "stereo": (RESUME, "partly complete")})
    assert got["canonical"][0] == PRESERVE and got["stereo"][0] == RESUME and got["distortion"][0] == PRESERVE


@pytest.mark.parametrize("mode, stage", [("relative", "canonical"), ("metric", "metric"), ("stabilized", "stabilized")])
def test_the_mode_picks_the_geometry(spark, mode, stage):
    for other in ("canonical", "metric"):
        got = states(spark, {other: (INVALIDATE, "x"), "stabilized": (PRESERVE, "y")}, mode)
        bad = other == stage or mode == "stabilized" and other == "canonical"
        assert got["stereo"] == ((INVALIDATE, "selected geometry is invalid") if bad else (PRESERVE, "reusable"))
    assert states(spark, {"stabilized": (RESUME, "z")}, "stabilized")["stereo"][0] == INVALIDATE


def test_graphs_as_tables_and_cycles(spark):
    table = spark.createDataFrame([("b", "a", [PRESERVE], "r", INVALIDATE, None), ("c", "b", [PRESERVE, MISSING], "q", RESUME, None)], "stage string, upstream string, accepted array<string>, reason string, otherwise string, mode string")
    edges = stages.edges_of(table)
    assert stages.levels(edges) == [["a"], ["b"], ["c"]]
    own = spark.createDataFrame([(1, "a", INVALIDATE), (1, "c", PRESERVE), (1, "b", PRESERVE), (2, "c", PRESERVE)], "job_id int, stage string, state string").select("job_id", "stage", F.struct("state", F.lit("own").alias("reason")).alias("verdict"))
    got = {(r.job_id, r.stage): (r.state, r.reason) for r in stages.evaluate(own, edges, mode=None).collect()}
    assert got == {(1, "a"): (INVALIDATE, "own"), (1, "b"): (INVALIDATE, "r"), (1, "c"): (RESUME, "q"), (2, "a"): (MISSING, "absent"), (2, "b"): (MISSING, "absent"), (2, "c"): (PRESERVE, "own")}
    with pytest.raises(ValueError, match="one another"):
        stages.levels([*edges, Edge("a", "c", (PRESERVE,))])
    assert stages.evaluate(own.filter("false"), edges, mode=None).count() == 0


def test_one_shuffle_for_the_whole_graph(spark):
    own = spark.range(10).select((F.col("id") % 5).alias("job_id"), F.lit("frames").alias("stage"), F.lit("relative").alias("mode"), F.struct(F.lit(PRESERVE).alias("state"), F.lit("").alias("reason")).alias("verdict"))
    plan = stages.evaluate(own)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_report_and_paths(spark):
    st = spark.createDataFrame([(1, "frames", 0, INVALIDATE, "x"), (1, "crop", 1, INVALIDATE, "y"), (1, "scene_cuts", 1, PRESERVE, "")], "job_id int, stage string, level int, state string, reason string")
    sizes = spark.createDataFrame([(1, "crop", 5), (1, "crop", 7)], "job_id int, stage string, bytes long")
    assert {r.stage: r.bytes for r in stages.report(st, sizes).collect()} == {"frames": 0, "crop": 12}
    paths = spark.createDataFrame([(1, "frames", "f"), (1, "crop", "f"), (1, "crop", "c"), (1, "crop", "c")], "job_id int, stage string, path string")
    assert [tuple(r) for r in stages.must_go(st, paths).collect()] == [(1, "c")]


CANONICAL = {**stages.CANONICAL, "frame_names": ["a", "b"], "num_frames": 2, "source_raw_fingerprint": "r", "source_model_fingerprint": "m", "scene_manifest_fingerprint": "s", "depth_bounds_fingerprint": "b"}
SCHEMA = "schema_version int, algorithm_version int, representation string, near_value double, far_value double, encoding string, encoding_scale double, frame_names array<string>, num_frames int, source_raw_fingerprint string, source_model_fingerprint string, scene_manifest_fingerprint string, depth_bounds_fingerprint string, fingerprint string"


def seal(document):
    body = {k: v for k, v in document.items() if k != "fingerprint"}
    return json.dumps({**body, "fingerprint": hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()})


def test_each_of_the_canonical_checks(spark):
    spoiled = {"num_frames": 3, "near_value": 0.5, "far_value": 1.0, "encoding_scale": 1.0, "frame_names": ["b", "a"], "schema_version": 9, "algorithm_version": 9}
    docs = {None: seal(CANONICAL), "fingerprint": seal(CANONICAL).replace('"b"]', '"b"], "note": 1')}
    docs |= {k: seal({**CANONICAL, k: spoiled.get(k, "other")}) for k in CANONICAL}
    assert len(docs) == 15
    table = spark.createDataFrame([(k, v) for k, v in docs.items()], "k string, doc string")
    checks = stages.canonical_checks(F.from_json("doc", SCHEMA), manifests.self_hash(F.col("doc")), F.array(F.lit("a"), F.lit("b")), F.lit("r"), F.lit("m"), F.lit("s"), F.lit("b"))
    got = {r.k: (r.v.state, r.v.reason) for r in table.select("k", stages.judged(F.lit(True), checks).alias("v")).collect()}
    assert got == {k: (INVALIDATE, k) if k else (PRESERVE, "reusable") for k in docs}


def test_scene_and_raw_audits(spark):
    doc = "STRUCT<schema_version: INT, frame_names: ARRAY<STRING>, source_fingerprint: STRING, settings: STRING, scene_ids: ARRAY<INT>, status: STRING>"
    good = (1, ["a", "b"], "fp", "s", [0, 1], "final")
    rows = [("reusable", good), ("schema or source mismatch", (2, *good[1:])), ("scene settings mismatch", (*good[:3], "t", *good[4:])), ("scene ids do not match frames", (*good[:4], [0], "final")), ("candidate will be finished", (*good[:5], "candidate")), ("status is invalid", (*good[:5], "odd")), ("schema or source mismatch", None)]
    checks = stages.scene_checks(F.col("d"), F.array(F.lit("a"), F.lit("b")), F.lit("fp"), F.lit("s"), {"schema_version": 1})
    out = spark.createDataFrame(rows, f"want string, d {doc}").select("want", stages.judged(F.lit(True), checks).alias("v")).collect()
    assert all(r.want == r.v.reason for r in out) and {r.v.state for r in out if r.want.startswith("cand")} == {RESUME}
    raw = "STRUCT<schema_version: INT, frame_names: ARRAY<STRING>, camera: STRING, source_fingerprint: STRING, model: STRING, requested_dtype: STRING, selected_dtype: STRING, storage_status: STRING>"
    base = dict(schema_version=3, frame_names=["a", "b"], camera="none", source_fingerprint="fp", model="m", requested_dtype="auto", selected_dtype="float16", storage_status="ready")
    cases = [({}, "reusable", 2, "auto"), ({"schema_version": 1}, "schema mismatch", 2, "auto"), ({"camera": "odd"}, "camera model mismatch", 2, "auto"), ({"model": "n"}, "model setting mismatch", 2, "auto"), ({"requested_dtype": "float32"}, "storage type mismatch", 2, "auto"),
             ({"storage_status": "promoting"}, "promotion will go on", 2, "auto"), ({}, "promotion will go on", 2, "float32"), ({}, "partly complete", 1, "auto"), ({"schema_version": 2, "camera": None}, "reusable", 2, "auto")]
    rows = [(want, {**base, **change}, done, asked) for change, want, done, asked in cases]
    checks = stages.raw_checks(F.col("d"), F.lit(True), F.col("done"), F.array(F.lit("a"), F.lit("b")), F.lit("fp"), F.struct(F.lit("m").alias("model"), F.col("asked").alias("dtype")), F.lit("none"))
    out = spark.createDataFrame(rows, f"want string, d {raw}, done int, asked string").select("want", stages.judged(F.lit(True), checks).alias("v")).collect()
    assert [r.v.reason for r in out] == [r.want for r in out]


def test_frame_payload_and_generated_audits(spark):
    one = lambda checks: spark.range(1).select(stages.judged(F.lit(True), checks).alias("v")).first().v
    null = F.lit(None)
    assert one(stages.frame_checks(F.lit(3), F.lit(4), F.lit(True), F.lit(True), F.lit(True), F.lit("x"), F.lit(True))).reason == "frame count mismatch"
    assert one(stages.frame_checks(F.lit(3), null, F.lit(True), F.lit(True), F.lit(True), null, F.lit(True))).reason == "source fingerprint is missing"
    assert one(stages.payload_checks(F.lit(5), F.lit(5), F.lit(4))).state == RESUME
    assert one(stages.payload_checks(F.lit(5), F.lit(4), F.lit(4))).reason == "partly complete"
    doc = F.struct(F.lit(1).alias("schema_version"), F.lit("h").alias("fingerprint"))
    assert one(stages.generated_checks(F.lit("crop_factor"), doc, F.lit("h"))).reason == "setting changed"
    assert one(stages.generated_checks(null, doc, F.lit("g"))).reason == "completion manifest is invalid"
    assert one(stages.generated_checks(null, doc, F.lit("h"))).state == PRESERVE


def test_documents_hold_their_own_hash(spark):
    docs = [json.dumps({"a": 1.0, "n": {"z": [1, None], "b": "é"}, "fingerprint": "old"}), "{}", "[1]", "{", None]
    out = spark.createDataFrame([(d,) for d in docs], "d string").select("d", manifests.sealed(F.col("d")).alias("s")).withColumns({"ok": manifests.is_sealed(F.col("s")), "was": manifests.is_sealed(F.col("d"))}).collect()
    assert [r.ok for r in out] == [True, True, False, False, False] and not any(r.was for r in out)
    assert json.loads(out[0].s)["fingerprint"] == json.loads(seal(json.loads(docs[0])))["fingerprint"]
    broken = spark.createDataFrame([(out[0].s.replace("1.0", "1.5"),)], "d string")
    assert not broken.select(manifests.is_sealed(F.col("d")).alias("ok")).first().ok


FILES = [(1, i, f"frame_{i:06d}.png", (64, 48)) for i in range(1, 41)]
FILE = "job int, frame_idx int, name string, header struct<width: int, height: int>"


def kept(spark, files, identity='{"stage": "crop", "settings": {"factor": 1.0}}', changed=None):
    who = spark.createDataFrame([(1, 40, identity)], "job int, expected int, document string")
    made = manifests.complete(spark.createDataFrame(FILES, FILE), who, ["job"])
    now = who.withColumn("document", F.lit(changed or identity))
    return tuple(manifests.reusable(now, made, spark.createDataFrame(files, FILE), ["job"]).first())[1:]


def test_manifests_find_what_changed(spark):
    assert kept(spark, FILES) == (PRESERVE, "reusable")
    assert kept(spark, FILES[::-1]) == (PRESERVE, "reusable")  # rows have no order, places do
    assert kept(spark, FILES, changed='{"stage": "crop", "settings": {"factor": 0.9}}') == (INVALIDATE, "identity changed")
    assert kept(spark, FILES[:-1]) == (INVALIDATE, "files changed")
    swapped = [(1, 1, FILES[1][2], (64, 48)), (1, 2, FILES[0][2], (64, 48)), *FILES[2:]]
    assert kept(spark, swapped) == (INVALIDATE, "files changed")
    assert kept(spark, [*FILES[:-1], (1, 40, FILES[-1][2], (64, 47))]) == (INVALIDATE, "invalid output header")
    assert kept(spark, [*FILES[:-1], (1, 40, FILES[-1][2], None)]) == (INVALIDATE, "invalid output header")


def test_manifests_are_made_of_whole_stages_only(spark):
    who = spark.createDataFrame([(1, 40, "{}")], "job int, expected int, document string")
    for files in (FILES[1:], [*FILES, FILES[0]], [*FILES[:-1], (1, 40, "x", (1, 1))], [*FILES[:-1], (1, 41, "x", (64, 48))]):
        assert manifests.complete(spark.createDataFrame(files, FILE), who, ["job"]).count() == 0
    assert manifests.complete(spark.createDataFrame(FILES, FILE), who, ["job"]).count() == 1


def test_digests_of_parts_add_up(spark):
    df = spark.range(1000).select(F.col("id"), F.concat(F.lit("f"), "id").alias("name"))
    digest = lambda d: d.agg(manifests.file_digest(F.col("id"), [F.col("name")]).alias("d")).first().d
    assert digest(df) == digest(df.repartition(7)) == digest(df.orderBy(F.desc("id")))
    assert digest(df) != digest(df.withColumn("name", F.when(F.col("id") == 500, "f0").otherwise(F.col("name"))))
    assert digest(df) != digest(df.withColumn("id", F.when(F.col("id") == 1, 0).when(F.col("id") == 0, 1).otherwise(F.col("id"))))
    assert digest(df) != digest(df.unionAll(df.limit(1))) and digest(df.filter("id < 0")) is not None
