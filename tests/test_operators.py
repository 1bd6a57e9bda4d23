"""Operators against numpy or literal results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import pixels as px, sequences as seq, statistics as st
from fathomline.plans import catalogue as cat
from fathomline.sources import frames as src
from fathomline.streaming import progress
from tests.conftest import SF


def test_cuts_keep_their_distance(spark):
    def cuts(distances, least):
        df = spark.createDataFrame([("c", i, float(d)) for i, d in enumerate(distances)], "clip string, i int, d double")
        return seq.accepted_cuts(df, "clip", "i", "d", 0.55, least).first()["cuts"]

    flip = [0.0] + [1.0 if i % 4 == 0 else 0.0 for i in range(1, 12)]
    assert cuts(flip, 3) == [4, 8]
    assert cuts([0, 0, 0, 0, 1.0, 0], 3) == []  # the tail would be too short
    assert cuts([0.0] + [1.0] * 9, 3) == [3, 6]


def test_merged_segments(spark):
    lines = [np.linspace(a, a + 10, 101) for a in (0, 0.5, 1)]
    rows = [("c", k, float(v)) for k, x in enumerate(lines) for v in x] + [("d", 0, float(v)) for v in np.linspace(0, 1, 50)] + [("d", 1, float(v)) for v in np.linspace(10, 11, 50)] + [("e", 0, 2.0), ("e", 1, 2.0), ("f", 0, None)]
    out = seq.merge_segments(spark.createDataFrame(rows, "clip string, seg int, v double"), "clip", "seg", "v").toPandas()
    pooled = np.concatenate(lines)
    c = out[out["clip"] == "c"]
    assert set(c.merged_id) == {0} and np.allclose(c.low, np.percentile(pooled, 2)) and np.allclose(c.high, np.percentile(pooled, 98))
    assert sorted(out[out["clip"] == "d"].merged_id) == [0, 1]
    assert set(out[out["clip"] == "e"].merged_id) == {0}
    assert out[out["clip"] == "f"].n.tolist() == [0]
    # segments without finite samples merge with one another and with no others
    odd = [("g", 0, None), ("g", 1, float("nan")), ("g", 2, 5.0), ("g", 2, float("inf")), ("g", 3, None)]
    got = seq.merge_segments(spark.createDataFrame(odd, "clip string, seg int, v double"), "clip", "seg", "v").orderBy("seg").collect()
    assert [(r.merged_id, r.n, r.low) for r in got] == [(0, 0, 0.0), (0, 0, 0.0), (1, 1, 5.0), (2, 0, 0.0)]


def test_even_indexes(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 5, 8, 100)], "n int").withColumn("k", seq.even_indexes(F.col("n"), 8))
    for r in df.collect():
        want = list(range(r.n)) if r.n <= 8 else np.unique(np.rint(np.linspace(0, r.n - 1, 8)).astype(int)).tolist()
        assert r.k == want


def test_aligned_windows_join(spark):
    rows = [("c", i, float(2 + np.sin(i / 5))) for i in range(70)]
    out = seq.align_windows(spark.createDataFrame(rows, "clip string, i int, v double"), "clip", "i", "v", 32, 4).orderBy("i").toPandas()
    assert np.allclose(out.aligned, [v for *_, v in rows])  # a signal on one scale stays as it is
    assert sorted(set(out.window_id)) == [0, 1, 2]


def test_aligned_windows_fall_and_end_at_zero(spark):
    """A window whose first frames run against the last ones is turned over; what comes out below zero is zero."""
    v = [float(i) for i in range(8)] + [float(20 - 3 * i) for i in range(4)]
    v[6:8] = [3.0, 1.0]
    out = seq.align_windows(spark.createDataFrame([("c", i, x) for i, x in enumerate(v)], "clip string, i int, v double"), "clip", "i", "v", 8, 2).orderBy("i").toPandas()
    assert out.aligned.tolist()[:8] == v[:8] and out.aligned.min() >= 0 and out.aligned.tolist()[8:] == v[8:]


def test_splat_rules(spark):
    def run(rows):
        df = spark.createDataFrame(rows, "row int, col int, near double, off int, ok boolean")
        out = px.splat(df, ["row"], "col", 3, F.col("off"), F.col("near"), [], F.col("ok")).orderBy("lane").collect()
        return [(r.lane, r.source) for r in out]

    still = run([(0, c, 0.5, 0, True) for c in range(3)])
    assert still == [(k, k // 16) for k in range(48)]
    assert [k for k, _ in run([(0, 2, 0.5, 1, True)])] == list(range(33, 48))
    assert all(s == 0 for k, s in run([(0, 0, 0.9, 16, True), (0, 1, 0.1, 0, True)]) if 16 <= k < 32)
    assert all(s == 0 for k, s in run([(0, 0, 0.5, 16, True), (0, 1, 0.5, 0, True)]) if 16 <= k < 32)
    assert all(s == 1 for k, s in run([(0, 0, 10.0, 16, False), (0, 1, 1.0, 0, True)]))


def test_moments_merge(spark):
    x = np.random.default_rng(0).normal(5, 2, 400)
    df = spark.createDataFrame([(i % 7, float(v), i % 3 > 0) for i, v in enumerate(x)], "tile int, v double, ok boolean").withColumn("g", F.lit(1))
    r = st.merge_moments(st.tile_moments(df, ["g"], "tile", "v", F.col("ok")), ["g"]).first()
    use = x[np.arange(400) % 3 > 0]
    assert r.n == len(use) and r["mean"] == pytest.approx(use.mean()) and r.m2 == pytest.approx(((use - use.mean()) ** 2).sum())


def test_moments_of_large_means(spark):
    x = 1e8 + np.random.default_rng(1).normal(0, 1, 6400)
    df = spark.createDataFrame([(i % 64, float(v), "a" if i % 2 else None) for i, v in enumerate(x)], "tile int, v double, g string")
    got = {r.g: (r.n, r.m2) for r in st.merge_moments(st.tile_moments(df, ["g"], "tile", "v", F.lit(True)), ["g"]).collect()}
    for g, use in (("a", x[1::2]), (None, x[::2])):
        assert got[g] == (3200, pytest.approx(((use - use.mean()) ** 2).sum(), rel=1e-6))


def test_quality_literals(spark):
    rows = [("a", 0, 0, 1.0, 1.0), ("a", 0, 1, 2.0, 2.0), ("a", 1, 0, 2.0, 2.0), ("a", 1, 1, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "clip string, frame int, px int, p double, t double")
    r = st.depth_quality(df, ["clip"], ["px"], "frame", "p", "t").first()
    assert (r.tgse, r.abs_rel, r.delta1) == (0.5, 0.0625, 0.75)


def test_run_gates_want_all_seeds(spark):
    rows = [("b", "s", seed, v, t, 0.1, 0.9) for seed in (0, 1) for v, t in (("baseline", 15.0), ("candidate", 14.75))]
    runs = spark.createDataFrame(rows, "backend string, sequence string, seed int, variant string, tgse double, abs_rel double, delta1 double")
    assert st.run_gates(runs, [0, 1]).first()["passed"]
    with pytest.raises(Exception, match="wrong seeds"):
        st.run_gates(runs, [0, 1, 2]).collect()


def test_gate_order(spark):
    fields = "pair_count long, covariance double, source_variance double, raw_variance double, scale double, shift double, correlation double, candidate_mean double, candidate_std double, source_mean double, low_share double, high_share double"
    good = (10, 0.1, 0.04, 0.04, 1.0, 0.0, 0.9, 0.5, 0.2, 0.5, 0.0, 0.0)
    change = {None: {}, "too_few_pairs": {0: 1}, "source_variance": {2: 0.0, 6: 0.1}, "scale_below_minimum": {4: -1.0, 6: 0.1}, "correlation": {6: 0.1, 7: 0.9}, "contrast": {8: 0.01, 7: 0.9}, "mean_drift": {7: 0.6, 10: 0.5}, "preclip_out_of_range": {10: 0.02}}
    rows = [tuple(c.get(i, v) for i, v in enumerate(good)) for c in change.values()]
    got = [r.fallback_reason for r in st.gate(spark.createDataFrame(rows, fields).coalesce(1), F.lit(True)).collect()]
    assert got == list(change)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "shot int, i int")
    path = f"file://{tmp_path}/t"
    assert src.append_new(df, path, ["shot", "i"]).count() == 3
    assert src.append_new(df.unionAll(spark.createDataFrame([(3, 0)], "shot int, i int")), path, ["shot", "i"]).count() == 4
    counts = spark.createDataFrame([(1, 2), (2, 1)], "shot int, expected int")
    out = f"file://{tmp_path}/s"
    assert src.commit_shots(df, out, ["shot"], "i", counts).count() == 3
    with pytest.raises(ValueError, match="not whole"):
        src.commit_shots(df.filter("shot = 1 AND i = 1"), out, ["shot"], "i", counts.filter("shot = 1"))
    assert spark.read.parquet(out).count() == 3


def test_settings_and_frames(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/frame_000010.png").write_bytes(b"x")
    (tmp_path / "a/frame_000002.png").write_bytes(b"xy")
    (tmp_path / "a/notes.txt").write_bytes(b"no")
    got = [(r.frame_idx, r.length) for r in src.read_frames(spark, f"file://{tmp_path}/a").orderBy("frame_idx").collect()]
    assert got == [(2, 2), (10, 1)]
    (tmp_path / "one-settings.json").write_text('{"k": 3, "extra": 1}')
    assert src.read_settings(spark, f"file://{tmp_path}/*.json", "k INT, m STRING").first().asDict() == {"k": 3, "m": None}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = progress.run_available(spark, f"file://{tmp_path}/in", events.schema, lambda df: progress.event_counts(df, "ts", ["event_type"]), "counts_test")
    key = lambda df: sorted((str(r.window_start), r.event_type, r.n) for r in df.collect())
    assert key(stream) == key(progress.event_counts(events, "ts", ["event_type"]))


def test_resume_report_quirk(spark):
    rows = [("j", "stereo", True, False, True, True, "invalidate"), ("j", "upscale", True, False, True, True, None)]
    stages = spark.createDataFrame(rows, "job_id string, stage string, exists boolean, setting_changed boolean, has_manifest boolean, manifest_ok boolean, state string")
    r = cat.resume_report(stages).first()
    assert (r.stereo_state, r.crop_state, r.upscale_state, r.assemble_state) == ("invalidate", "missing", "preserve", "missing")


def test_resume_report_holds_no_rows_before_its_shuffle(spark):
    stages = spark.range(1000).repartition(3).selectExpr("id AS job_id", "explode(array('stereo', 'crop')) AS stage").selectExpr("*", "true AS exists", "false AS setting_changed", "true AS has_manifest", "true AS manifest_ok", "'preserve' AS state")
    report = cat.resume_report(stages)
    plan = report._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning(job_id") :]
    assert "Aggregate" not in below and "Sort" not in below
    assert report.count() == 1000 and report.filter("stereo_state = 'preserve' AND crop_state = 'preserve' AND upscale_state = 'missing'").count() == 1000
