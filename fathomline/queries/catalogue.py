"""Alignment (J-*), catalogue and resume planning (B-*), sources and streams (S-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators.sequences import runs_where
from fathomline.plans import catalogue as cat
from fathomline.queries import FRAMES_SQL, frames, query, table
from fathomline.sources import frames as src, payloads
from fathomline.streaming import progress


@query("j01_pending_work", "SELECT o.o_orderkey, o.o_custkey FROM orders o ANTI JOIN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') d ON o.o_orderkey = d.l_orderkey")
def j01(spark, sf):
    done = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return cat.pending_work(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query("j02_eye_pairs", "SELECT coalesce(l.user_id, r.user_id) AS clip_id, l.n IS NULL AS no_left, r.n IS NULL AS no_right, coalesce(l.n = r.n, false) AS even FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id) l FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY user_id) r ON l.user_id = r.user_id")
def j02(spark, sf):
    """Both eyes of a clip side by side; either may be missing."""
    e = table(spark, sf, "events")
    side = lambda kind, n: e.filter(F.col("event_type") == kind).groupBy(F.col("user_id").alias("clip_id")).agg(F.count(F.lit(1)).alias(n))
    both = side("click", "l").join(side("signup", "r"), "clip_id", "full_outer")
    return both.select("clip_id", F.col("l").isNull().alias("no_left"), F.col("r").isNull().alias("no_right"), F.coalesce(F.col("l") == F.col("r"), F.lit(False)).alias("even"))


@query("j03_sequence_gaps", f"WITH {FRAMES_SQL}, k AS (SELECT clip_id, frame_idx FROM f WHERE event_id % 11 <> 0), m AS (SELECT clip_id, frame_idx, frame_idx - row_number() OVER (PARTITION BY clip_id ORDER BY frame_idx) AS g FROM k) SELECT clip_id, min(frame_idx) AS run_start, max(frame_idx) AS run_end, count(*) AS run_length FROM m GROUP BY clip_id, g")
def j03(spark, sf):
    """Gap-free stretches of each clip's frames."""
    return runs_where(frames(spark, sf), ["clip_id"], "frame_idx", F.col("event_id") % 11 != 0)


@query("j05_b10_shot_audit", "WITH p AS (SELECT o_orderkey AS shot_id, o_custkey % 50 AS s, o_custkey % 50 + 32 AS e FROM orders), r AS (SELECT l_orderkey AS shot_id, max(l_linenumber) AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey) SELECT p.shot_id, CASE WHEN r.shot_id IS NULL THEN 'pending' WHEN r.n = 1 AND r.k <> 3 THEN 'reusable' ELSE 'invalid' END AS state FROM p LEFT JOIN r USING (shot_id)")
def j05(spark, sf):
    """Planned shots against recorded ones: reusable, invalid or pending."""
    plan = table(spark, sf, "orders").select(F.col("o_orderkey").alias("shot_id"), (F.col("o_custkey") % 50).alias("start"), (F.col("o_custkey") % 50 + 32).alias("end"))
    recorded = table(spark, sf, "lineitem").filter("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("shot_id")).agg(F.max("l_linenumber").alias("k"), F.count(F.lit(1)).alias("n"))
    records = plan.join(recorded, "shot_id").select("shot_id", "start", F.when(F.col("n") == 1, F.col("end")).otherwise(F.lit(0)).alias("end"), (F.col("k") != 3).alias("hash_ok"))
    return cat.audit_shots(plan, records, ["shot_id"]).select("shot_id", "state")


@query("j06_j07_payload_differences", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'unexpected' WHEN d.doc_id IS NULL THEN 'absent' ELSE 'completed' END AS state FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def j06(spark, sf):
    return cat.payload_differences(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("j09_gathered", f"WITH {FRAMES_SQL}, i AS (SELECT clip_id, frame_idx, frame_idx // 2 AS source_idx FROM f) SELECT i.clip_id, i.frame_idx, i.source_idx, f.value AS gathered FROM i JOIN f ON f.clip_id = i.clip_id AND f.frame_idx = i.source_idx")
def j09(spark, sf):
    """Values picked by index inside each clip. Both sides are dealt by clip already, so the join shuffles nothing more."""
    f = frames(spark, sf).select("clip_id", "frame_idx", "value")
    index = f.select("clip_id", "frame_idx", F.floor(F.col("frame_idx") / 2).cast("int").alias("source_idx"))
    return index.join(f.select("clip_id", F.col("frame_idx").alias("source_idx"), F.col("value").alias("gathered")), ["clip_id", "source_idx"]).select("clip_id", "frame_idx", "source_idx", "gathered")


@query("j10_consistency", "WITH l AS (SELECT l_orderkey, sum(l_extendedprice) AS s, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey, n, abs(s / n - o_totalprice / n) < 10000 AS consistent FROM orders JOIN l ON o_orderkey = l_orderkey")
def j10(spark, sf):
    l = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"), F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "orders").join(l, "o_orderkey").select("o_orderkey", "n", (F.abs(F.col("s") / F.col("n") - F.col("o_totalprice") / F.col("n")) < 10000).alias("consistent"))


@query("l03_invalidated_paths", "SELECT p_brand, min(p_partkey) AS first_seen FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50) GROUP BY p_brand")
def l03(spark, sf):
    p = table(spark, sf, "part")
    protected = p.filter("p_size = 50").select("p_brand").distinct()
    return cat.invalidated_paths(p.withColumn("first_seen", F.col("p_partkey")), protected, "p_brand", "first_seen").select("p_brand", "first_seen")


_STAGES = ("stereo", "distortion", "crop", "upscale", "assemble")
_STATE_SQL = """WITH j AS (SELECT c_custkey AS job_id FROM customer), s AS (SELECT job_id, stage, i, (job_id * 7 + i * 3) % 5 > 0 AS ex, (job_id + i) % 11 = 0 AS changed, (job_id * 3 + i) % 13 > 0 AS has, (job_id + 2 * i) % 17 > 0 AS ok FROM j, (VALUES ('stereo', 0), ('distortion', 1), ('crop', 2), ('upscale', 3), ('assemble', 4)) AS t(stage, i)),
w AS (SELECT job_id, CASE job_id % 4 WHEN 0 THEN 'resume' WHEN 1 THEN 'invalidate' ELSE 'preserve' END AS st, {cols} FROM s GROUP BY job_id),
a AS (SELECT *, {d} AS dst FROM w), b AS (SELECT *, {c} AS crp FROM a), u AS (SELECT *, {up} AS ups FROM b), v AS (SELECT *, {asm} AS asb FROM u)
SELECT job_id, st AS stereo_state, dst AS distortion_state, crp AS crop_state, ups AS upscale_state, asb AS assemble_state FROM v"""


def _state_sql(i: int, upstream: str) -> str:
    return f"CASE WHEN NOT ex{i} THEN 'missing' WHEN NOT ({upstream}) THEN 'invalidate' WHEN ch{i} OR NOT has{i} OR NOT ok{i} THEN 'invalidate' ELSE 'preserve' END"


_B01 = _STATE_SQL.format(
    cols=", ".join(f"bool_or(ex) FILTER (i = {i}) AS ex{i}, bool_or(changed) FILTER (i = {i}) AS ch{i}, bool_or(has) FILTER (i = {i}) AS has{i}, bool_or(ok) FILTER (i = {i}) AS ok{i}" for i in range(5)),
    d=_state_sql(1, "st IN ('preserve', 'resume')"),
    c=_state_sql(2, "st IN ('preserve', 'resume') AND dst IN ('preserve', 'missing')"),
    up=_state_sql(3, "crp IN ('preserve', 'missing')"),
    asm=_state_sql(4, "st IN ('preserve', 'resume') AND crp IN ('preserve', 'missing') AND ups IN ('preserve', 'missing')"),
)


@query("b01_b02_resume_report", _B01)
def b01(spark, sf):
    """Dispositions of the generated stages of jobs (customers stand in for them)."""
    rows = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(i).alias("i")) for i, s in enumerate(_STAGES)])
    j = table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id"), F.inline(rows))
    c, i = F.col("job_id"), F.col("i")
    state = F.when(c % 4 == 0, "resume").when(c % 4 == 1, "invalidate").otherwise("preserve")
    stages = j.select("job_id", "stage", ((c * 7 + i * 3) % 5 > 0).alias("exists"), ((c + i) % 11 == 0).alias("setting_changed"), ((c * 3 + i) % 13 > 0).alias("has_manifest"), ((c + 2 * i) % 17 > 0).alias("manifest_ok"), state.alias("state"))
    return cat.resume_report(stages)


@query("b03_frame_audit", "WITH f AS (SELECT l_orderkey AS job, l_linenumber AS idx, l_linestatus AS hd FROM lineitem), s AS (SELECT job, count(*) AS n, count(DISTINCT idx) AS d, min(idx) AS a, max(idx) AS b, min(hd) = max(hd) AS even FROM f GROUP BY job) SELECT o_orderkey AS job, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN n <> o_custkey % 3 + 3 THEN 'count' WHEN NOT (a = 1 AND b = n AND d = n) THEN 'names' WHEN NOT even THEN 'header' END AS reason FROM orders LEFT JOIN s ON o_orderkey = job")
def b03(spark, sf):
    files = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("idx"), F.col("l_linestatus").alias("hd"))
    expected = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job"), (F.col("o_custkey") % 3 + 3).alias("expected_count"))
    return cat.audit_frames(files, expected, ["job"], "idx", ["hd"])


@query("b04_b13_first_mismatch", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'status' WHEN o_orderpriority <> '1-URGENT' THEN 'priority' WHEN NOT o_totalprice > 1000 THEN 'price' END AS mismatch FROM orders")
def b04(spark, sf):
    """The first identity check that fails."""
    checks = [("status", F.col("o_orderstatus") == "F"), ("priority", F.col("o_orderpriority") == "1-URGENT"), ("price", F.col("o_totalprice") > 1000)]
    return table(spark, sf, "orders").select("o_orderkey", cat.first_failing(checks).alias("mismatch"))


@query("b05_b06_b09_bound_manifests", "WITH m AS (SELECT l_orderkey, count(*) AS n, bool_and(l_discount < 0.1) AS ok FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey, CASE WHEN m.n IS NULL THEN 'missing' WHEN o_orderstatus = 'P' THEN 'invalidate' WHEN NOT m.ok THEN 'resume' ELSE 'preserve' END AS state FROM orders LEFT JOIN m ON o_orderkey = l_orderkey")
def b05(spark, sf):
    """Manifests bound to their payloads: a wrong identity invalidates, a bad payload is made again."""
    m = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("l_discount") < 0.1).alias("ok"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("o_orderstatus") == "P", "invalidate").when(~F.col("ok"), "resume").otherwise("preserve")
    return table(spark, sf, "orders").join(m, "o_orderkey", "left").select("o_orderkey", state.alias("state"))


@query("b08_execution_plan", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 3 = 0 ELSE c_custkey % 5 = 0 END AS cache_only, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 3 <> 0 ELSE c_custkey % 5 <> 0 AND c_custkey % 3 <> 0 END AS needs_base, c_custkey % 2 = 1 AND c_custkey % 5 <> 0 AS needs_temporal, CASE WHEN c_custkey % 2 = 0 THEN 'base' ELSE 'stabilized' END AS render_from FROM customer")
def b08(spark, sf):
    k = F.col("c_custkey")
    plan = cat.execution_plan(F.when(k % 2 == 0, "off").otherwise("temporal"), k % 3 == 0, k % 5 == 0)
    return table(spark, sf, "customer").select("c_custkey", plan.alias("p")).select("c_custkey", "p.*")


@query("b14_overall_progress", f"WITH {FRAMES_SQL}, s AS (SELECT clip_id, frame_idx, value AS w, event_id % 13 / 10.0 AS sh FROM f) SELECT clip_id, frame_idx, round(100 * (sum(w) OVER (PARTITION BY clip_id ORDER BY frame_idx) - w + w * greatest(0, least(1, sh))) / sum(w) OVER (PARTITION BY clip_id), 6) AS progress FROM s")
def b14(spark, sf):
    s = frames(spark, sf).select("clip_id", "frame_idx", F.col("value").alias("w"), (F.col("event_id") % 13 / 10.0).alias("sh"))
    return cat.overall_progress(s, "clip_id", "frame_idx", "w", "sh").select("clip_id", "frame_idx", F.round("progress", 6).alias("progress"))


_EVERY = 150_000_000
_THROTTLE_SQL = f"""
WITH RECURSIVE e AS (SELECT doc_id // 50 AS job_id, (doc_id % 50 * 60 + n_chars % 97) * 1000000 AS t, n_chars % 100 / 100.0::DOUBLE AS p FROM documents WHERE n_chars IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t, p) AS k FROM e),
r AS (SELECT job_id, 0 AS k, CAST(NULL AS BIGINT) AS last, false AS held, 0.0::DOUBLE AS best, CAST([] AS STRUCT(t BIGINT, p DOUBLE)[]) AS said FROM (SELECT DISTINCT job_id FROM o)
  UNION ALL SELECT job_id, k, CASE WHEN now IS NULL OR t >= now + {_EVERY} THEN t ELSE now END, now IS NOT NULL AND t < now + {_EVERY}, greatest(best, p),
    list_concat(CASE WHEN fires THEN [{{'t': now, 'p': best}}] ELSE [] END, CASE WHEN now IS NULL OR t >= now + {_EVERY} THEN [{{'t': t, 'p': greatest(best, p)}}] ELSE [] END)
  FROM (SELECT r.job_id, o.k, o.t, o.p, r.best, r.held AND r.last + {_EVERY} < o.t AS fires, CASE WHEN r.held AND r.last + {_EVERY} < o.t THEN r.last + {_EVERY} ELSE r.last END AS now FROM r JOIN o ON o.job_id = r.job_id AND o.k = r.k + 1)),
z AS (SELECT job_id, last + {_EVERY} AS t, best AS p FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY k DESC) AS b FROM r) WHERE b = 1 AND held)
SELECT job_id, t // 1000000 AS second, p AS progress FROM (SELECT job_id, s.t AS t, s.p AS p FROM (SELECT job_id, unnest(said) AS s FROM r) UNION ALL SELECT * FROM z)
"""


@query("b14_throttled_progress", _THROTTLE_SQL)
def b14_throttled(spark, sf):
    """What is said of jobs of 50 documents: one event in 150 seconds at most, progress that never falls, and the last event always."""
    at = F.timestamp_seconds(F.col("doc_id") % 50 * 60 + F.col("n_chars") % 97)
    events = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 50).alias("job_id"), at.alias("at"), (F.col("n_chars") % 100 / 100.0).alias("p"))
    said = progress.throttled(events, "job_id", "at", "p", F.lit(False), _EVERY)
    return said.select("job_id", F.unix_seconds("said_at").alias("second"), "progress")


@query("b11_b12_b16_resumable_jobs", "WITH f AS (SELECT o_custkey AS job_id, bool_or(o_orderkey % 3 = 0) AS frames, bool_or(o_orderkey % 13 = 0) AS fin FROM orders GROUP BY o_custkey) SELECT c_custkey AS job_id, c_acctbal AS modified FROM customer JOIN f ON c_custkey = job_id WHERE frames AND NOT fin")
def b16(spark, sf):
    jobs = table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id"), F.col("c_acctbal").alias("modified"))
    o = F.col("o_orderkey")
    stages = F.explode(F.array_compact(F.array(F.when(o % 3 == 0, F.lit("frames")), F.when(o % 13 == 0, F.lit("final")))))
    return cat.resumable(jobs, table(spark, sf, "orders").select(F.col("o_custkey").alias("job_id"), stages.alias("stage")))


@query("s03_s16_file_kinds", "SELECT page_id, regexp_matches(lower(url), '\\.html$') AS is_page, CAST(coalesce(TRY_CAST(regexp_extract(url || '.png', '([0-9]+)[^/0-9]*\\.[^./]+$', 1) AS INTEGER), 0) AS INTEGER) AS idx FROM pages")
def s03(spark, sf):
    """Addresses read as file paths: extension and the number in the name."""
    return table(spark, sf, "pages").select("page_id", (src.extension(F.col("url")) == ".html").alias("is_page"), src.stem_index(F.concat("url", F.lit(".png"))).alias("idx"))


@query("s09_permissive_documents", "SELECT event_id, TRY_CAST(json_extract_string(CASE WHEN event_id % 9 = 0 THEN NULL ELSE props END, '$.k') AS INTEGER) AS k FROM events")
def s09(spark, sf):
    """Documents that may be damaged: what can't be read is null."""
    t = F.when(F.col("event_id") % 9 == 0, F.lit("{broken")).otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", F.from_json(t, "k INT", {"mode": "PERMISSIVE"})["k"].alias("k"))


@query("s02_probe_records", "SELECT p_partkey, CASE WHEN p_partkey % 9 > 0 THEN p_size * 16 END AS width, CASE WHEN p_partkey % 9 > 0 THEN p_size * 9 END AS height, CASE WHEN p_partkey % 9 > 0 THEN CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size * 1000 / 1001.0::DOUBLE END END AS fps, CASE WHEN p_partkey % 9 > 0 THEN p_partkey END AS frame_count, CASE WHEN p_partkey % 9 > 0 THEN CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE round(p_partkey / (p_size * 1000 / 1001.0::DOUBLE), 6) END END AS duration FROM part")
def s02(spark, sf):
    """Reports of a probe, built from parts: some without a video stream, some with a rate of 0/0."""
    doc = F.expr("""concat('{"streams": [{"codec_type": "audio"}', if(p_partkey % 9 > 0, concat(', {"codec_type": "video", "width": ', p_size * 16, ', "height": ', p_size * 9, ', "avg_frame_rate": "', if(p_partkey % 4 = 0, '0/0', concat(p_size * 1000, '/1001')), '", "nb_frames": "', p_partkey, '"}'), ''), ']}')""")
    r = table(spark, sf, "part").select("p_partkey", payloads.probe_record(doc).alias("r"))
    return r.select("p_partkey", "r.width", "r.height", "r.fps", "r.frame_count", F.round("r.duration", 6).alias("duration"))


@query("s05_s07_checked_maps", "SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 'shape' WHEN vec_id % 7 = 0 THEN 'length' WHEN vec_id % 6 = 0 THEN 'type' END AS problem FROM embeddings")
def s05(spark, sf):
    """Vectors as 8 x 8 maps, some of them spoiled, held to the native shape and stored type."""
    i = F.col("vec_id")
    shape = F.array(F.lit(8), F.when(i % 10 == 0, 9).otherwise(8))
    values = F.when(i % 7 == 0, F.slice("embedding", 1, 63)).otherwise(F.slice("embedding", 1, 64))
    return table(spark, sf, "embeddings").select("vec_id", payloads.map_problem(shape, values, F.when(i % 6 == 0, "<f2").otherwise("<f4"), (8, 8), "<f4").alias("problem"))


@query("s18_removable_files", "SELECT page_id FROM pages WHERE NOT regexp_matches(url || '/frames/f_' || page_id || '.png', '(^|/)f_[^/]*[05]\\.png$')")
def s18(spark, sf):
    """Files of an intermediate folder that no pattern keeps."""
    files = table(spark, sf, "pages").select("page_id", F.concat("url", F.lit("/frames/f_"), F.col("page_id").cast("string"), F.lit(".png")).alias("path"))
    return payloads.removable(files, "path", ["frames"], ["f_*[05].png"]).select("page_id")


@query("s17_cache_lookup", "SELECT o_orderkey, c.c_custkey IS NOT NULL AS hit FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON o_custkey = c.c_custkey")
def s17(spark, sf):
    cached = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("hit"))
    return table(spark, sf, "orders").join(cached, "o_custkey", "left").select("o_orderkey", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("f18_encoder_lines", "SELECT event_id, CASE WHEN event_id % 4 > 0 THEN least(event_id, 5000) END AS frame FROM events")
def f18(spark, sf):
    line = F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("frame= "), F.col("event_id").cast("string"), F.lit(" fps=30"))).otherwise(F.lit("header"))
    return table(spark, sf, "events").select("event_id", progress.encoder_frame(line, F.lit(5000)).alias("frame"))


@query("c01_windowed_counts", "SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 8) AS mean_value FROM events GROUP BY ALL")
def c01(spark, sf):
    """Not among the surveyed operators: tumbling windows of one day, as on a stream."""
    out = progress.event_counts(table(spark, sf, "events"), "ts", ["event_type"])
    return out.withColumns({"mean_value": F.round("mean_value", 8)})
