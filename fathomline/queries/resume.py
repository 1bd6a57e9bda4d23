"""Stage graphs, audits and manifests (B-01, B-05, B-06, B-09). Documents and conversations stand in for jobs, turns for files."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.plans import manifests, stages
from fathomline.queries import query, table

_ORDER = [s for level in stages.levels(stages.EDGES) for s in level]
_PLACE = {s: i for i, s in enumerate(_ORDER)}
_text = lambda t: "NULL" if t is None else f"'{t}'"
_STAGES_SQL = ", ".join(f"({i}, '{s}')" for s, i in _PLACE.items())
_EDGES_SQL = ", ".join(f"({n}, {_PLACE[e.stage]}, {_PLACE[e.upstream]}, {list(e.accepted)}, '{e.reason}', '{e.otherwise}', CAST({_text(e.mode)} AS VARCHAR))" for n, e in enumerate(stages.EDGES))
_UNMET = "list_filter(coalesce(needs, []), lambda x: (x.mode IS NULL OR x.mode = r.mode) AND NOT list_contains(x.accepted, r.states[x.up + 1]) AND x.otherwise = '{0}')[1]"

_GRAPH_SQL = f"""
WITH RECURSIVE o(i, stage) AS (VALUES {_STAGES_SQL}),
e(n, i, up, accepted, reason, otherwise, mode) AS (VALUES {_EDGES_SQL}),
es AS (SELECT i, list({{'up': up, 'accepted': accepted, 'reason': reason, 'otherwise': otherwise, 'mode': mode}} ORDER BY n) AS needs FROM e GROUP BY i),
own AS (SELECT doc_id AS job_id, o.i, needs, (doc_id * 7 + o.i * 3) % 19 AS k FROM documents, o LEFT JOIN es ON es.i = o.i),
v AS (SELECT job_id, i, needs, CASE WHEN k < 3 THEN 'missing' WHEN k = 3 THEN 'invalidate' WHEN k < 6 THEN 'resume' ELSE 'preserve' END AS state, CASE WHEN k < 3 THEN 'absent' WHEN k < 6 THEN 'check ' || k ELSE 'reusable' END AS reason FROM own),
r AS (SELECT doc_id AS job_id, ['relative', 'metric', 'stabilized'][doc_id % 3 + 1] AS mode, -1 AS i, CAST([] AS VARCHAR[]) AS states, '' AS reason FROM documents
  UNION ALL SELECT job_id, mode, i, list_append(states, CASE WHEN state = 'missing' THEN state WHEN lost IS NOT NULL THEN lost.otherwise WHEN state = 'preserve' AND held IS NOT NULL THEN held.otherwise ELSE state END),
    CASE WHEN state = 'missing' THEN own_reason WHEN lost IS NOT NULL THEN lost.reason WHEN state = 'preserve' AND held IS NOT NULL THEN held.reason ELSE own_reason END
  FROM (SELECT r.job_id, r.mode, v.i, r.states, v.state, v.reason AS own_reason, {_UNMET.format('invalidate')} AS lost, {_UNMET.format('resume')} AS held FROM r JOIN v ON v.job_id = r.job_id AND v.i = r.i + 1))
SELECT job_id, o.stage, states[-1] AS state, reason FROM r JOIN o ON o.i = r.i
"""


@query("b01_stage_graph", _GRAPH_SQL)
def b01_graph(spark, sf):
    """All stages of each job, from the frames on, by the table of edges; what stages say by themselves is made up from ids."""
    job = F.col("doc_id")
    each = table(spark, sf, "documents").select(job.alias("job_id"), F.get(F.array(*map(F.lit, ("relative", "metric", "stabilized"))), (job % 3).cast("int")).alias("mode"), F.inline(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(i).alias("i")) for s, i in _PLACE.items()])))
    k = (F.col("job_id") * 7 + F.col("i") * 3) % 19
    checks = [stages.Check("check 3", k != 3), stages.Check("check 4", k != 4, stages.RESUME), stages.Check("check 5", k != 5, stages.RESUME)]
    own = each.select("job_id", "stage", "mode", stages.judged(k >= 3, checks).alias("verdict"))
    return stages.evaluate(own).select("job_id", "stage", "state", "reason")


_CHECKED = [*stages.CANONICAL, "frame_names", "num_frames", "source_raw_fingerprint", "source_model_fingerprint", "scene_manifest_fingerprint", "depth_bounds_fingerprint", "fingerprint"]


@query("b05_b06_canonical_audit", f"""WITH l AS (SELECT conv_id, count(*) AS n, count(*) FILTER (len(text) >= 40) AS fits FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 20 < 14 THEN 'invalidate' WHEN fits < n OR n <> conv_id % 3 + 2 THEN 'resume' ELSE 'preserve' END AS state,
CASE WHEN conv_id % 20 < 14 THEN {_CHECKED}[conv_id % 20 + 1] WHEN fits < n THEN 'payload will be regenerated' WHEN n <> conv_id % 3 + 2 THEN 'partly complete' ELSE 'reusable' END AS reason FROM l""")
def b05_b06(spark, sf):
    """Canonical documents of conversations, one field of most of them spoiled, held to the 14 checks and to their files (turns; short ones don't fit)."""
    k = F.col("conv_id") % 20
    mark = lambda kind: F.concat(F.lit(f"{kind} "), F.col("conv_id").cast("string"))
    value = {**{n: F.lit(v) for n, v in stages.CANONICAL.items()}, "frame_names": F.array(mark("a"), mark("b")), "num_frames": F.lit(2), "source_raw_fingerprint": mark("raw"), "source_model_fingerprint": mark("model"), "scene_manifest_fingerprint": mark("scenes"), "depth_bounds_fingerprint": mark("bounds")}
    spoiled = {"num_frames": F.lit(3), "near_value": F.lit(0.25), "far_value": F.lit(0.25), "encoding_scale": F.lit(1.0), "schema_version": F.lit(7), "algorithm_version": F.lit(7), "frame_names": F.array(mark("b"), mark("a"))}
    fields = [F.when(k == i, spoiled.get(n, F.lit("other"))).otherwise(v).alias(n) for i, (n, v) in enumerate(value.items())]
    jobs = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.length("text") >= 40, 1)).alias("fits"))
    jobs = jobs.withColumn("doc", manifests.sealed(F.to_json(F.struct(*fields))))
    jobs = jobs.withColumn("doc", F.when(k == 13, F.concat(F.lit('{"note": 1, '), F.substring("doc", 2, 1 << 20))).otherwise(F.col("doc"))).withColumn("hash", manifests.self_hash(F.col("doc")))
    schema = "schema_version int, algorithm_version int, representation string, near_value double, far_value double, encoding string, encoding_scale double, frame_names array<string>, num_frames int, source_raw_fingerprint string, source_model_fingerprint string, scene_manifest_fingerprint string, depth_bounds_fingerprint string, fingerprint string"
    checks = stages.canonical_checks(F.col("d"), F.col("hash"), value["frame_names"], value["source_raw_fingerprint"], value["source_model_fingerprint"], value["scene_manifest_fingerprint"], value["depth_bounds_fingerprint"])
    checks += stages.payload_checks(F.col("conv_id") % 3 + 2, F.col("n"), F.col("fits"))
    return jobs.withColumn("d", F.from_json("doc", schema)).select("conv_id", stages.judged(F.col("n") > 0, checks).alias("v")).select("conv_id", "v.state", "v.reason")


@query("b09_manifests", """WITH s AS (SELECT conv_id AS k, turn + 1 AS i, conv_id % 11 = 0 AND turn = 1 AS odd, sha256(CAST(turn + 1 AS VARCHAR) || chr(0) || 'frame_' || lpad(CAST(turn + 1 AS VARCHAR), 6, '0') || '.png') AS d FROM conversations),
a AS (SELECT k, count(*) AS n, count(DISTINCT i) AS dn, min(i) AS lo, max(i) AS hi FROM s GROUP BY k),
b AS (SELECT k, bool_or(odd) AND NOT bool_and(odd) AS uneven, sha256(count(*) || ':' || sum(CAST('0x' || d[1:8] AS BIGINT)) || ':' || sum(CAST('0x' || d[9:16] AS BIGINT)) || ':' || sum(CAST('0x' || d[17:24] AS BIGINT)) || ':' || sum(CAST('0x' || d[25:32] AS BIGINT))) AS digest FROM s WHERE NOT (k % 7 = 0 AND i = 1) GROUP BY k),
r AS (SELECT a.k AS conv_id, digest, CASE WHEN b.k IS NULL THEN 'absent' WHEN NOT (dn = a.n AND lo = 1 AND hi = a.n AND a.n <> 5) THEN 'manifest is missing' WHEN a.k % 5 = 0 THEN 'identity changed' WHEN a.k % 7 = 0 THEN 'files changed' WHEN uneven THEN 'invalid output header' ELSE 'reusable' END AS reason FROM a LEFT JOIN b ON b.k = a.k)
SELECT conv_id, digest, CASE reason WHEN 'absent' THEN 'missing' WHEN 'reusable' THEN 'preserve' ELSE 'invalidate' END AS state, reason FROM r""")
def b09(spark, sf):
    """Manifests of whole conversations, held to turns and settings some of which changed afterwards; and the digest of the turns that there are."""
    key = F.col("conv_id")
    turns = table(spark, sf, "conversations").select("conv_id", (F.col("turn") + 1).alias("frame_idx"))
    named = lambda height: turns.select("conv_id", "frame_idx", F.format_string("frame_%06d.png", F.col("frame_idx")).alias("name"), F.struct(F.lit(64).alias("width"), height.alias("height")).alias("header"))
    document = lambda source: F.to_json(F.struct(F.lit("crop").alias("stage"), F.struct(F.lit(0.5).alias("factor")).alias("settings"), source.alias("source")))
    jobs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    then = jobs.select("conv_id", F.when(F.col("n") == 5, 6).otherwise(F.col("n")).alias("expected"), document(key.cast("string")).alias("document"))
    now = jobs.select("conv_id", document(F.when(key % 5 == 0, "other").otherwise(key.cast("string"))).alias("document"))
    left = named(F.when((key % 11 == 0) & (F.col("frame_idx") == 2), 47).otherwise(48)).filter(~((key % 7 == 0) & (F.col("frame_idx") == 1)))
    states = manifests.reusable(now, manifests.complete(named(F.lit(48)), then, ["conv_id"]), left, ["conv_id"])
    digests = left.groupBy("conv_id").agg(manifests.file_digest(F.col("frame_idx"), [F.col("name")]).alias("digest"))
    return states.join(digests, "conv_id", "left").select("conv_id", "digest", "state", "reason")
