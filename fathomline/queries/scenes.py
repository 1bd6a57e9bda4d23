"""Scene samples and chained windows (A-03, A-04, W-03, W-05, W-06). Vectors are maps of 8 x 8; runs of 200 ids are clips, of 60 frames scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import scenes, windows
from fathomline.queries import query, table

CLIP, SCENE = 200, 60


def _maps(spark, sf):
    """clip_id, scene_id, frame_idx, h, w, values; a vector's first 64 components."""
    i = F.col("vec_id")
    return table(spark, sf, "embeddings").select(F.floor(i / CLIP).alias("clip_id"), F.floor(i % CLIP / SCENE).alias("scene_id"), (i % CLIP).alias("frame_idx"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.slice("embedding", 1, 64).alias("values"))


def _samples(spark, sf):
    return scenes.scene_samples(_maps(spark, sf), "clip_id", "scene_id", "frame_idx", "values", "h", "w", frames=12, places=4)


_SAMPLES_SQL = f"""m AS (SELECT vec_id // {CLIP} AS clip_id, vec_id % {CLIP} // {SCENE} AS scene_id, row_number() OVER (PARTITION BY vec_id // {CLIP}, vec_id % {CLIP} // {SCENE} ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY vec_id // {CLIP}, vec_id % {CLIP} // {SCENE}) AS n, embedding AS e FROM embeddings),
p AS (SELECT DISTINCT n, CASE WHEN n <= 12 THEN k ELSE CAST(round_even(k * (n - 1) / 11.0::DOUBLE, 0) AS BIGINT) END AS i FROM (SELECT DISTINCT n FROM m), range(0, 12) AS r(k) WHERE k < n),
v AS (SELECT clip_id, scene_id, i, CAST(e[y * 8 + x + 1] AS DOUBLE) AS v FROM m JOIN p USING (n, i), (SELECT unnest([0, 2, 5, 7]) AS y), (SELECT unnest([0, 2, 5, 7]) AS x))"""


@query("a03_scene_samples", f"WITH {_SAMPLES_SQL} SELECT clip_id, scene_id, count(DISTINCT i) AS frames, CAST(count(*) AS INTEGER) AS n, round(quantile_cont(v, 0.02), 6) AS low, round(quantile_cont(v, 0.98), 6) AS high FROM v GROUP BY clip_id, scene_id")
def a03_samples(spark, sf):
    """Bounds of each scene by the values at 4 x 4 places of at most 12 frames."""
    s = _samples(spark, sf)
    n = F.size("sample")

    def at(q):
        place = q * (n - 1)
        low = F.floor(place).cast("int")
        a, b = F.get("sample", low).cast("double"), F.coalesce(F.get("sample", low + 1), F.get("sample", low)).cast("double")
        return F.round(a + (b - a) * (place - low), 6)

    return s.select("clip_id", "scene_id", "frames", n.alias("n"), at(F.lit(0.02)).alias("low"), at(F.lit(0.98)).alias("high"))


@query("a03_a04_convergence", f"WITH {_SAMPLES_SQL} SELECT clip_id, round(median(v), 6) AS convergence, count(*) AS n FROM v GROUP BY clip_id")
def a04_samples(spark, sf):
    """The median of each clip over the samples of its scenes."""
    each = _samples(spark, sf).select("clip_id", F.explode("sample").alias("v"))
    return each.groupBy("clip_id").agg(F.round(F.median("v"), 6).alias("convergence"), F.count(F.lit(1)).alias("n"))


@query("w03_merged_scenes")
def w03_scenes(spark, sf):
    """Scenes of alike sample bounds, merged to a fixed point by the tails of their samples."""
    return scenes.merge_scenes(_samples(spark, sf), "clip_id", "scene_id")


_SCALE, _SHIFT = "(1 + 0.25::DOUBLE * ({0} % 3))", "(0.5::DOUBLE * ({0} % 2))"
_POINTS = "[m[1][1], m[1][2], m[2][1], m[2][2]]"

_CHAIN_SQL = f"""
WITH RECURSIVE f AS (SELECT vec_id // {CLIP} AS clip_id, row_number() OVER (PARTITION BY vec_id // {CLIP} ORDER BY vec_id) - 1 AS i, [CAST(embedding[1] AS DOUBLE) + 1, CAST(embedding[2] AS DOUBLE) + 10] AS v FROM embeddings),
c AS (SELECT clip_id, count(*) AS n FROM f GROUP BY clip_id),
w AS (SELECT clip_id, n, unnest(range(0, (n + 21) // 22)) AS w FROM c),
p AS (SELECT clip_id, n, w, p, least(n - 1, CASE WHEN w > 0 AND p = 0 THEN 0 WHEN w > 0 AND p = 1 THEN (w - 1) * 22 + 12 ELSE w * 22 + p END) AS i FROM w, range(0, 32) AS r(p)),
m AS (SELECT clip_id, n, w, list([v[1] * {_SCALE.format('w')} + {_SHIFT.format('w')}, v[2] * {_SCALE.format('w')} + {_SHIFT.format('w')}] ORDER BY p) AS m FROM p JOIN f USING (clip_id, i) GROUP BY clip_id, n, w),
r AS (SELECT clip_id, n, 0 AS w, m[1] AS r0, m[13] AS r1, m[25:32] AS pending, m[1:24] AS final, 0 AS start FROM m WHERE w = 0
  UNION ALL SELECT clip_id, n, w, r0, a[11], a[23:30], list_concat(list_transform(range(1, 9), lambda j: [pending[j][1] * (1 - j / 9.0::DOUBLE) + a[j][1] * j / 9.0::DOUBLE, pending[j][2] * (1 - j / 9.0::DOUBLE) + a[j][2] * j / 9.0::DOUBLE]), a[9:22]), w * 22 + 2
  FROM (SELECT clip_id, n, w, r0, pending, list_transform(m[3:32], lambda q: [greatest(0, q[1] * s + my - s * mx), greatest(0, q[2] * s + my - s * mx)]) AS a
    FROM (SELECT *, CASE WHEN list_sum(list_transform(x, lambda t: (t - mx) * (t - mx))) > 0 THEN list_sum(list_transform(range(1, 5), lambda k: (x[k] - mx) * (y[k] - my))) / list_sum(list_transform(x, lambda t: (t - mx) * (t - mx))) ELSE 1 END AS s
      FROM (SELECT *, list_avg(x) AS mx, list_avg(y) AS my FROM (SELECT m.clip_id, m.n, m.w, r.r0, r.pending, m.m, {_POINTS.replace('m[', 'm.m[')} AS x, [r.r0[1], r.r0[2], r.r1[1], r.r1[2]] AS y FROM r JOIN m ON m.clip_id = r.clip_id AND m.w = r.w + 1)))))
SELECT clip_id, start + k - 1 AS frame_idx, round(final[k][1], 6) AS first, round(final[k][2], 6) AS second FROM r, range(1, 25) AS g(k) WHERE k <= len(final) AND start + k - 1 < n
"""


@query("w05_w06_chained_windows", _CHAIN_SQL)
def w05_chain(spark, sf):
    """Windows of 32 maps of two values, each predicted on a scale of its own, chained by two references and eight blended maps."""
    shape = windows.Shape()
    i = F.col("vec_id")
    ids = table(spark, sf, "embeddings").select(F.floor(i / CLIP).alias("clip_id"), (i % CLIP).alias("frame_idx"), F.array(F.col("embedding")[0].cast("double") + 1, F.col("embedding")[1].cast("double") + 10).alias("v"))
    n = ids.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"))
    w, p = F.col("window"), F.col("position")
    place = F.when((w > 0) & (p == 0), 0).when((w > 0) & (p == 1), (w - 1) * shape.step + shape.second).otherwise(w * shape.step + p)
    plan = n.withColumn("window", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / shape.step).cast("int") - 1))).withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(shape.size - 1))))
    seen = plan.withColumn("frame_idx", F.least(F.col("n") - 1, place)).join(ids, ["clip_id", "frame_idx"])
    drift = F.transform("v", lambda v: v * (1 + 0.25 * (w % 3)) + 0.5 * (w % 2))
    out = windows.chained(seen.select("clip_id", "window", "position", "n", drift.alias("values")), shape)
    return out.select("clip_id", "frame_idx", F.round(F.col("values")[0], 6).alias("first"), F.round(F.col("values")[1], 6).alias("second"))
