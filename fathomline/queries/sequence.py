"""Ordered-sequence operators (W-*), sorting (L-*), and the flagship query."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from fathomline.functions import depth
from fathomline.operators import sequences as seq, statistics as st
from fathomline.plans import catalogue as cat
from fathomline.queries import FRAMES_SQL, frames, query, table

_SEGMENTS = f"WITH {FRAMES_SQL}, d AS (SELECT *, coalesce(abs(value - lag(value) OVER (PARTITION BY clip_id ORDER BY frame_idx)) > 150, false) AS cut FROM f), s AS (SELECT *, CAST(sum(cut::INT) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS INTEGER) AS segment_id FROM d)"


def _segments(spark, sf):
    f = frames(spark, sf)
    step = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("clip_id").orderBy("frame_idx")))
    return seq.segment_ids(f.withColumn("cut", F.coalesce(step > 150, F.lit(False))), "clip_id", "frame_idx", F.col("cut"))


@query("flagship_segment_codes", _SEGMENTS + ", b AS (SELECT clip_id, segment_id, quantile_cont(value, 0.02) AS low, quantile_cont(value, 0.98) AS high FROM s GROUP BY ALL) SELECT clip_id, frame_idx, segment_id, CAST(CASE WHEN high > low THEN round_even(greatest(0, least(1, (value - low) / (high - low))) * 65535, 0) ELSE 32768 END AS INTEGER) AS code FROM s JOIN b USING (clip_id, segment_id)")
def flagship(spark, sf):
    """Segments by jumps of the value, exact percentile bounds of each, and every frame's code between them.

    Bounds come from an aggregate on the key that the window already dealt frames by, and join back on it, so frames are shuffled once.
    """
    s = _segments(spark, sf)
    b = st.interpolated(s, ["clip_id", "segment_id"], "value", [0.02, 0.98]).select("clip_id", "segment_id", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    return s.join(b, ["clip_id", "segment_id"]).select("clip_id", "frame_idx", "segment_id", depth.encode(depth.canonical(F.col("value"), F.col("low"), F.col("high"))).alias("code"))


_DISTANCE = "WITH h AS (SELECT vec_id, label, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS h FROM embeddings), p AS (SELECT vec_id, label, h, lag(h) OVER (PARTITION BY label ORDER BY vec_id) AS g, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM h)"


def _distances(spark, sf):
    w = Window.partitionBy("label").orderBy("vec_id")
    h = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("h"))
    h = h.withColumns({"g": F.lag("h").over(w), "frame_idx": F.row_number().over(w) - 1})
    return h.select("vec_id", "label", "frame_idx", F.when(F.col("g").isNotNull(), seq.histogram_distance(F.col("g"), F.col("h"))).alias("distance"))


@query("w01_histogram_distance", _DISTANCE + " SELECT vec_id, label, CAST(i AS INTEGER) AS frame_idx, round(CASE WHEN g IS NOT NULL THEN sqrt(greatest(0, 1 - list_sum(list_transform(list_zip(h, g), lambda z: sqrt(z[1] * z[2]))) / sqrt(list_sum(h) * list_sum(g)))) END, 6) AS distance FROM p")
def w01(spark, sf):
    return _distances(spark, sf).select("vec_id", "label", "frame_idx", F.round("distance", 6).alias("distance"))


@query("w01_accepted_cuts")
def w01_cuts(spark, sf):
    """Cuts of each label's sequence of vectors: a fold over candidates, for which SQL has no window."""
    return seq.accepted_cuts(_distances(spark, sf), "label", "frame_idx", "distance", 0.30, 4)


@query("w02_ranges", _SEGMENTS + ", a AS (SELECT clip_id, segment_id, min(frame_idx) AS start_frame FROM s GROUP BY ALL), n AS (SELECT clip_id, count(*) AS n FROM f GROUP BY clip_id) SELECT clip_id, segment_id, start_frame, CAST(coalesce(lead(start_frame) OVER (PARTITION BY clip_id ORDER BY start_frame), n) AS BIGINT) AS end_frame FROM a JOIN n USING (clip_id)")
def w02(spark, sf):
    s = _segments(spark, sf)
    starts = s.groupBy("clip_id", "segment_id").agg(F.min("frame_idx").alias("start_frame"), F.count(F.lit(1)).alias("k")).withColumn("n", F.sum("k").over(Window.partitionBy("clip_id")))
    return seq.ranges(starts, "clip_id", "start_frame", "n").select("clip_id", "segment_id", "start_frame", F.col("end").cast("long").alias("end_frame"))


@query("w03_merged_segments")
def w03(spark, sf):
    """Neighbouring segments of alike bounds, merged to a fixed point."""
    return seq.merge_segments(_segments(spark, sf), "clip_id", "segment_id", "value")


@query("w05_w07_window_plans", f"WITH {FRAMES_SQL}, n AS (SELECT clip_id, count(*) AS n FROM f GROUP BY clip_id), a AS (SELECT clip_id, n, 'overlapping' AS plan, unnest(range(0, n, 22)) AS start_frame, 32 AS size FROM n), b AS (SELECT clip_id, n, 'until_end' AS plan, unnest(range(0, CAST(greatest(0, ceil((n - 32) / 28.0)) AS BIGINT) * 28 + 1, 28)) AS start_frame, 32 AS size FROM n) SELECT clip_id, plan, CAST(start_frame AS INTEGER) AS start_frame, CAST(least(n, start_frame + size) AS INTEGER) AS end_frame FROM (SELECT * FROM a UNION ALL SELECT * FROM b)")
def w05(spark, sf):
    n = frames(spark, sf).groupBy("clip_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    plans = [n.select("clip_id", "n", F.lit(name).alias("plan"), F.explode(seq.window_starts(F.col("n"), 32, stride, end)).alias("start_frame")) for name, stride, end in (("overlapping", 22, False), ("until_end", 28, True))]
    return plans[0].unionByName(plans[1]).select("clip_id", "plan", "start_frame", F.least("n", F.col("start_frame") + 32).alias("end_frame"))


@query("w06_w07_aligned_windows")
def w06(spark, sf):
    """Windows of 32 frames, each fitted to the last 4 of what came before."""
    return seq.align_windows(frames(spark, sf), "clip_id", "frame_idx", "value", 32, 4)


@query("w08_nearest_valid", f"WITH {FRAMES_SQL} SELECT clip_id, frame_idx, CAST(max(CASE WHEN event_type <> 'error' THEN frame_idx END) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS INTEGER) AS left_index, CAST(min(CASE WHEN event_type <> 'error' THEN frame_idx END) OVER (PARTITION BY clip_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS INTEGER) AS right_index FROM f")
def w08(spark, sf):
    return seq.nearest_valid(frames(spark, sf), ["clip_id"], "frame_idx", F.col("event_type") != "error").select("clip_id", "frame_idx", "left_index", "right_index")


@query("w09_filled_gaps", f"""WITH {FRAMES_SQL}, v AS (SELECT *, event_type <> 'error' AS ok, max(frame_idx) OVER (PARTITION BY clip_id) AS last_idx FROM f),
g AS (SELECT *, max(CASE WHEN ok THEN frame_idx END) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS l, min(CASE WHEN ok THEN frame_idx END) OVER (PARTITION BY clip_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM v),
j AS (SELECT g.*, a.value AS lv, b.value AS rv FROM g LEFT JOIN f a ON a.clip_id = g.clip_id AND a.frame_idx = g.l LEFT JOIN f b ON b.clip_id = g.clip_id AND b.frame_idx = g.r),
k AS (SELECT *, NOT ok AND (l IS NOT NULL OR r IS NOT NULL) AND coalesce(r, last_idx + 1) - coalesce(l, -1) - 1 <= 2 AS fillable FROM j)
SELECT clip_id, frame_idx, CASE WHEN ok THEN value WHEN fillable THEN CASE WHEN r IS NULL OR (l IS NOT NULL AND (lv < rv OR (lv = rv AND frame_idx - l <= r - frame_idx))) THEN lv ELSE rv END END AS filled, NOT ok AND NOT fillable AS is_hole FROM k""")
def w09(spark, sf):
    f = frames(spark, sf).withColumn("ok", F.col("event_type") != "error")
    return seq.fill_gaps(f, ["clip_id"], "frame_idx", "ok", "value", "value", 2).select("clip_id", "frame_idx", "filled", "is_hole")


@query("w11_runs", f"WITH {FRAMES_SQL}, m AS (SELECT clip_id, frame_idx, frame_idx - row_number() OVER (PARTITION BY clip_id ORDER BY frame_idx) AS g FROM f WHERE value > 60) SELECT clip_id, min(frame_idx) AS run_start, max(frame_idx) AS run_end, count(*) AS run_length FROM m GROUP BY clip_id, g")
def w11(spark, sf):
    return seq.runs_where(frames(spark, sf), ["clip_id"], "frame_idx", F.col("value") > 60)


@query("w13_remaining_time", "WITH e AS (SELECT event_id, value / 8 AS p, event_id % 100 AS el, event_id % 40 AS d, 60 AS tot, event_id % 20 AS se, event_id % 3 > 0 AS more FROM events), o AS (SELECT *, CASE WHEN d > 0 AND se >= 2 THEN se / greatest(d, 1)::DOUBLE * (tot - d) ELSE 0 END AS own FROM e), m AS (SELECT *, CASE WHEN more AND p > 5 THEN CASE WHEN own > 0 THEN own * 0.8 + el / p * (100 - p) * 0.2 ELSE el / p * (100 - p) END ELSE own END AS mixed FROM o), l AS (SELECT *, CASE WHEN mixed <= 0 THEN el / (p / 100.0) - el ELSE mixed END AS lft FROM m) SELECT event_id, round(CASE WHEN p > 0 AND el >= 3 AND lft >= 0 THEN lft END, 6) AS seconds_left FROM l")
def w13(spark, sf):
    c = F.col("event_id")
    left = cat.remaining_seconds(F.col("value") / 8, c % 100, c % 40, F.lit(60), c % 20, c % 3 > 0)
    return table(spark, sf, "events").select("event_id", F.round(left, 6).alias("seconds_left"))


@query("l01_numeric_order", "SELECT page_id, url, CAST(coalesce(TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS INTEGER), 0) AS INTEGER) AS number, row_number() OVER (ORDER BY coalesce(TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS INTEGER), 0), page_id) AS place FROM pages")
def l01(spark, sf):
    """Pages by the number in their address. A total order with places.

    Rows are placed inside (number, block of ids), so a number that many pages share is spread; blocks are counted up inside
    chunks of numbers, and chunks, of which there are 2^21 at most, in one window.
    """
    p = table(spark, sf, "pages").select("page_id", "url", F.coalesce(F.regexp_extract("url", "/([0-9]+)", 1).try_cast("int"), F.lit(0)).alias("number"))
    p = p.withColumn("block", F.coalesce(F.floor(F.col("page_id") / 65536), F.lit(-1)))
    chunk, earlier = F.floor(F.col("number") / 1024), lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    counts = p.groupBy("number", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("chunk", chunk)
    chunks = counts.groupBy("chunk").agg(F.sum("n").alias("all")).select("chunk", F.coalesce(F.sum("all").over(earlier(Window.orderBy("chunk"))), F.lit(0)).alias("chunks_before"))
    inside = F.coalesce(F.sum("n").over(earlier(Window.partitionBy("chunk").orderBy("number", "block"))), F.lit(0))
    before = counts.withColumn("blocks_before", inside).join(chunks, "chunk").select("number", "block", (F.col("blocks_before") + F.col("chunks_before")).alias("before"))
    i = F.row_number().over(Window.partitionBy("number", "block").orderBy("page_id"))
    return p.withColumn("i", i).join(before, ["number", "block"]).select("page_id", "url", "number", (F.col("before") + F.col("i")).alias("place"))


@query("l02_ordered_map", "SELECT event_id, length(props) AS size, upper(event_type) AS kind FROM events")
def l02(spark, sf):
    """A Python function over batches, results in input order."""

    def work(pdf):
        import pandas as pd

        return pd.DataFrame({"size": pdf["props"].str.len().astype("int64"), "kind": pdf["event_type"].str.upper()})

    return seq.ordered_map(table(spark, sf, "events").select("event_id", "event_type", "props"), "event_id", work, "size long, kind string")


@query("l05_halving_sizes", "WITH RECURSIVE s(p_partkey, size) AS (SELECT p_partkey, CAST(p_size * 97 AS INTEGER) FROM part UNION ALL SELECT p_partkey, size // 2 FROM s WHERE size // 2 >= 384) SELECT p_partkey, size FROM s")
def l05(spark, sf):
    """Sizes by halving down to 384, as many as a size's logarithm allows, so no recursion is needed."""
    halvings = F.floor(F.log2(F.greatest(F.col("p_size") * 97, F.lit(1)))).cast("int")
    sizes = F.transform(F.sequence(F.lit(0), halvings), lambda k: F.floor(F.col("p_size") * 97 / F.pow(F.lit(2.0), k)).cast("int"))
    some = F.filter(sizes, lambda s, i: (i == 0) | (s >= 384))
    return table(spark, sf, "part").select("p_partkey", F.explode(some).alias("size"))
