"""Summaries, advice, bounds and sidecars of jobs (B-11, B-12, P-25, J-10). Pages of a hundred ids are the files of a job, conversations are jobs with documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.plans import jobs
from fathomline.queries import query, table

_FOLDERS = [*jobs.FOLDERS, ""]
_FILES_SQL = f"""f AS (SELECT page_id // 100 AS job_id, {_FOLDERS}[(page_id * 7 + page_id // 100 * 5) % 12 % (page_id // 100 % 9 + 3) + 1] AS folder, 'f_' || page_id || CASE WHEN page_id % 3 = 0 THEN '.jpg' ELSE '.png' END AS name, len(url) * 3 AS w, (page_id % 7 + 1) * 40 AS h FROM pages)"""


def _files(spark, sf):
    i = F.col("page_id")
    folder = F.get(F.array(*map(F.lit, _FOLDERS)), ((i * 7 + F.floor(i / 100) * 5) % 12 % (F.floor(i / 100) % 9 + 3)).cast("int"))
    name = F.concat(F.lit("f_"), i.cast("string"), F.when(i % 3 == 0, ".jpg").otherwise(".png"))
    return table(spark, sf, "pages").select(F.floor(i / 100).alias("job_id"), folder.alias("folder"), name.alias("name"), (F.length("url") * 3).alias("width"), ((i % 7 + 1) * 40).cast("int").alias("height"))


def _summary_sql(variant: str) -> str:
    kinds = "name LIKE '%.png'" if variant == "most" else "true"
    square = "'over_under'" if variant == "most" else "CASE WHEN h > w * 1.5 THEN 'over_under' ELSE 'square' END"
    seen = "s.w IS NOT NULL" if variant == "most" else "s.w IS NOT NULL AND t.label IS NOT NULL"
    count = "m.n" if variant == "most" else "coalesce(t.n, 0)"
    return f"""WITH {_FILES_SQL}, d(place, folder, label) AS (VALUES {", ".join(f"({i}, '{f}', '{label}')" for i, (f, label) in enumerate(jobs.FOLDERS.items()))}),
g AS (SELECT job_id, f.folder, place, label, CAST(f.folder[1:2] AS INTEGER) AS number, count(*) FILTER ({kinds}) AS n FROM f JOIN d USING (folder) GROUP BY ALL),
j AS (SELECT DISTINCT job_id FROM f),
t AS (SELECT * FROM (SELECT job_id, label, n, row_number() OVER (PARTITION BY job_id ORDER BY number DESC, place) AS k FROM g WHERE n > 0 AND number > 0) WHERE k = 1),
m AS (SELECT job_id, coalesce(max(n), 0) AS n FROM g GROUP BY job_id),
s AS (SELECT * FROM (SELECT job_id, folder, w, h, row_number() OVER (PARTITION BY job_id ORDER BY place, name) AS k FROM f JOIN d USING (folder) WHERE name LIKE '%.png' AND folder <> '03_disparity_maps') WHERE k = 1),
r AS (SELECT j.job_id, coalesce(t.label, 'none') AS highest_stage, coalesce({count}, 0) AS frame_count, CASE WHEN {seen} THEN s.w || 'x' || s.h ELSE 'unknown' END AS resolution, CASE WHEN {seen} AND s.folder = '99_vr_frames' THEN CASE WHEN w > h * 1.5 THEN 'side_by_side' ELSE {square} END ELSE 'unknown' END AS vr_format FROM j LEFT JOIN t USING (job_id) LEFT JOIN m USING (job_id) LEFT JOIN s USING (job_id))
SELECT job_id, highest_stage, CAST(frame_count AS BIGINT) AS frame_count, resolution, vr_format, CASE WHEN vr_format <> 'unknown' THEN vr_format || ', ' || resolution ELSE 'unknown' END AS settings_summary FROM r"""


def _summary(variant):
    return lambda spark, sf: jobs.summaries(_files(spark, sf), variant).select("job_id", "highest_stage", "frame_count", "resolution", "vr_format", "settings_summary")


query("b11_summaries_by_most", _summary_sql("most"))(_summary("most"))
query("b11_summaries_by_highest", _summary_sql("highest"))(_summary("highest"))


@query("b12_advice", f"""WITH {_FILES_SQL}, g AS (SELECT job_id, count(*) FILTER (folder = '99_vr_frames' AND name LIKE '%.png') AS vr, count(*) FILTER (folder = '03_disparity_maps' AND name LIKE '%.png') AS maps FROM f GROUP BY job_id),
s AS (SELECT job_id, job_id % 7 AS k, CASE WHEN vr > 0 THEN vr ELSE maps END AS n FROM g)
SELECT job_id, k IN (3, 4, 5) AS can_resume, CASE WHEN k IN (3, 4, 5) THEN n ELSE 0 END AS frames_processed, k IN (3, 4, 5) AND n > 0 AS from_intermediates,
CASE WHEN k = 0 THEN 'No settings file found - cannot resume' WHEN k = 1 THEN 'Could not load settings file' WHEN k = 2 THEN 'Processing already completed' WHEN k IN (3, 4, 5) AND n > 0 THEN 'Found ' || n || ' processed frames - can resume from where left off' WHEN k IN (3, 4, 5) THEN 'No processed frames found - will restart from beginning' END AS recommendation FROM s""")
def b12(spark, sf):
    """Advice for jobs without settings, with broken ones, and of each status."""
    files = _files(spark, sf)
    status = F.array(*[F.lit(s) for s in ("", "", "completed", "in_progress", "paused", "failed", "odd")])
    k = (F.col("job_id") % 7).cast("int")
    document = F.when(k == 1, "{").when(k > 1, F.to_json(F.struct(F.struct(F.get(status, k).alias("processing_status")).alias("metadata"))))
    return jobs.advice(files.select("job_id").distinct().withColumn("document", document), files)


@query("p25_disk_bounds", """WITH s AS (SELECT doc_id // 100 AS job_id, n_chars % 90 + 10 AS h, doc_id % 60 + 20 AS w FROM documents),
a AS (SELECT job_id, count(*) AS n, sum(5 * h * w) AS pay, max(5 * h * w) AS most, max(h) AS h, max(w) AS w FROM s GROUP BY job_id)
SELECT job_id, CAST((5 * pay + 3) // 4 + greatest(16777216, 4096 * n) + (5 * most + 3) // 4 + 4096 AS BIGINT) AS metric, CAST(trunc(CASE WHEN job_id % 2 = 0 THEN n::DOUBLE * h * w * 4 * 1.25::DOUBLE + n::DOUBLE * h * w * 2 * 1.1::DOUBLE ELSE n::DOUBLE * h * w * 4 * 1.25::DOUBLE + 2::DOUBLE * h * w * 4 END) AS BIGINT) AS maps,
CAST(ceil((n * ceil(h * w * 2 * 1.1::DOUBLE) + (n // 3) * h * w * 4 + ceil(h * w * 2 * 1.1::DOUBLE) + 1048576) * 1.1::DOUBLE) AS BIGINT) AS stabilized FROM a""")
def p25(spark, sf):
    """The three bounds of jobs of a hundred documents, whose lengths and ids stand in for sizes of frames."""
    s = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 100).alias("job_id"), (F.col("n_chars") % 90 + 10).alias("h"), (F.col("doc_id") % 60 + 20).alias("w"))
    a = s.groupBy("job_id").agg(jobs.metric_bytes(F.col("h"), F.col("w"), F.lit(512)).alias("metric"), F.count(F.lit(1)).alias("n"), F.max("h").alias("h"), F.max("w").alias("w"))
    return a.select("job_id", "metric", jobs.map_bytes(F.col("n").cast("double"), F.col("w"), F.col("h"), F.lit(4), F.col("job_id") % 2 == 0).alias("maps"), jobs.stabilized_bytes(F.col("n"), F.floor(F.col("n") / 3), F.col("h"), F.col("w")).alias("stabilized"))


@query("j10_clamp_fractions", """WITH s AS (SELECT doc_id, n_chars AS v, n_chars // 3 AS c, doc_id % 11 AS k FROM documents),
r AS (SELECT *, CASE WHEN k = 0 THEN 'no sidecar' WHEN k = 1 THEN 'unreadable' WHEN k = 2 THEN 'schema' WHEN k = 3 THEN 'identity' WHEN k = 4 THEN 'counts' WHEN k = 5 THEN 'fraction' END AS problem FROM s)
SELECT doc_id, round(CASE WHEN problem IS NULL THEN CASE WHEN v = 0 THEN 0 ELSE c / v::DOUBLE END END, 9) AS fraction, problem FROM r""")
def j10_fractions(spark, sf):
    """Sidecars of documents, some of them spoiled: shares are counted again, and a stated share that isn't the counted one is a problem."""
    k, v = F.col("doc_id") % 11, F.col("n_chars")
    c = F.floor(v / 3)
    name = F.concat(F.lit("frame_"), F.col("doc_id").cast("string"))
    share = F.when(v == 0, 0.0).otherwise(c / v)
    stated = F.struct(F.lit(1).alias("schema_version"), F.when(k == 3, "other").otherwise(name).alias("frame_name"), v.alias("valid_pixel_count"), F.when(k == 4, v + 1).otherwise(c).alias("clamped_pixel_count"), F.when(k == 5, share + 0.001).otherwise(share).alias("clamped_fraction"))
    document = F.when(k == 1, "{").when(k == 2, '{"schema_version": 1}').otherwise(F.to_json(stated))
    rows = table(spark, sf, "documents").select("doc_id", name.alias("frame_name"), document.alias("document"))
    found = jobs.clamp_fractions(rows.select("doc_id", "frame_name"), rows.filter(k != 0), ["doc_id"])
    return found.select("doc_id", F.round("fraction", 9).alias("fraction"), "problem")
