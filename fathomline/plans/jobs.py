"""What a job's folders say of it: summaries, advice on resuming, disk bounds, and sidecars that are counted again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathomline.plans.stages import Check, judged

#: Folders of frames, from the last stage to the first, and what they are called.
FOLDERS = {
    "99_vr_frames": "Final VR frames",
    "07_left_upscaled": "Upscaled left frames",
    "07_right_upscaled": "Upscaled right frames",
    "06_left_cropped": "Cropped left frames",
    "06_right_cropped": "Cropped right frames",
    "05_left_distorted": "Distorted left frames",
    "05_right_distorted": "Distorted right frames",
    "04_left_frames": "Stereo left frames",
    "04_right_frames": "Stereo right frames",
    "03_disparity_maps": "Canonical disparity maps",
    "00_original_frames": "Original frames",
}
#: Folders in which a frame's size isn't the view's, and how much wider (or higher) than high (wide) two views are.
NO_VIEWS = ("03_disparity_maps",)
WIDE = 1.5


def summaries(files: DataFrame, variant: str, job: str = "job_id") -> DataFrame:
    """A row for each job: highest_stage, frame_count, resolution, vr_format, has_audio, settings_summary.

    ``files``: job, folder, name, width, height (null unless the header was read). Two counts are in use. ``most``: of PNG files, the most of any stage. ``highest``: of
    PNG and JPEG files, those of the highest stage; it alone tells square views from stacked ones. Files are summed by folder where they lie, then
    folders by job.
    """
    if variant not in ("most", "highest"):
        raise ValueError(f"unknown variant: {variant}")
    name = F.lower("name")
    png = name.endswith(".png")
    frame = png if variant == "most" else png | name.endswith(".jpg")
    places = F.create_map(*[F.lit(x) for i, f in enumerate(FOLDERS) for x in (f, i)])
    numbers = F.create_map(*[F.lit(x) for f in FOLDERS for x in (f, int(f.split("_")[0]))])
    audio = F.bool_or((F.col("folder") == "") & ((F.col("name") == "original_audio.flac") | name.rlike(r"\.(mp4|avi|mov|mkv|webm)$")))
    sample = F.min(F.when(png & F.col("width").isNotNull(), F.struct("name", "width", "height")))
    by = files.groupBy(job, "folder").agg(F.count(F.when(frame, 1)).alias("n"), sample.alias("sample"), audio.alias("audio"))
    at, number = F.try_element_at(places, F.col("folder")), F.try_element_at(numbers, F.col("folder"))
    stage = F.when((F.col("n") > 0) & (number > 0), F.struct(number.alias("number"), (-at).alias("place"), "folder", "n"))
    shown = F.when(at.isNotNull() & ~F.col("folder").isin(*NO_VIEWS) & F.col("sample").isNotNull(), F.struct(at.alias("place"), "folder", "sample"))
    most = F.max(F.when(at.isNotNull(), F.col("n")))
    jobs = by.groupBy(job).agg(F.max(stage).alias("top"), F.min(shown).alias("shown"), F.coalesce(F.bool_or("audio"), F.lit(False)).alias("has_audio"), F.coalesce(most, F.lit(0)).alias("most"))
    labels = F.create_map(*[F.lit(x) for pair in FOLDERS.items() for x in pair])
    w, h = F.col("shown.sample.width"), F.col("shown.sample.height")
    kind = F.when(w > h * WIDE, "side_by_side").when((h > w * WIDE) if variant == "highest" else F.lit(True), "over_under").otherwise("square")
    seen = F.col("shown").isNotNull() & (F.lit(variant == "most") | F.col("top").isNotNull())
    out = jobs.select(
        job,
        F.coalesce(F.try_element_at(labels, F.col("top.folder")), F.lit("none")).alias("highest_stage"),
        (F.col("most") if variant == "most" else F.coalesce("top.n", F.lit(0))).alias("frame_count"),
        F.when(seen, F.concat_ws("x", w, h)).otherwise("unknown").alias("resolution"),
        F.when(seen & (F.col("shown.folder") == "99_vr_frames"), kind).otherwise("unknown").alias("vr_format"),
        "has_audio",
    )
    known = (F.col("vr_format") != "unknown") & (F.col("resolution") != "unknown")
    return out.withColumn("settings_summary", F.when(known, F.concat_ws(", ", "vr_format", "resolution")).otherwise("unknown"))


def advice(jobs: DataFrame, files: DataFrame, job: str = "job_id") -> DataFrame:
    """job, can_resume, frames_processed, from_intermediates, recommendation.

    ``jobs``: job, document (the newest settings document as text, null without one). ``files``: job, folder, name. Frames that were assembled count
    before canonical maps; jobs of an unknown status get no recommendation.
    """
    of = lambda folder: F.count(F.when((F.col("folder") == folder) & F.col("name").endswith(".png"), 1))
    n = files.groupBy(job).agg(of("99_vr_frames").alias("__vr"), of("03_disparity_maps").alias("__maps"))
    status = F.get_json_object("document", "$.metadata.processing_status")
    whole = F.json_object_keys("document").isNotNull()
    goes_on = whole & status.isin("in_progress", "paused", "failed")
    done = F.when(F.col("__vr") > 0, F.col("__vr")).otherwise(F.coalesce("__maps", F.lit(0)))
    text = (
        F.when(F.col("document").isNull(), "No settings file found - cannot resume")
        .when(~whole, "Could not load settings file")
        .when(status == "completed", "Processing already completed")
        .when(goes_on & (done > 0), F.concat(F.lit("Found "), done.cast("string"), F.lit(" processed frames - can resume from where left off")))
        .when(goes_on, "No processed frames found - will restart from beginning")
    )
    both = jobs.join(n, job, "left")
    frames = F.when(goes_on, done).otherwise(0)
    return both.select(job, F.coalesce(goes_on, F.lit(False)).alias("can_resume"), F.coalesce(frames, F.lit(0)).cast("long").alias("frames_processed"), F.coalesce(goes_on & (done > 0), F.lit(False)).alias("from_intermediates"), text.alias("recommendation"))


# --- disk bounds --------------------------------------------------------------------------------------------------------

#: Room for what compression may add to raw and canonical maps, the least unit of allocation, and room for documents.
RAW_ROOM, CANONICAL_ROOM = 1.25, 1.10
UNIT, DOCUMENTS = 4096, 16 << 20


def map_bytes(frames: Column, width: Column, height: Column, stored: Column, keep: Column) -> Column:
    """Bytes that raw and canonical maps may take at most: both where intermediates are kept, else the larger and two maps being replaced."""
    pixels = width.cast("double") * height
    raw, canonical = frames * pixels * stored * RAW_ROOM, frames * pixels * 2 * CANONICAL_ROOM
    return F.when(keep, raw + canonical).otherwise(F.greatest(raw, canonical) + 2 * pixels * F.greatest(stored, F.lit(2))).cast("long")


def metric_bytes(height: Column, width: Column, unit: Column, previews: bool = False) -> Column:
    """An aggregate over frames: a fourth more than the payload, a unit or room for documents, and the largest frame twice."""
    payload = (height.cast("long") * width) * (6 if previews else 5)
    room = lambda n: F.ceil(n * 1.25).cast("long")
    each = F.greatest(F.lit(UNIT), F.max(unit)).cast("long")
    return F.coalesce(room(F.sum(payload)) + F.greatest(F.lit(DOCUMENTS), each * F.count(payload)) + room(F.max(payload)) + each, F.lit(0).cast("long"))


def stabilized_bytes(pending: Column, largest: Column, height: Column, width: Column) -> Column:
    """Bytes for shots that are still to be written: every frame and one more, the largest shot's maps in single precision, and a MiB, with a tenth to spare."""
    pixels = height.cast("long") * width
    frame = F.ceil(pixels * 2 * CANONICAL_ROOM)
    return F.ceil((pending * frame + largest * pixels * 4 + frame + (1 << 20)) * 1.10)


# --- sidecars -----------------------------------------------------------------------------------------------------------

SIDECAR = "schema_version INT, frame_name STRING, valid_pixel_count LONG, clamped_pixel_count LONG, clamped_fraction DOUBLE"
_KEYS = ("clamped_fraction", "clamped_pixel_count", "frame_name", "schema_version", "valid_pixel_count")


def clamp_fractions(frames: DataFrame, sidecars: DataFrame, by: list[str], frame: str = "frame_name", document: str = "document") -> DataFrame:
    """by, frame, fraction, problem: each frame's clamped share, recomputed from the counts of its sidecar; null with a problem's name.

    A frame without a sidecar and a sidecar without a frame are problems too.
    """
    d, counted = F.col("__d"), F.try_divide(F.col("__d.clamped_pixel_count").cast("double"), F.col("__d.valid_pixel_count").cast("double"))
    expected = F.when(F.col("__d.valid_pixel_count") == 0, 0.0).otherwise(counted)
    checks = [
        Check("no frame", F.col("__f").isNotNull()),
        Check("unreadable", F.json_object_keys(document).isNotNull()),
        Check("schema", F.array_sort(F.json_object_keys(document)) == F.array(*map(F.lit, _KEYS))),
        Check("identity", (d["schema_version"] == 1) & (d["frame_name"] == F.col(frame))),
        Check("counts", (d["clamped_pixel_count"] >= 0) & (d["clamped_pixel_count"] <= d["valid_pixel_count"])),
        Check("fraction", d["clamped_fraction"].between(0.0, 1.0) & (d["clamped_fraction"] == expected)),
    ]
    both = frames.select(*by, frame, F.lit(True).alias("__f")).join(sidecars.select(*by, frame, document, F.from_json(document, SIDECAR).alias("__d"), F.lit(True).alias("__s")), [*by, frame], "full_outer")
    v = judged(F.col("__s"), checks, "ok", "ok")
    problem = F.when(v["state"] == "missing", "no sidecar").when(v["state"] != "ok", v["reason"])
    return both.select(*by, frame, F.when(problem.isNull(), expected).alias("fraction"), problem.alias("problem"))
