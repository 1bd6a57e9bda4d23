"""Which results of a job can be kept: audits, dispositions and progress as queries over catalogue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: For each generated stage, the upstream stages and the states of theirs that it accepts.
STAGE_NEEDS = {
    "distortion": {"stereo": ("preserve", "resume")},
    "crop": {"stereo": ("preserve", "resume"), "distortion": ("preserve", "missing")},
    "upscale": {"crop": ("preserve", "missing")},
    "assemble": {"stereo": ("preserve", "resume"), "crop": ("preserve", "missing"), "upscale": ("preserve", "missing")},
}


def first_failing(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that fails, null if all hold. A check that can't be made fails."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks])


def stage_state(exists: Column, upstream_ok: Column, setting_changed: Column, has_manifest: Column, manifest_ok: Column) -> tuple[Column, Column]:
    """Disposition of a generated stage, and why."""
    reason = (
        F.when(~exists, "missing")
        .when(~upstream_ok, "upstream")
        .when(setting_changed, "setting changed")
        .when(~has_manifest, "manifest missing")
        .when(~manifest_ok, "manifest invalid")
        .otherwise("reusable")
    )
    return F.when(reason == "missing", "missing").when(reason == "reusable", "preserve").otherwise("invalidate"), reason


def resume_report(stages: DataFrame, job: str = "job_id") -> DataFrame:
    """A row for each job: the state of every generated stage, in the order of their needs.

    ``stages``: job, stage, exists, setting_changed, has_manifest, manifest_ok, and for stereo its state. The rows of a job
    become one, and each stage is then an expression of earlier ones, so there is one shuffle. It comes before anything is
    sorted: aggregating first would save nothing and hold all rows that a task reads.
    """
    names = ["stereo", *STAGE_NEEDS]
    dealt = stages.repartition(int(stages.sparkSession.conf.get("spark.sql.shuffle.partitions")), job)
    of_stage = F.struct("exists", "setting_changed", "has_manifest", "manifest_ok", "state")
    wide = dealt.groupBy(job).agg(*[F.first(F.when(F.col("stage") == n, of_stage), ignorenulls=True).alias(n) for n in names])
    state: dict[str, Column] = {"stereo": F.coalesce(F.col("stereo")["state"], F.lit("missing"))}
    out = wide.select(job, *[F.col(n) for n in names])
    columns = [state["stereo"].alias("stereo_state")]
    for name, needs in STAGE_NEEDS.items():
        s = F.col(name)
        upstream = F.lit(True)
        for other, accepted in needs.items():
            upstream = upstream & state[other].isin(*accepted)
        known = lambda f, s=s: F.coalesce(s[f], F.lit(False))
        state[name] = stage_state(known("exists"), upstream, known("setting_changed"), known("has_manifest"), known("manifest_ok"))[0]
        columns.append(state[name].alias(f"{name}_state"))
    return out.select(job, *columns)


def audit_frames(files: DataFrame, expected: DataFrame, by: list[str], index: str, header: list[str]) -> DataFrame:
    """Why a frame stage can't be kept, if so: wrong count, names with gaps (they begin at 1), or uneven headers.

    ``expected``: by, expected_count.
    """
    seen = files.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(index).alias("distinct"), F.min(index).alias("first"), F.max(index).alias("last"), (F.max(F.struct(*header)) == F.min(F.struct(*header))).alias("even"))
    joined = expected.join(seen, by, "left")
    reason = F.when(F.col("n").isNull(), "missing").otherwise(first_failing([("count", F.col("n") == F.col("expected_count")), ("names", (F.col("first") == 1) & (F.col("last") == F.col("n")) & (F.col("distinct") == F.col("n"))), ("header", F.col("even"))]))
    return joined.select(*by, F.coalesce("n", F.lit(0)).alias("n"), reason.alias("reason"))


def audit_shots(plan: DataFrame, records: DataFrame, by: list[str]) -> DataFrame:
    """Each planned shot as reusable, invalid or pending. ``records``: by, recorded start, end and hash_ok."""
    r = records.select(*by, F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("hash_ok").alias("__h"), F.lit(True).alias("__r"))
    state = F.when(F.col("__r").isNull(), "pending").when((F.col("start") == F.col("__s")) & (F.col("end") == F.col("__e")) & F.col("__h"), "reusable").otherwise("invalid")
    return plan.join(r, by, "left").withColumn("state", state).drop("__s", "__e", "__h", "__r")


def execution_plan(postprocess: Column, base_ok: Column, stabilized_ok: Column) -> Column:
    """What must run: the newest valid artifact decides. An unknown post-processor is an error."""
    off, on = postprocess == "off", postprocess == "temporal"
    known = F.when(off | on, F.lit(True)).otherwise(F.raise_error(F.lit("unknown post-processor")).cast("boolean"))
    return F.struct(
        (known & F.when(off, base_ok).otherwise(stabilized_ok)).alias("cache_only"),
        F.when(off, ~base_ok).otherwise(~stabilized_ok & ~base_ok).alias("needs_base"),
        (on & ~stabilized_ok).alias("needs_temporal"),
        F.when(off, "base").otherwise("stabilized").alias("render_from"),
    )


def overall_progress(events: DataFrame, job: str, step: str, weight: str, share: str) -> DataFrame:
    """Weighted progress in percent at each step's event: weights of the steps before, and this step's share of its own."""
    w = Window.partitionBy(job).orderBy(step)
    done = F.coalesce(F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return events.withColumn("progress", 100 * (done + F.col(weight) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(share)))) / F.sum(weight).over(Window.partitionBy(job)))


def remaining_seconds(progress: Column, elapsed: Column, step_done: Column, step_total: Column, step_elapsed: Column, more_steps: Column) -> Column:
    """Seconds left: the step's own rate counts 0.8 and the overall rate 0.2; null before 3 seconds or any progress."""
    own = F.when((step_total > 0) & (step_done > 0) & (step_elapsed >= 2), step_elapsed / F.greatest(step_done, F.lit(1)) * (step_total - step_done)).otherwise(0.0)
    rate = F.try_divide(elapsed, progress) * (100 - progress)
    mixed = F.when(more_steps & (progress > 5), F.when(own > 0, own * 0.8 + rate * 0.2).otherwise(rate)).otherwise(own)
    left = F.when(mixed <= 0, F.try_divide(elapsed, progress / 100.0) - elapsed).otherwise(mixed)
    return F.when((progress > 0) & (elapsed >= 3) & (left >= 0), left)


def resumable(jobs: DataFrame, files: DataFrame, job: str = "job_id") -> DataFrame:
    """Jobs with frames but no final video, newest first. ``files``: job, stage."""
    frames, final = files.filter("stage = 'frames'").select(job).distinct(), files.filter("stage = 'final'").select(job).distinct()
    return jobs.join(frames, job, "left_semi").join(final, job, "left_anti").orderBy(F.col("modified").desc(), job)


def pending_work(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return items.join(done, keys, "left_anti")


def payload_differences(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Each key as completed, unexpected or absent."""
    a, e = actual.select(key).distinct().withColumn("__a", F.lit(1)), expected.select(key).distinct().withColumn("__e", F.lit(1))
    state = F.when(F.col("__e").isNull(), "unexpected").when(F.col("__a").isNull(), "absent").otherwise("completed")
    return a.join(e, key, "full_outer").select(key, state.alias("state"))


def invalidated_paths(paths: DataFrame, protected: DataFrame, path: str, order: str) -> DataFrame:
    """Distinct paths in the order in which they first came, without the protected ones."""
    return paths.groupBy(path).agg(F.min(order).alias(order)).join(protected.select(path), path, "left_anti").orderBy(order, path)
