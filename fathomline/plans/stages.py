"""The stage graph of a job: what each stage's own files and documents say, and what is left of it when its needs are taken into account.

Every stage is audited by itself first, by named checks over what was found of it. ``evaluate`` then walks a table of edges from
the frames on: an edge names the upstream states that a stage accepts, and what becomes of it otherwise. A stage that isn't
there is missing whatever its needs say. ``resume`` is work that can go on; ``invalidate`` is work that has to be done again.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

MISSING, INVALIDATE, RESUME, PRESERVE = "missing", "invalidate", "resume", "preserve"
GOES_ON = (PRESERVE, RESUME)


@dataclass(frozen=True)
class Edge:
    """``stage`` needs ``upstream`` in one of the ``accepted`` states, in jobs of ``mode`` (None: all); else it gets the state ``otherwise``.

    An edge whose ``otherwise`` is ``resume`` touches only stages that would be preserved.
    """

    stage: str
    upstream: str
    accepted: tuple[str, ...]
    reason: str = "an upstream stage is invalid"
    otherwise: str = INVALIDATE
    mode: str | None = None


#: The stages' needs. Which geometry feeds the views hangs on the job's mode; bounds of scenes hang on the
#: raw maps that they were taken from, and those on the scenes, so the scenes are there twice.
EDGES = [
    Edge("scene_cuts", "frames", (PRESERVE,), "source frames are invalid"),
    Edge("raw", "frames", (PRESERVE,), "scene or frame stage is invalid"),
    Edge("raw", "scene_cuts", GOES_ON, "scene or frame stage is invalid"),
    Edge("scenes", "frames", (PRESERVE,), "source frames are invalid"),
    Edge("scenes", "raw", GOES_ON, "bounds will be recomputed", RESUME),
    Edge("canonical", "scenes", (PRESERVE,), "scenes are not final"),
    Edge("canonical", "raw", GOES_ON, "raw metadata is invalid"),
    Edge("metric", "frames", (PRESERVE,), "source frames are invalid"),
    Edge("metric", "scene_cuts", GOES_ON, "scene metadata is invalid"),
    Edge("stabilized", "canonical", GOES_ON, "canonical maps are invalid"),
    Edge("stereo", "canonical", GOES_ON, "selected geometry is invalid", mode="relative"),
    Edge("stereo", "metric", GOES_ON, "selected geometry is invalid", mode="metric"),
    Edge("stereo", "stabilized", (PRESERVE,), "selected geometry is invalid", mode="stabilized"),
    Edge("distortion", "stereo", GOES_ON),
    Edge("crop", "stereo", GOES_ON),
    Edge("crop", "distortion", (PRESERVE, MISSING)),
    Edge("upscale", "crop", (PRESERVE, MISSING)),
    Edge("assemble", "stereo", GOES_ON),
    Edge("assemble", "crop", (PRESERVE, MISSING)),
    Edge("assemble", "upscale", (PRESERVE, MISSING)),
]


def edges_of(rows: DataFrame) -> list[Edge]:
    """The edges of a table with the fields of ``Edge``; a graph of stages, not of data."""
    return [Edge(r.stage, r.upstream, tuple(r.accepted), r.reason, r.otherwise, r.mode) for r in rows.collect()]


def levels(edges: Iterable[Edge]) -> list[list[str]]:
    """The stages by the longest way from a stage without needs; an error if they need one another."""
    edges = list(edges)
    needs: dict[str, set[str]] = {}
    for e in edges:
        needs.setdefault(e.stage, set()).add(e.upstream)
        needs.setdefault(e.upstream, set())
    out: list[list[str]] = []
    while needs:
        ready = sorted(s for s, up in needs.items() if not up & needs.keys())
        if not ready:
            raise ValueError(f"stages need one another: {sorted(needs)}")
        out.append(ready)
        for s in ready:
            del needs[s]
    return out


# --- a stage by itself --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Check:
    """A condition, why a stage fails without it, and the state that it then has."""

    reason: str
    holds: Column
    state: str = INVALIDATE


def judged(present: Column, checks: list[Check], state: str | Column = PRESERVE, reason: str = "reusable") -> Column:
    """struct(present, state, reason) of a stage by the first check that fails. A check that can't be made fails."""
    out = F.struct(F.lit(state) if isinstance(state, str) else state, F.lit(reason))
    for check in reversed(checks):
        failed = F.struct(F.lit(check.state), F.lit(check.reason))
        out = F.when(F.coalesce(check.holds, F.lit(False)), out).otherwise(failed)
    out = F.when(F.coalesce(present, F.lit(False)), out).otherwise(F.struct(F.lit(MISSING), F.lit("absent")))
    return out.cast("struct<state: string, reason: string>")


# --- the graph ----------------------------------------------------------------------------------------------------------


def evaluate(own: DataFrame, edges: Iterable[Edge] = EDGES, job: str = "job_id", mode: str | None = "mode") -> DataFrame:
    """A row for each job and stage of the graph: job, stage, level, state, reason.

    ``own``: job, stage, and verdict as of ``judged``; mode, the same on all rows of a job. A stage without a row is missing. The
    stages of a job are gathered once, as many as the graph has, and folded in the order of their levels, so there is one
    shuffle however deep the graph is.
    """
    edges = list(edges)
    order = [(level, stage) for level, stages in enumerate(levels(edges)) for stage in stages]
    place = {stage: i for i, (_, stage) in enumerate(order)}
    item = "struct<stage: string, verdict: struct<state: string, reason: string>>"
    mode_of = F.col(mode) if mode else F.lit(None).cast("string")
    known = own.filter(F.col("stage").isin([s for _, s in order]))
    jobs = known.groupBy(job).agg(F.sort_array(F.collect_list(F.struct("stage", "verdict").cast(item))).alias("__own"), F.max(mode_of).alias("__mode"))

    def literal(stage: str) -> Column:
        needs = [e for e in edges if e.stage == stage]
        made = [F.struct(F.lit(place[e.upstream]).alias("up"), F.array(*map(F.lit, e.accepted)).alias("accepted"), F.lit(e.reason).alias("reason"), F.lit(e.otherwise).alias("otherwise"), F.lit(e.mode).cast("string").alias("mode")) for e in needs]
        none = F.array().cast("array<struct<up: int, accepted: array<string>, reason: string, otherwise: string, mode: string>>")
        return F.struct(F.lit(stage).alias("stage"), (F.array(*made) if made else none).cast(none_type).alias("needs"))

    none_type = "array<struct<up: int, accepted: array<string>, reason: string, otherwise: string, mode: string>>"

    def step(done: Column, stage: Column) -> Column:
        mine = F.coalesce(F.get(F.filter("__own", lambda o: o["stage"] == stage["stage"]), F.lit(0))["verdict"], F.struct(F.lit(MISSING).alias("state"), F.lit("absent").alias("reason")))
        unmet = lambda n: (n["mode"].isNull() | F.coalesce(n["mode"] == F.col("__mode"), F.lit(False))) & ~F.array_contains(n["accepted"], F.get(done, n["up"])["state"])
        first = lambda kind: F.get(F.filter(stage["needs"], lambda n: unmet(n) & (n["otherwise"] == kind)), F.lit(0))
        lost, held = first(INVALIDATE), first(RESUME)
        as_verdict = lambda n: F.struct(n["otherwise"].alias("state"), n["reason"].alias("reason"))
        verdict = F.when(mine["state"] == MISSING, mine).when(lost.isNotNull(), as_verdict(lost)).when((mine["state"] == PRESERVE) & held.isNotNull(), as_verdict(held)).otherwise(mine)
        return F.concat(done, F.array(verdict))

    start = F.array().cast("array<struct<state: string, reason: string>>")
    folded = jobs.select(job, F.aggregate(F.array(*[literal(s) for _, s in order]), start, step).alias("__states"))
    names = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(level).alias("level")) for level, s in order])
    rows = folded.select(job, F.explode(F.arrays_zip(names.alias("n"), F.col("__states").alias("v"))).alias("z"))
    return rows.select(job, "z.n.stage", "z.n.level", "z.v.state", "z.v.reason")


def report(states: DataFrame, sizes: DataFrame, job: str = "job_id", hidden: tuple[str, ...] = ("scene_cuts",)) -> DataFrame:
    """``evaluate`` with the bytes of each stage (``sizes``: job, stage, bytes), without stages that stand for part of another."""
    total = sizes.groupBy(job, "stage").agg(F.sum("bytes").alias("bytes"))
    return states.filter(~F.col("stage").isin(*hidden)).join(total, [job, "stage"], "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))


def must_go(states: DataFrame, paths: DataFrame, job: str = "job_id", protected: str = "frames") -> DataFrame:
    """Distinct paths of invalid stages, but for those that the protected stage has too. ``paths``: job, stage, path."""
    bad = states.filter(F.col("state") == INVALIDATE).select(job, "stage").join(paths, [job, "stage"]).select(job, "path").distinct()
    return bad.join(paths.filter(F.col("stage") == protected).select(job, "path"), [job, "path"], "left_anti")


# --- audits of single stages --------------------------------------------------------------------------------------------


def frame_checks(found: Column, expected: Column, gapless: Column, headers: Column, even: Column, source: Column, manifest: Column) -> list[Check]:
    """Of extracted frames: number, names, headers, sizes, the source's fingerprint and the manifest's."""
    return [
        Check("frame count mismatch", expected.isNull() | (found == expected)),
        Check("names are not contiguous", gapless),
        Check("invalid header", headers),
        Check("frame dimensions mismatch", even),
        Check("source fingerprint is missing", source.isNotNull()),
        Check("source manifest mismatch", manifest),
    ]


def scene_checks(document: Column, frame_names: Column, source: Column, settings: Column, versions: dict[str, int]) -> list[Check]:
    """Of a manifest of scenes (a struct): readable, of the present versions, of these frames and settings, whole; a candidate goes on."""
    d = document
    ids = F.coalesce(d["scene_ids"], F.array().cast("array<int>"))
    return [
        Check("schema or source mismatch", d.isNotNull()),
        *[Check("schema or source mismatch", d[k] == v) for k, v in versions.items()],
        Check("schema or source mismatch", (d["frame_names"] == frame_names) & (d["source_fingerprint"] == source)),
        Check("scene settings mismatch", d["settings"] == settings),
        Check("scene ids do not match frames", (F.size(ids) == F.size(frame_names)) & F.forall(ids, lambda i: i >= 0)),
        Check("candidate will be finished", d["status"] != "candidate", RESUME),
        Check("status is invalid", d["status"] == "final"),
    ]


def raw_checks(document: Column, payload_ok: Column, completed: Column, frame_names: Column, source: Column, settings: Column, camera: Column) -> list[Check]:
    """Of raw maps: schema, frames, camera, source, model settings and storage; promotion and unfinished maps go on."""
    d = document
    promoting = (d["schema_version"] == 3) & ((d["storage_status"] == "promoting") | ((d["selected_dtype"] == "float16") & (settings["dtype"] == "float32")))
    return [
        Check("metadata is missing", d.isNotNull()),
        Check("schema mismatch", d["schema_version"].isin(2, 3)),
        Check("frame manifest mismatch", d["frame_names"] == frame_names),
        Check("camera model mismatch", (d["schema_version"] == 2) & F.coalesce(d["camera"], F.lit("none")).isin("none") | (d["schema_version"] == 3) & d["camera"].isin("none", "pinhole")),
        Check("this model needs a camera", (camera == "none") | (d["schema_version"] == 3) & (d["camera"] == camera)),
        Check("source fingerprint mismatch", d["source_fingerprint"] == source),
        Check("model setting mismatch", d["model"] == settings["model"]),
        Check("storage type mismatch", (d["requested_dtype"] == settings["dtype"]) | ((d["selected_dtype"] == "float16") & (settings["dtype"] == "float32"))),
        Check("storage status is invalid", d["storage_status"].isin("ready", "promoting")),
        Check("payload validation failed", payload_ok),
        Check("promotion will go on", ~promoting, RESUME),
        Check("partly complete", completed == F.size(frame_names), RESUME),
    ]


#: What a canonical document states.
CANONICAL = {"schema_version": 1, "algorithm_version": 1, "representation": "relative_disparity", "near_value": 1.0, "far_value": 0.0, "encoding": "uint16_png", "encoding_scale": 65535.0}


def canonical_checks(document: Column, own_hash: Column, frame_names: Column, raw: Column, model: Column, scenes: Column, bounds: Column, stated: dict = CANONICAL) -> list[Check]:
    """The 14 identity checks of canonical maps, by the field that each is about."""
    d = document
    return [
        *[Check(k, d[k] == v) for k, v in stated.items()],
        Check("frame_names", d["frame_names"] == frame_names),
        Check("num_frames", d["num_frames"] == F.size(frame_names)),
        Check("source_raw_fingerprint", d["source_raw_fingerprint"] == raw),
        Check("source_model_fingerprint", d["source_model_fingerprint"] == model),
        Check("scene_manifest_fingerprint", d["scene_manifest_fingerprint"] == scenes),
        Check("depth_bounds_fingerprint", d["depth_bounds_fingerprint"] == bounds),
        Check("fingerprint", d["fingerprint"] == own_hash),
    ]


def payload_checks(expected: Column, found: Column, fitting: Column) -> list[Check]:
    """Of a stage's files, by their numbers: one whose header doesn't fit is made again, and so are absent ones."""
    return [Check("payload will be regenerated", found == fitting, RESUME), Check("partly complete", found == expected, RESUME)]


def generated_checks(changed: Column, document: Column, own_hash: Column, version: int = 1) -> list[Check]:
    """Of frames made from frames: no setting changed (``changed``: the first that did), and a manifest that holds."""
    return [
        Check("setting changed", changed.isNull()),
        Check("completion manifest is missing", document.isNotNull()),
        Check("completion manifest is invalid", (document["schema_version"] == version) & (document["fingerprint"] == own_hash)),
    ]
