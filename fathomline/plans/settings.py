"""Settings documents (JSON texts): rules of single keys and between keys, and documents of older versions moved to the present one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Rule:
    """What a JSON value may be: a number or a whole number within bounds, a text that a pattern matches whole, a boolean, null; and its default, as JSON."""

    number: tuple[float, float] | None = None
    whole: tuple[int, int] | None = None
    text: str | None = None
    flag: bool = False
    null: bool = False
    default: str | None = None


#: The present version, names that older versions knew, and each setting's rule.
VERSION = 4
REMOVED = ("baseline", "focal_length", "hole_fill_quality", "processing_mode")
RULES = {
    "stereo_strength": Rule(number=(0.0, 5.0), default="2.0"),
    "convergence": Rule(number=(0.0, 1.0), default="0.5"),
    "stereo_geometry_mode": Rule(text="relative|metric_camera", default='"relative"'),
    "virtual_baseline_mm": Rule(number=(0.0, 100.0), default="63.0"),
    "metric_convergence_distance": Rule(number=(0.1, 1000.0), text="auto", default='"auto"'),
    "max_disparity_percent": Rule(number=(0.0, 5.0), default="2.0"),
    "occlusion_fill": Rule(text="none|background", default='"background"'),
    "scene_detection": Rule(flag=True, default="true"),
    "scene_cut_threshold": Rule(number=(0.0, 1.0), default="0.55"),
    "min_scene_frames": Rule(whole=(1, 1_000_000), default="8"),
    "raw_storage_dtype": Rule(text="auto|float16|float32", default='"auto"'),
    "temporal_postprocessor": Rule(text="off|vdpp", default='"off"'),
    "stereo_io_workers": Rule(whole=(1, 16), default="4"),
    "migrate_legacy": Rule(text="archive|delete", default='"archive"'),
    "vr_format": Rule(text="side_by_side|over_under", default='"side_by_side"'),
    "vr_resolution": Rule(text=".*", default='"auto"'),
    "fisheye_projection": Rule(text="equidistant|equisolid|orthogonal|stereographic", default='"stereographic"'),
    "fisheye_fov": Rule(number=(75, 180), default="180"),
    "crop_factor": Rule(number=(0.5, 1.0), default="1.0"),
    "fisheye_crop_factor": Rule(number=(0.5, 2.0), default="0.7"),
    "super_sample": Rule(text="auto|none|1080p|4k", default='"auto"'),
    "target_fps": Rule(whole=(1, 120), text="original|0*([1-9]|[1-9][0-9]|1[01][0-9]|120)", null=True, default="60"),
    "min_resolution": Rule(text=".*", null=True, default='"1080p"'),
    "preserve_audio": Rule(flag=True, default="true"),
    "keep_intermediates": Rule(flag=True, default="true"),
    "direct_vr_encode": Rule(flag=True, default="false"),
    "apply_distortion": Rule(flag=True, default="true"),
    "output_dir": Rule(text=".*", default='"./output"'),
    "experimental_frame_interpolation": Rule(flag=True, default="false"),
    "temporal_window_size": Rule(whole=(0, 1_000_000), default="32"),
    "temporal_window_overlap": Rule(whole=(0, 1_000_000), default="10"),
    "upscale_model": Rule(text="none|x2|x4|x4-conservative", default='"none"'),
    "depth_model_version": Rule(text="v2|v3|see_through|moge2"),
    "depth_resolution": Rule(whole=(-(2**63), 2**63 - 1), text=".*"),
    "use_metric_depth": Rule(flag=True),
    "denoising_steps": Rule(whole=(0, 1_000_000), null=True),
    "seed": Rule(whole=(0, 1_000_000), null=True),
    "device": Rule(text=".*"),
    "video_encoder": Rule(text="auto|libx264|nvenc"),
    "source_fps": Rule(number=(0.0, 1_000_000.0)),
    "start_time": Rule(text=".*", null=True),
    "end_time": Rule(text=".*", null=True),
    "model_size": Rule(text=".*", null=True),
    "model_path": Rule(text=".*", null=True),
    "video_path": Rule(text=".*", null=True),
    "per_eye_width": Rule(whole=(0, 1_000_000)),
    "per_eye_height": Rule(whole=(0, 1_000_000)),
    "vr_output_width": Rule(whole=(0, 1_000_000)),
    "vr_output_height": Rule(whole=(0, 1_000_000)),
    "source_width": Rule(whole=(0, 1_000_000)),
    "source_height": Rule(whole=(0, 1_000_000)),
    "enable_live_preview": Rule(flag=True),
    "preview_update_interval": Rule(number=(0.0, 1_000_000.0)),
    "verbose": Rule(flag=True),
}


def _value(name: str) -> Column:
    return F.try_variant_get(F.col("__doc"), f"$.{name}", "variant")


def _holds(name: str, rule: Rule) -> Column:
    """Whether a key is absent or its value one that the rule allows."""
    value = _value(name)
    kind = F.schema_of_variant(value)
    as_kind = lambda t: F.try_variant_get(F.col("__doc"), f"$.{name}", t)
    allowed = value.isNull()
    if rule.number:
        allowed = allowed | ((kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")) & as_kind("double").between(*rule.number))
    if rule.whole:
        allowed = allowed | ((kind == "BIGINT") & as_kind("bigint").between(*rule.whole))
    if rule.text:
        allowed = allowed | ((kind == "STRING") & as_kind("string").rlike(rf"(?s)\A({rule.text})\z"))
    if rule.flag:
        allowed = allowed | (kind == "BOOLEAN")
    if rule.null:
        allowed = allowed | (kind == "VOID")
    return F.coalesce(allowed, F.lit(False))


def audit(df: DataFrame, document: str, strict: bool = True, rules: dict[str, Rule] = RULES) -> DataFrame:
    """``df`` with ``violations``, an array of texts, empty where a document is valid.

    In order: ``unreadable`` alone for what is no JSON object (null too); keys that are removed or unknown, by name, if ``strict``; settings whose
    values their rules don't allow, in the order of the rules; and the rule between keys. Rows stay where they are: one projection, no shuffle.
    """
    keys = F.array_sort(F.coalesce(F.json_object_keys(document), F.array().cast("array<string>")))
    named = lambda word, some: F.transform(some, lambda k: F.concat(F.lit(f"{word} "), k))
    removed, known = F.array(*map(F.lit, REMOVED)), F.array(*map(F.lit, (*rules, *REMOVED)))
    single = F.array_compact(F.array(*[F.when(~_holds(n, r), F.lit(n)) for n, r in rules.items()]))
    word = lambda n: F.coalesce(F.try_variant_get(F.col("__doc"), f"$.{n}", "string"), F.lit((rules[n].default or "").strip('"')))
    between = F.array().cast("array<string>")
    if {"stereo_geometry_mode", "temporal_postprocessor"} <= rules.keys():
        clash = (word("stereo_geometry_mode") == "metric_camera") & word("temporal_postprocessor").isin("vdpp")
        between = F.when(clash, F.array(F.lit("vdpp with metric_camera"))).otherwise(between)
    parts = [named("removed", F.array_intersect(keys, removed)), named("unknown", F.array_except(keys, known))] if strict else []
    found = F.when(F.json_object_keys(document).isNull() | F.col("__doc").isNull(), F.array(F.lit("unreadable"))).otherwise(F.concat(*parts, single, between))
    return df.withColumn("__doc", F.try_parse_json(document)).withColumn("violations", found).drop("__doc")


def migrate(df: DataFrame, document: str, version: str, rules: dict[str, Rule] = RULES) -> DataFrame:
    """``df`` with source_version, migrated, removed_settings, settings (each setting's JSON text, defaults where it is missing) and problem.

    A null version is 1. Older documents lose keys that aren't known; those of the present version are held to every rule. ``problem`` names why
    a document is turned away, and settings are then null: a version below 1 or above the present one, or the first violation.
    """
    was = F.coalesce(F.col(version).cast("long"), F.lit(1))
    old, new = audit(df, document, False, rules), "__strict"
    both = audit(old.withColumnRenamed("violations", "__loose"), document, True, rules).withColumnRenamed("violations", new)
    keys = F.coalesce(F.json_object_keys(document), F.array().cast("array<string>"))
    needs = F.when((was == VERSION) & ~F.array_contains(keys, "temporal_postprocessor"), F.lit("temporal_postprocessor is missing"))
    problem = F.when(was < 1, "version below 1").when(was > VERSION, "newer version").otherwise(F.coalesce(F.get(F.when(was == VERSION, F.col(new)).otherwise(F.col("__loose")), F.lit(0)), needs))
    kept = [(n, F.coalesce(F.to_json(_value(n)), F.lit(r.default).cast("string"))) for n, r in rules.items()]
    settings = F.map_filter(F.map_from_entries(F.array(*[F.struct(F.lit(n), v) for n, v in kept])), lambda _, v: v.isNotNull())
    out = both.withColumns({"__doc": F.try_parse_json(document), "problem": problem, "source_version": was, "migrated": was < VERSION})
    gone = F.array_sort(F.array_except(keys, F.array(*map(F.lit, rules))))
    out = out.withColumn("removed_settings", F.when(F.col("migrated"), gone).otherwise(F.array().cast("array<string>")))
    return out.withColumn("settings", F.when(F.col("problem").isNull(), settings)).drop("__doc", "__loose", new)


def require(df: DataFrame) -> DataFrame:
    """``df`` of ``migrate``, ending the job at a document that was turned away."""
    return df.withColumn("settings", F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem")).cast("map<string,string>")).otherwise(F.col("settings")))
