"""Names, clock texts, sizes and identities as column expressions."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: Characters that file names may not have, and the units of sizes.
ILLEGAL = '[<>:"/\\\\|?*]'
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")
NAME_MOST = 200


def clock_seconds(text: Column) -> Column:
    """``mm:ss`` or ``hh:mm:ss`` in seconds, else null."""
    parts = F.split(F.trim(text), ":")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("bigint")
    return F.when(F.size(parts) == 2, number(0) * 60 + number(1)).when(F.size(parts) == 3, number(0) * 3600 + number(1) * 60 + number(2))


def frame_range(total: Column, fps: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """First frame and end of a clock range, at least one frame long."""
    first = F.coalesce((clock_seconds(start) * fps).cast("long"), F.lit(0))
    last = F.coalesce((clock_seconds(end) * fps).cast("long"), total)
    first = F.greatest(F.lit(0), F.least(first, total - 1))
    return first, F.greatest(first + 1, F.least(last, total))


def frame_name(index: Column, prefix: str = "frame") -> Column:
    return F.format_string(f"{prefix}_%06d.png", index)


def frame_index(name: Column, prefix: str = "frame") -> Column:
    """The index in a frame name written exactly so, else null."""
    index = F.regexp_extract(name, rf"^{prefix}_([0-9]+)\.png$", 1).try_cast("int")
    return F.when(frame_name(index, prefix) == name, index)


def safe_name(name: Column) -> Column:
    """Illegal characters as single underscores, none at the ends, at most 200 characters with the extension kept."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(name, ILLEGAL, "_"), "_+", "_"), F.lit("_"))
    extension = F.regexp_extract(plain, r"[^.](\.[^.]*)$", 1)
    stem = F.substring(plain, F.lit(1), F.lit(NAME_MOST) - F.length(extension))
    return F.when(F.length(plain) > NAME_MOST, F.concat(stem, extension)).otherwise(plain)


def output_name(stem: Column, layout: Column, resolution: Column) -> Column:
    return F.concat(F.concat_ws("_", safe_name(stem), F.lit("3D"), F.replace(layout, F.lit("_"), F.lit("-")), resolution), F.lit(".mp4"))


def size_text(size: Column) -> Column:
    """Bytes with a unit: whole below 1024, else one decimal, rounded half to even."""
    out = F.format_string("%.1f TB", F.bround(size / 1024.0**4, 1))
    for i in range(len(SIZE_UNITS) - 2, 0, -1):
        out = F.when(size < 1024 ** (i + 1), F.format_string(f"%.1f {SIZE_UNITS[i]}", F.bround(size / 1024.0**i, 1))).otherwise(out)
    return F.when(size < 1024, F.format_string("%d B", size.cast("long"))).otherwise(out)


def clock_text(seconds: Column) -> Column:
    s = F.floor(seconds)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def remaining_text(seconds: Column) -> Column:
    s = F.floor(seconds)
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))


def divisor(a: Column, b: Column) -> Column:
    """Greatest common divisor of two positive 32-bit numbers: at most 47 steps of Euclid's method."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(47)), start, lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0)).otherwise(s["a"] % F.greatest(s["b"], F.lit(1))).cast("long").alias("b")))["a"]


def sample_aspect(text: Column) -> tuple[Column, Column]:
    """``n:d`` in lowest terms; 1:1 where it is missing or ``N/A``; nulls where it can't be one."""
    part = lambda i: F.regexp_extract(text, "^([0-9]+):([0-9]+)$", i).try_cast("bigint")
    ok = part(1).between(1, 2**31 - 1) & part(2).between(1, 2**31 - 1)
    g = divisor(part(1), part(2))
    none = text.isNull() | (text == "N/A")
    pick = lambda i: F.when(none, F.lit(1).cast("long")).when(ok, F.expr("1L") * (part(i) / g).cast("long"))
    return pick(1), pick(2)


def custom_size(text: Column) -> tuple[Column, Column]:
    """``custom:WxH`` with sides from 1 to 10000, else nulls."""
    side = lambda i: F.regexp_extract(text, r"^custom:\s*([0-9]+)\s*x\s*([0-9]+)\s*$", i).try_cast("int")
    ok = side(1).between(1, 10000) & side(2).between(1, 10000)
    return F.when(ok, side(1)), F.when(ok, side(2))


def document_hash(columns: list[Column]) -> Column:
    """SHA-256 of the columns as one JSON document; give them in the order of their names."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


@F.pandas_udf(StringType())
def canonical_hash(documents: pd.Series) -> pd.Series:
    """SHA-256 of JSON texts with sorted keys, no spaces and ASCII escapes; null where a text is no JSON."""

    def one(text):
        try:
            return hashlib.sha256(json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()
        except (TypeError, ValueError):
            return None

    return documents.map(one)


#: Fixed value: bytes at either end of a content that its sample takes.
SAMPLE_BYTES = 1 << 20


@F.pandas_udf(StringType())
def content_sample_hash(content: pd.Series) -> pd.Series:
    """BLAKE2b-128 of a content's size (16 bytes, the highest first) and its first and last MiB; of all of it where these would meet. Null for null."""

    def one(body: bytes | None) -> str | None:
        if body is None:
            return None
        ends = (body,) if len(body) <= 2 * SAMPLE_BYTES else (body[:SAMPLE_BYTES], body[-SAMPLE_BYTES:])
        return hashlib.blake2b(b"".join((len(body).to_bytes(16), *ends)), digest_size=16).hexdigest()

    return content.map(one)


def array_payload_hash(arrays: Column) -> Column:
    """SHA-256 of named arrays, an array of structs (name, dtype, shape, body): in order of the names, each one's name, type, shape as a JSON list, and bytes."""
    ordered = F.array_sort(arrays, lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    head = lambda x: F.concat(x["name"], x["dtype"], F.lit("["), F.array_join(F.transform(x["shape"], lambda n: n.cast("string")), ", "), F.lit("]"))
    return F.sha2(F.aggregate(ordered, F.lit(b"").cast("binary"), lambda done, x: F.concat(done, F.encode(head(x), "UTF-8"), x["body"])), 256)


#: The settings that a cached result hangs on.
CACHE_SETTINGS = (
    "depth_model_version", "model_path", "model_size", "depth_resolution", "use_metric_depth", "device", "start_time", "end_time", "super_sample",
    "temporal_window_size", "temporal_window_overlap", "denoising_steps", "seed", "scene_detection", "scene_cut_threshold", "min_scene_frames",
    "raw_storage_dtype", "model_fingerprint",
)


@F.pandas_udf(StringType())
def cache_key(fingerprint: pd.Series, settings: pd.Series) -> pd.Series:
    """BLAKE2b-128 of a content's fingerprint and the settings that count (a JSON object; missing ones are null), as spaced JSON in order of the names; null where either is missing or no object."""

    def one(mark, document):
        try:
            given = json.loads(document)
            body = json.dumps({k: given.get(k) for k in CACHE_SETTINGS}, sort_keys=True)
            return hashlib.blake2b(mark.encode() + body.encode(), digest_size=16).hexdigest()
        except (TypeError, ValueError, AttributeError):
            return None

    return pd.Series([one(m, d) for m, d in zip(fingerprint, settings)], dtype=object)
