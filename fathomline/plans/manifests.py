"""Manifests that verify themselves: a document that holds its own hash, and a digest of a list of files that partitions can make in parts.

``file_digest`` is a sum, in four lanes, of words of the SHA-256 of each file's place and properties. Sums of parts add up, so the
list is never gathered; the place is hashed with the file, so order counts, and the number of files is hashed at the end.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from fathomline.plans.stages import Check, judged

LANES = 4
#: The key under which a document holds its own hash.
OWN = "fingerprint"


def _opened(text: str | None) -> dict | None:
    try:
        document = json.loads(text)
    except (TypeError, ValueError):
        return None
    return document if isinstance(document, dict) else None


def _hash_of(document: dict, own: str) -> str:
    body = {k: v for k, v in document.items() if k != own}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def self_hash(document: Column, own: str = OWN) -> Column:
    """The canonical hash (as ``canonical_hash``) of a document without its own hash field; null for what is no JSON object."""

    @F.pandas_udf(StringType())
    def hashes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if (d := _opened(t)) is None else _hash_of(d, own))

    return hashes(document)


def sealed(document: Column, own: str = OWN) -> Column:
    """The document with its own hash, in the canonical form; null for what is no JSON object."""

    @F.pandas_udf(StringType())
    def seal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if (d := _opened(t)) is None else json.dumps(d | {own: _hash_of(d, own)}, sort_keys=True, separators=(",", ":")))

    return seal(document)


def is_sealed(document: Column, own: str = OWN) -> Column:
    """Whether a document's own hash is right."""
    return F.coalesce(F.get_json_object(document, f"$.{own}") == self_hash(document, own), F.lit(False))


def _words(place: Column, properties: list[Column]) -> list[Column]:
    sign = F.sha2(F.concat_ws("\0", place.cast("string"), *[F.coalesce(p.cast("string"), F.lit("")) for p in properties]), 256)
    return [F.conv(F.substring(sign, 8 * i + 1, 8), 16, 10).cast("long") for i in range(LANES)]


def file_digest(place: Column, properties: list[Column]) -> Column:
    """An aggregate: the digest of a list of files by their places in it and their properties (folder, name, size, time)."""
    sums = [F.sum(w).cast("string") for w in _words(place, properties)]
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums), 256)


def complete(outputs: DataFrame, identity: DataFrame, by: list[str], index: str = "frame_idx", name: str = "name", header: str = "header", document: str = "document") -> DataFrame:
    """A sealed manifest for each stage of ``identity`` (by, expected, and a JSON object of what identifies it) whose outputs are whole.

    Whole: as many files as expected, numbered from 1 without gaps, one header. Stages that aren't get no row.
    """
    seen = outputs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"), F.countDistinct(index).alias("__d"), F.min(index).alias("__first"), F.max(index).alias("__last"),
        F.min(header).alias("__low"), F.max(header).alias("__high"), F.count(header).alias("__headers"), file_digest(F.col(index), [F.col(name)]).alias("__names"),
    )
    whole = (F.col("__n") == F.col("expected")) & (F.col("__d") == F.col("__n")) & (F.col("__first") == 1) & (F.col("__last") == F.col("__n")) & (F.col("__headers") == F.col("__n")) & (F.col("__low") == F.col("__high"))
    more = F.to_json(F.struct(F.to_json("__low").alias("output_header"), F.col("__names").alias("output_names")))
    full = F.concat(F.regexp_replace(document, r"\}\s*\z", ""), F.when(F.size(F.json_object_keys(document)) > 0, ",").otherwise(""), F.substring(more, 2, 1 << 20))
    return identity.join(seen, by).filter(whole).select(*by, sealed(full).alias(document))


def reusable(identity: DataFrame, manifests: DataFrame, outputs: DataFrame, by: list[str], index: str = "frame_idx", name: str = "name", header: str = "header", document: str = "document") -> DataFrame:
    """by, state, reason: whether each stage's outputs can be kept as they are.

    The manifest has to hold what identifies the stage now, its own hash has to be right, and the files have to be those that it lists.
    """
    m = manifests.select(*by, F.col(document).alias("__manifest"))
    seen = outputs.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), file_digest(F.col(index), [F.col(name)]).alias("__names"), F.count(F.when(F.col(header).isNotNull(), 1)).alias("__headers"), F.min(header).alias("__low"), F.max(header).alias("__high"))
    now, then = F.from_json(document, "map<string, string>"), F.from_json("__manifest", "map<string, string>")
    same = F.forall(F.map_entries(now), lambda e: F.coalesce(F.try_element_at(then, e["key"]) == e["value"], F.lit(False)))
    checks = [
        Check("manifest is missing", then.isNotNull()),
        Check("identity changed", same),
        Check("manifest hash mismatch", is_sealed(F.col("__manifest"))),
        Check("files changed", F.try_element_at(then, F.lit("output_names")) == F.col("__names")),
        Check("invalid output header", (F.col("__headers") == F.col("__n")) & (F.col("__low") == F.col("__high")) & (F.to_json("__low") == F.try_element_at(then, F.lit("output_header")))),
    ]
    joined = identity.join(m, by, "left").join(seen, by, "left")
    return joined.select(*by, judged(F.col("__n").isNotNull(), checks).alias("v")).select(*by, "v.state", "v.reason")
