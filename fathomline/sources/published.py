"""Stores in which data become visible by one row: write to a fresh place, read back what was written, then publish.

``Log`` is a table of batches. Data go to a folder of their own under ``data``; a row of ``log`` says which batch is added and which
are taken away by it. That row is one file, and Spark's commit moves it to its place in one step, so readers see all of
a change or nothing. What a failed job left in ``data`` is named by no row and is never read; ``leftovers`` lists it.

``Published`` keeps groups (shots, cache entries) with a sealed manifest each. Manifests are a log of their own: the batch of a publication becomes
visible by one row, however many groups it has. The newest manifest of a group counts, or for a write-once store the first, so that of two jobs that add the
same key at once one wins for all readers.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, FloatType

from fathomline.functions.depth import HALF_MAX, finite
from fathomline.plans.manifests import file_digest, is_sealed, sealed
from fathomline.plans.stages import Check, judged

LOG = "version LONG, batch STRING, kind STRING, removes ARRAY<STRING>"
#: The folder of a batch, and the column that it is read as.
BATCH = "batch_id"


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The Parquet table at a path; None if nothing is there yet."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _next(versions: DataFrame | None) -> int:
    return 1 if versions is None else (versions.agg(F.max("version")).first()[0] or 0) + 1


class Log:
    """Batches of rows, added and taken away together."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, df: DataFrame) -> str:
        """Writes a batch that nobody sees yet."""
        batch = uuid.uuid4().hex
        df.write.mode("errorifexists").parquet(f"{self.root}/data/{BATCH}={batch}")
        return batch

    def written(self, batch: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/data/{BATCH}={batch}")

    def commit(self, batch: str, kind: str = "", removes: list[str] = ()) -> None:
        """Makes a batch visible, and others invisible, at once."""
        row = [(_next(_read(self.spark, f"{self.root}/log", LOG)), batch, kind, list(removes))]
        self.spark.createDataFrame(row, LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")

    def live(self) -> dict[str, str]:
        """The visible batches and their kinds; as many as there were commits, not rows."""
        log = _read(self.spark, f"{self.root}/log", LOG)
        rows = [] if log is None else log.collect()
        gone = {b for r in rows for b in r.removes}
        return {r.batch: r.kind for r in sorted(rows, key=lambda r: r.version) if r.batch not in gone}

    def read(self, batches: dict[str, str] | None = None) -> DataFrame | None:
        """All visible rows; None if there never was a batch."""
        batches = self.live() if batches is None else batches
        if not batches:
            return None
        return self.spark.read.parquet(*[f"{self.root}/data/{BATCH}={b}" for b in batches])

    def leftovers(self) -> list[str]:
        """Batches that no row names or that were taken away: safe to delete once no job runs."""
        every = self.spark.read.option("basePath", f"{self.root}/data").parquet(f"{self.root}/data").select(F.col(BATCH).cast("string")).distinct()
        return sorted({r[0] for r in every.collect()} - self.live().keys())


def write_documents(df: DataFrame, root: str) -> None:
    """Puts rows in the place of all that was there. Until the new ones are visible the old ones are."""
    log = Log(df.sparkSession, root)
    old = list(log.live())
    log.commit(log.write(df), removes=old)


def read_documents(spark: SparkSession, root: str) -> DataFrame | None:
    return Log(spark, root).read()


# --- appends with promotion ---------------------------------------------------------------------------------------------


@F.pandas_udf(ArrayType(FloatType()))
def to_half(values: pd.Series) -> pd.Series:
    """Maps rounded to what half floats can hold."""
    return values.map(lambda v: None if v is None else np.asarray(v, np.float32).astype(np.float16).astype(np.float32))


class RawStore:
    """Maps that are appended in batches, all of one stored type: half floats until a value doesn't fit.

    ``asked``: ``float16`` turns a batch that doesn't fit away; ``float32`` and ``auto`` promote what is there. Promotion writes the
    earlier half-float batches anew and swaps them in the same commit that adds the batch, so a reader never sees
    both types. Keys that are there already are not written again, so a repeated append adds nothing.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], values: str = "values"):
        self.log, self.keys, self.values = Log(spark, root), keys, values

    def dtype(self) -> str | None:
        return next(iter(self.log.live().values()), None)

    def append(self, batch: DataFrame, asked: str = "auto") -> str:
        """Adds the rows of new keys and returns the type of the whole store."""
        if asked not in ("auto", "float16", "float32"):
            raise ValueError(f"unknown storage type: {asked}")
        live = self.log.live()
        there = self.log.read(live)
        fresh = batch.dropDuplicates(self.keys)
        if there is not None:
            fresh = fresh.join(there.select(*self.keys), self.keys, "left_anti")
        # What was written decides, not a second evaluation of the input.
        staged = self.log.write(fresh)
        written = self.log.written(staged)
        over = F.exists(self.values, lambda v: finite(v) & (F.abs(v) > HALF_MAX))
        fits, n = written.agg(F.coalesce(~F.bool_or(over), F.lit(True)), F.count(F.lit(1))).first()
        now = self.dtype()
        if n == 0 and not (now == "float16" and asked == "float32"):
            return now or ("float16" if asked != "float32" else "float32")
        if asked == "float16" and not fits:
            raise ValueError("values exceed the range of half floats")
        kind = "float32" if now == "float32" or asked == "float32" or not fits else "float16"
        if kind == "float32" and now == "float16":
            both = written.unionByName(there.select(*written.columns))
            self.log.commit(self.log.write(both), kind, removes=list(live))
        elif kind == "float16":
            self.log.commit(self.log.write(written.withColumn(self.values, to_half(self.values))), kind)
        else:
            self.log.commit(staged, kind)
        return kind

    def read(self) -> DataFrame | None:
        return self.log.read()


# --- published groups ---------------------------------------------------------------------------------------------------


class Published:
    """Groups of rows (by the columns ``by``) in order of ``index``, visible from their manifests on."""

    def __init__(self, spark: SparkSession, root: str, by: list[str], index: str, write_once: bool = False):
        self.spark, self.by, self.index, self.write_once = spark, by, index, write_once
        self.log, self.listed = Log(spark, root), Log(spark, f"{root.rstrip('/')}/manifests")

    def _digests(self, rows: DataFrame, *more: str) -> DataFrame:
        """Number, span and digest of each group; the digest is over places and all columns."""
        columns = sorted(c for c in rows.columns if c not in (*self.by, *more))
        body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
        return rows.groupBy(*self.by, *more).agg(F.count(F.lit(1)).alias("n"), F.min(self.index).alias("first"), F.max(self.index).alias("last"), F.countDistinct(self.index).alias("distinct"), file_digest(F.col(self.index), [body]).alias("digest"))

    def manifests(self) -> DataFrame | None:
        """The manifest that counts of each group: by, version, batch, n, digest, document."""
        rows = self.listed.read()
        if rows is None:
            return None
        order = [F.col("version"), F.col("batch")] if self.write_once else [F.col("version").desc(), F.col("batch")]
        return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*self.by).orderBy(*order))).filter("__r = 1").drop("__r")

    def stage(self, df: DataFrame, planned: DataFrame) -> tuple[str, DataFrame]:
        """Writes groups and reads them back; the batch, and a row for each group if all are whole, else an error.

        Whole: as many rows as ``planned`` (by, expected) says, their places gapless from 0, and every planned group there.
        """
        batch = self.log.write(df)
        seen = self._digests(self.log.written(batch))
        whole = (F.col("n") == F.col("expected")) & (F.col("first") == 0) & (F.col("last") == F.col("n") - 1) & (F.col("distinct") == F.col("n"))
        both = seen.join(planned.select(*self.by, "expected"), self.by, "full_outer")
        bad = both.filter(~F.coalesce(whole, F.lit(False))).limit(5).collect()
        if bad:
            raise ValueError(f"groups are not whole: {[tuple(r[b] for b in self.by) for r in bad]}")
        return batch, seen

    def publish(self, df: DataFrame, planned: DataFrame, documents: DataFrame | None = None) -> None:
        """Stages groups and makes them visible. ``documents``: by, document (a JSON object that the manifest holds)."""
        there = self.manifests() if self.write_once else None
        if there is not None:
            df, planned = (x.join(there.select(*self.by), self.by, "left_anti") for x in (df, planned))
        batch, seen = self.stage(df, planned)
        made = seen.select(*self.by, "n", "digest")
        made = made.withColumn("own", F.lit("{}")) if documents is None else made.join(documents.select(*self.by, F.col("document").alias("own")), self.by, "left")
        body = F.to_json(F.struct("n", "digest", F.coalesce("own", F.lit("{}")).alias("about")))
        rows = made.select(*self.by, F.lit(_next(self.listed.read())).cast("long").alias("version"), F.lit(batch).alias("batch"), "n", "digest", sealed(body).alias("document"))
        self.listed.commit(self.listed.write(rows))

    def read(self) -> DataFrame | None:
        """The rows of all published groups, each from the batch that counts."""
        m = self.manifests()
        if m is None:
            return None
        data = self.spark.read.option("basePath", f"{self.log.root}/data").parquet(f"{self.log.root}/data").withColumn(BATCH, F.col(BATCH).cast("string"))
        return data.join(m.select(*self.by, F.col("batch").alias(BATCH)), [*self.by, BATCH]).select(*[c for c in data.columns if c != BATCH])

    def audit(self, planned: DataFrame) -> DataFrame:
        """Each planned group as pending, invalid (its rows aren't those that were published, or its manifest is broken) or reusable."""
        m = self.manifests()
        if m is None:
            return planned.select(*self.by, F.lit("pending").alias("state"), F.lit("not published").alias("reason"))
        now = self._digests(self.read()).select(*self.by, F.col("n").alias("n_now"), F.col("digest").alias("digest_now"))
        checks = [
            Check("manifest hash mismatch", is_sealed(F.col("document")), "invalid"),
            Check("manifest disagrees with itself", (F.get_json_object("document", "$.digest") == F.col("digest")) & (F.get_json_object("document", "$.n").cast("long") == F.col("n")), "invalid"),
            Check("length differs from the plan", F.col("n") == F.col("expected"), "invalid"),
            Check("rows changed", (F.col("n_now") == F.col("n")) & (F.col("digest_now") == F.col("digest")), "invalid"),
        ]
        both = planned.join(m, self.by, "left").join(now, self.by, "left")
        v = both.select(*self.by, judged(F.col("batch").isNotNull(), checks, "reusable", "reusable").alias("v"))
        return v.select(*self.by, F.when(F.col("v.state") == "missing", "pending").otherwise(F.col("v.state")).alias("state"), F.when(F.col("v.state") == "missing", "not published").otherwise(F.col("v.reason")).alias("reason"))


# --- a content-addressed cache ------------------------------------------------------------------------------------------

#: What the metadata of a cached sequence state.
STATED = {"representation": "relative_disparity", "encoding": "uint16_png"}
METADATA = "representation STRING, near_value DOUBLE, far_value DOUBLE, encoding STRING, num_frames INT, frame_names ARRAY<STRING>, source_model_fingerprint STRING, fingerprint STRING"


def metadata_checks(document: Column, frames: Column, model: Column) -> list[Check]:
    """Whether a sequence's metadata are what a cache may keep and give back for so many frames of a model."""
    d = F.from_json(document, METADATA)
    return [
        Check("metadata can't be read", d.isNotNull()),
        *[Check(k, d[k] == v) for k, v in STATED.items()],
        Check("value range", (d["near_value"] == 1.0) & (d["far_value"] == 0.0)),
        Check("number of frames", (d["num_frames"] == frames) & (F.size(d["frame_names"]) == frames)),
        Check("metadata hash mismatch", is_sealed(document)),
        Check("model fingerprint", model.isNotNull() & (model != "") & (d["source_model_fingerprint"] == model)),
    ]


class CacheStore:
    """Sequences by the key of their content and settings, each stored once, with metadata that are checked in both directions."""

    def __init__(self, spark: SparkSession, root: str, key: str = "cache_key", index: str = "frame_idx"):
        self.key = key
        self.store = Published(spark, root, [key], index, write_once=True)

    def put(self, rows: DataFrame, entries: DataFrame) -> None:
        """Stores the entries (key, frames, model, document) whose metadata hold and that aren't there; ``rows`` has their frames."""
        good = entries.filter(reduce(lambda a, c: a & F.coalesce(c.holds, F.lit(False)), metadata_checks(F.col("document"), F.col("frames"), F.col("model")), F.lit(True)))
        self.store.publish(rows.join(good.select(self.key), self.key, "left_semi"), good.select(self.key, F.col("frames").alias("expected")), good.select(self.key, "document"))

    def look_up(self, asked: DataFrame) -> DataFrame:
        """``asked`` (key, frames, model) with hit and reason."""
        m = self.store.manifests()
        if m is None:
            return asked.withColumns({"hit": F.lit(False), "reason": F.lit("absent")})
        found = asked.join(m.select(self.key, F.col("document").alias("__m"), F.col("n").alias("__n")), self.key, "left")
        about = F.get_json_object("__m", "$.about")
        checks = [Check("manifest hash mismatch", is_sealed(F.col("__m")), "miss"), Check("number of stored frames", F.col("__n") == F.col("frames"), "miss"), *[Check(c.reason, c.holds, "miss") for c in metadata_checks(about, F.col("frames"), F.col("model"))]]
        v = found.withColumn("__v", judged(F.col("__m").isNotNull(), checks, "hit", "hit"))
        return v.select(*asked.columns, (F.col("__v.state") == "hit").alias("hit"), F.col("__v.reason").alias("reason"))

    def read(self) -> DataFrame | None:
        return self.store.read()
