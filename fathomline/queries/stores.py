"""Stores that publish (S-10, S-12, S-17, J-05, B-10): written to the shared scratch folder from the driver's tables, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.plans import manifests
from fathomline.queries import query, table
from fathomline.scratch import Scratch
from fathomline.sources.published import BATCH, CacheStore, Published, RawStore

_WHOLE_SQL = "w AS (SELECT conv_id AS shot, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) = max(turn) + 1 AND count(DISTINCT turn) = count(*) AND min(turn) = 0)"


def _shots(spark, sf):
    """Conversations whose turns are numbered without gaps are shots; (shot, i, v) and (shot, expected)."""
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("shot"), F.col("turn").alias("i"), F.length("text").alias("v"))
    seen = turns.groupBy("shot").agg(F.count(F.lit(1)).alias("expected"), F.max("i").alias("hi"), F.min("i").alias("lo"), F.countDistinct("i").alias("d"))
    planned = seen.filter("lo = 0 AND hi = expected - 1 AND d = expected").select("shot", "expected")
    return turns.join(planned, "shot").select("shot", "i", "v"), planned


@query("s12_b10_published_shots", f"WITH {_WHOLE_SQL} SELECT shot, turn AS i, CAST(len(text) AS INTEGER) + CASE WHEN shot % 5 = 0 THEN 100 ELSE 0 END AS v FROM conversations JOIN w ON shot = conv_id")
def s12(spark, sf):
    """Shots published, some of them again, and some written a third time by a job that ends before it publishes."""
    rows, planned = _shots(spark, sf)
    store = Published(spark, Scratch(spark, "shots").base, ["shot"], "i")
    some = F.col("shot") % 5 == 0
    store.publish(rows, planned)
    store.publish(rows.filter(some).withColumn("v", F.col("v") + 100), planned.filter(some))
    store.stage(rows.filter(F.col("shot") % 3 == 0).withColumn("v", F.lit(-1)), planned.filter("shot % 3 = 0"))
    return store.read()


@query("j05_b10_verified_shots", f"""WITH {_WHOLE_SQL} SELECT shot, CASE WHEN shot % 4 = 0 THEN 'pending' WHEN shot % 7 = 0 OR shot % 5 = 0 THEN 'invalid' ELSE 'reusable' END AS state,
CASE WHEN shot % 4 = 0 THEN 'not published' WHEN shot % 7 = 0 THEN 'length differs from the plan' WHEN shot % 5 = 0 THEN 'rows changed' ELSE 'reusable' END AS reason FROM w""")
def j05_verified(spark, sf):
    """Published shots whose rows were changed behind the store's back, and plans of other lengths, are found by the digests of what is there."""
    rows, planned = _shots(spark, sf)
    store = Published(spark, Scratch(spark, "verified").base, ["shot"], "i")
    there = F.col("shot") % 4 != 0
    store.publish(rows.filter(there), planned.filter(there))
    path = f"{store.log.root}/data/{BATCH}={store.manifests().first()['batch']}"
    changed = F.when((F.col("shot") % 5 == 0) & (F.col("i") == 0), F.col("v") + 1).otherwise(F.col("v"))
    rows.filter(there).withColumn("v", changed).write.mode("overwrite").parquet(path)
    return store.audit(planned.withColumn("expected", F.when(F.col("shot") % 7 == 0, 99).otherwise(F.col("expected"))))


@query("s17_cache_store", f"""WITH {_WHOLE_SQL} SELECT shot AS cache_key, shot % 3 <> 0 AND shot % 5 <> 0 AND shot % 7 <> 0 AS hit,
CASE WHEN shot % 3 = 0 THEN 'absent' WHEN shot % 7 = 0 THEN 'number of stored frames' WHEN shot % 5 = 0 THEN 'model fingerprint' ELSE 'hit' END AS reason FROM w""")
def s17_store(spark, sf):
    """Shots by key: metadata that don't hold are not stored, entries are stored once, and what is given back fits what was asked."""
    rows, planned = _shots(spark, sf)
    store = CacheStore(spark, Scratch(spark, "cache").base, index="i")
    names = F.transform(F.sequence(F.lit(1), F.col("expected").cast("int")), lambda i: F.format_string("frame_%06d.png", i))
    about = F.struct(F.lit("relative_disparity").alias("representation"), F.when(F.col("shot") % 3 == 0, 0.5).otherwise(1.0).alias("near_value"), F.lit(0.0).alias("far_value"), F.lit("uint16_png").alias("encoding"), F.col("expected").alias("num_frames"), names.alias("frame_names"), F.lit("m1").alias("source_model_fingerprint"))
    entries = planned.select(F.col("shot").alias("cache_key"), F.col("expected").cast("int").alias("frames"), F.lit("m1").alias("model"), manifests.sealed(F.to_json(about)).alias("document"))
    frames = rows.withColumnRenamed("shot", "cache_key")
    store.put(frames, entries)
    store.put(frames.withColumn("v", F.lit(-1)), entries)  # adds nothing
    k = F.col("shot")
    asked = planned.select(k.alias("cache_key"), F.when(k % 7 == 0, 99).otherwise(F.col("expected")).cast("int").alias("frames"), F.when(k % 5 == 0, "m2").otherwise("m1").alias("model"))
    return store.look_up(asked).select("cache_key", "hit", "reason")


@query("s10_promoted_maps", "SELECT vec_id, 'float32' AS dtype, CAST(len(embedding) AS INTEGER) AS n, true AS close FROM embeddings")
def s10(spark, sf):
    """Vectors as maps in three batches: half floats fit the first two, the third makes the whole store single precision; a repeated batch adds nothing."""
    maps = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x * F.when(F.col("vec_id") % 3 == 2, 1e6).otherwise(1.0)).cast("float")).alias("values"))
    store = RawStore(spark, Scratch(spark, "raw").base, ["vec_id"])
    for i in (0, 1, 1, 2):
        store.append(maps.filter(F.col("vec_id") % 3 == i))
    both = store.read().join(maps.withColumnRenamed("values", "__was"), "vec_id")
    near = F.forall(F.arrays_zip("values", "__was"), lambda z: F.abs(z["values"] - z["__was"]) <= F.abs(z["__was"]) / 1024 + 1e-6)
    return both.select("vec_id", F.lit(store.dtype()).alias("dtype"), F.size("values").alias("n"), near.alias("close"))
