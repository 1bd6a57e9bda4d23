"""Stores that publish: failures between steps, write-once keys, promotion."""

import json

import pytest
from pyspark.sql import functions as F

from fathomline.plans import manifests
from fathomline.sources import published

SHOT = "shot int, i int, v double"


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/store"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_shot_is_seen_when_it_is_published(spark, root):
    store = published.Published(spark, root, ["shot"], "i")
    plan = spark.createDataFrame([(1, 2), (2, 1)], "shot int, expected int")
    assert store.read() is None and {r.state for r in store.audit(plan).collect()} == {"pending"}
    old = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.25), (2, 0, 1.0)], SHOT)
    store.publish(old, plan)
    assert rows(store.read()) == rows(old) and {r.state for r in store.audit(plan).collect()} == {"reusable"}
    # A job that ends between writing and publishing, and one whose shot isn't whole, leave the old shot readable.
    store.stage(spark.createDataFrame([(1, 0, 9.0), (1, 1, 9.0)], SHOT), plan.filter("shot = 1"))
    for bad in ([(1, 0, 9.0)], [(1, 0, 9.0), (1, 2, 9.0)], [(1, 0, 9.0), (1, 0, 9.0)], [(1, 0, 9.0), (1, 1, 9.0), (3, 0, 9.0)], []):
        with pytest.raises(ValueError, match="not whole"):
            store.publish(spark.createDataFrame(bad, SHOT), plan.filter("shot = 1"))
    assert rows(store.read()) == rows(old)
    new = spark.createDataFrame([(1, 0, 7.0), (1, 1, 8.0)], SHOT)
    store.publish(new, plan.filter("shot = 1"))
    assert rows(store.read()) == rows(new.unionAll(old.filter("shot = 2")))


def test_audits_find_changed_rows(spark, root):
    store = published.Published(spark, root, ["shot"], "i")
    plan = spark.createDataFrame([(1, 2), (2, 1)], "shot int, expected int")
    store.publish(spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.25), (2, 0, 1.0)], SHOT), plan)
    batch = store.manifests().first().batch
    spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.26), (2, 0, 1.0)], SHOT).write.mode("overwrite").parquet(f"{root}/data/{published.BATCH}={batch}")
    got = {r.shot: (r.state, r.reason) for r in store.audit(plan.withColumn("expected", F.when(F.col("shot") == 2, 5).otherwise(2))).collect()}
    assert got == {1: ("invalid", "rows changed"), 2: ("invalid", "length differs from the plan")}


def test_documents_are_swapped_whole(spark, root):
    assert published.read_documents(spark, root) is None
    one, two = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("c",)], "k string")
    published.write_documents(one, root)
    with pytest.raises(Exception, match="stopped"):
        published.write_documents(one.select(F.raise_error(F.lit("stopped")).cast("string").alias("k")), root)
    assert rows(published.read_documents(spark, root)) == [("a",), ("b",)]
    published.write_documents(two, root)
    assert rows(published.read_documents(spark, root)) == [("c",)] and len(published.Log(spark, root).leftovers()) == 1


MAPS = "clip int, frame int, `values` array<float>"


def test_types_are_promoted_for_the_whole_store(spark, root):
    store = published.RawStore(spark, root, ["clip", "frame"])
    first = spark.createDataFrame([(1, 0, [0.1, 2.0]), (1, 1, [float("inf"), 3.0])], MAPS)
    assert store.append(first) == "float16" and store.append(first) == "float16"
    half = {r.frame: r["values"] for r in store.read().collect()}
    assert len(half) == 2 and half[0][0] != pytest.approx(0.1, abs=1e-7) and half[0][0] == pytest.approx(0.1, abs=1e-3) and half[1][0] == float("inf")
    big = spark.createDataFrame([(1, 2, [70000.0, 0.1])], MAPS)
    with pytest.raises(ValueError, match="half"):
        store.append(big, "float16")
    assert store.read().count() == 2 and store.dtype() == "float16"
    assert store.append(big) == "float32" and set(store.log.live().values()) == {"float32"}
    got = {r.frame: r["values"] for r in store.read().collect()}
    assert got[0] == half[0] and got[2][0] == 70000.0  # promoted maps keep the values that they were stored with
    assert store.append(spark.createDataFrame([(1, 3, [0.1])], MAPS)) == "float32" and store.read().count() == 4
    assert store.append(big, "float32") == "float32" and store.read().count() == 4


def test_promotion_can_be_asked_for(spark, root):
    store = published.RawStore(spark, root, ["clip", "frame"])
    one = spark.createDataFrame([(1, 0, [0.5])], MAPS)
    assert store.append(one) == "float16" and store.append(one, "float32") == "float32"
    assert store.read().count() == 1 and store.dtype() == "float32"
    with pytest.raises(ValueError, match="unknown"):
        store.append(one, "float64")


def document(frames, model="m", **changes):
    return json.dumps({"representation": "relative_disparity", "near_value": 1.0, "far_value": 0.0, "encoding": "uint16_png", "num_frames": frames, "frame_names": [f"f{i}" for i in range(frames)], "source_model_fingerprint": model, **changes})


def entries(spark, *found):
    df = spark.createDataFrame(found, "cache_key string, frames int, model string, document string")
    return df.withColumn("document", manifests.sealed(F.col("document")))


FRAME = "cache_key string, frame_idx int, v int"


def test_cache_keeps_the_first_and_checks_what_it_gives(spark, root):
    store = published.CacheStore(spark, root)
    asked = spark.createDataFrame([("a", 2, "m"), ("a", 3, "m"), ("a", 2, "other"), ("a", 2, ""), ("b", 1, "m"), ("c", 1, "m")], "cache_key string, frames int, model string")
    assert not any(r.hit for r in store.look_up(asked).collect())
    frames = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("b", 0, 3)], FRAME)
    store.put(frames, entries(spark, ("a", 2, "m", document(2)), ("b", 1, "m", document(1, near_value=0.5))))
    store.put(spark.createDataFrame([("a", 0, 9), ("a", 1, 9)], FRAME), entries(spark, ("a", 2, "m", document(2))))
    got = {(r.cache_key, r.frames, r.model): (r.hit, r.reason) for r in store.look_up(asked).collect()}
    assert got == {("a", 2, "m"): (True, "hit"), ("a", 3, "m"): (False, "number of stored frames"), ("a", 2, "other"): (False, "model fingerprint"), ("a", 2, ""): (False, "model fingerprint"), ("b", 1, "m"): (False, "absent"), ("c", 1, "m"): (False, "absent")}
    assert rows(store.read()) == [("a", 0, 1), ("a", 1, 2)]


def test_two_writers_of_one_key(spark, root):
    """Both saw an empty store: the rows of one of them count, for every reader."""
    a, b = (published.Published(spark, root, ["shot"], "i", write_once=True) for _ in range(2))
    plan = spark.createDataFrame([(1, 1)], "shot int, expected int")
    late = b.stage(spark.createDataFrame([(1, 0, 2.0)], SHOT), plan)[0]
    a.publish(spark.createDataFrame([(1, 0, 1.0)], SHOT), plan)
    b.listed.commit(b.listed.write(a.listed.read().withColumn("batch", F.lit(late))))  # the same version
    assert a.read().count() == b.read().count() == 1 and rows(a.read()) == rows(b.read())
    a.publish(spark.createDataFrame([(1, 0, 5.0)], SHOT), plan)
    assert rows(a.read())[0][2] != 5.0
