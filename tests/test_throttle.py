"""Throttled progress: intervals, held events, ends, and the same on a stream in any order."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from fathomline.streaming import progress

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "job int, at timestamp, share double, last boolean"


def said(events, interval=100):
    t = progress.Throttle(interval)
    out = [s for at, p in events for s in t.event(at, p, False)]
    return out + list(t.end())


def test_intervals_and_held_events():
    assert said([(0, 0.1), (50, 0.2), (60, 0.3), (100, 0.4), (150, 0.5)]) == [(0, 0.1), (100, 0.4), (200, 0.5)]
    assert said([(0, 0.1), (50, 0.2), (260, 0.3)]) == [(0, 0.1), (100, 0.2), (260, 0.3)]
    assert said([(0, 0.5), (200, 0.2), (400, 0.7)]) == [(0, 0.5), (200, 0.5), (400, 0.7)]
    assert said([]) == [] and said([(7, 1.0)]) == [(7, 1.0)] and said([(7, 0.1), (7, 0.9)]) == [(7, 0.1), (107, 0.9)]


@pytest.mark.parametrize("seed", range(5))
def test_at_most_one_in_an_interval_and_the_last_always(seed):
    rnd = random.Random(seed)
    events = sorted((rnd.randrange(5000), rnd.random()) for _ in range(rnd.randrange(1, 200)))
    out = said(events)
    assert all(b[0] - a[0] >= 100 for a, b in zip(out, out[1:])) and out[-1][1] == max(p for _, p in events)
    assert [p for _, p in out] == sorted(p for _, p in out)


def rows(jobs, n, seed):
    rnd = random.Random(seed)
    out = []
    for j in range(jobs):
        times = sorted(rnd.randrange(3_000_000) for _ in range(n))
        out += [(j, START + timedelta(microseconds=t), rnd.random(), i == n - 1) for i, t in enumerate(times)]
    return out


def key(df):
    return sorted((r.job, str(r.said_at), round(r.progress, 9)) for r in df.collect())


def test_a_table(spark):
    every = rows(3, 80, 1)
    got = key(progress.throttled(spark.createDataFrame(every, SCHEMA), "job", "at", "share", F.col("last")))
    want = []
    for j in range(3):
        own = sorted((int((t - START) / timedelta(microseconds=1)), p) for k, t, p, _ in every if k == j)
        want += [(j, str((START + timedelta(microseconds=t)).replace(tzinfo=None)), round(p, 9)) for t, p in said(own, 100_000)]
    assert [(j, datetime.fromisoformat(t), p) for j, t, p in got] == sorted((j, datetime.fromisoformat(t), p) for j, t, p in want)
    null = spark.createDataFrame([(1, None, 0.5, False), (1, START, None, True)], SCHEMA)
    assert progress.throttled(null, "job", "at", "share", F.col("last")).count() == 0


def test_a_stream_in_disorder_gives_what_a_table_gives(spark, tmp_path):
    every = rows(4, 60, 2)
    order = sorted(every, key=lambda r: r[1].timestamp() + (0 if r[3] else random.Random(str(r)).uniform(-0.3, 0.3)))
    for i in range(6):
        spark.createDataFrame(order[i * 40 : (i + 1) * 40], SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"file://{tmp_path}/in/*")
    q = progress.throttled(stream, "job", "at", "share", F.col("last"), late="10 seconds").writeStream.format("memory").queryName("throttled_progress").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert key(spark.table("throttled_progress")) == key(progress.throttled(spark.createDataFrame(every, SCHEMA), "job", "at", "share", F.col("last")))


def test_timers_say_held_events_of_jobs_that_go_on(spark, tmp_path):
    ms = lambda n: START + timedelta(milliseconds=n)
    files = [[(1, ms(0), 0.1, False), (1, ms(50), 0.2, False)], [(2, ms(30_000), 0.5, False)], [(2, ms(60_000), 0.6, False)]]
    for i, f in enumerate(files):
        spark.createDataFrame(f, SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    q = progress.throttled(stream, "job", "at", "share", F.col("last"), late="1 second").writeStream.format("memory").queryName("held_progress").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.job, r.progress) for r in spark.table("held_progress").orderBy("said_at").collect() if r.job == 1] == [(1, 0.1), (1, 0.2)]
