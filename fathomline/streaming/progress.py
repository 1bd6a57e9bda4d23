"""Progress of running jobs as streams: event tables and encoder log lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType


def encoder_frame(line: Column, total: Column) -> Column:
    """The frame number of a ``frame= N`` line, at most the total; null for other lines."""
    n = F.regexp_extract(line, r"frame=\s*([0-9]+)", 1).try_cast("long")
    return F.when(n.isNotNull(), F.least(n, total.cast("long")))


def event_counts(events: DataFrame, time: str, by: list[str], window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and means by tumbling window; with a watermark, so that on a stream old windows are closed and their state is dropped.

    A watermark wants a time with zone: on a stream one without is taken in the session's.
    """
    marked = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, window).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("window_start"), *by, "n", "mean_value")


#: Fixed value: microseconds between two events of a job at least.
INTERVAL = 100_000


@dataclass
class Throttle:
    """One job's progress: what was said last, what is held back, and what waits for the watermark.

    An event is said at once if the last one was said long enough ago; else it is held, and the newest held event is said when the interval is
    over, unless an event comes just then. Progress never falls.
    """

    interval: int
    last: int | None = None
    held: bool = False
    best: float = 0.0
    waiting: list[tuple[int, float, bool]] = field(default_factory=list)

    def timer(self, now: int) -> Iterator[tuple[int, float]]:
        """The held event, if its time is before now."""
        if self.held and self.last + self.interval < now:
            self.last, self.held = self.last + self.interval, False
            yield self.last, self.best

    def event(self, at: int, progress: float, done: bool) -> Iterator[tuple[int, float]]:
        yield from self.timer(at)
        self.best = max(self.best, progress)
        if self.last is None or at >= self.last + self.interval:
            self.last, self.held = at, False
            yield at, self.best
        else:
            self.held = True
        if done:
            yield from self.end()

    def end(self) -> Iterator[tuple[int, float]]:
        """The last event is said in any case."""
        if self.held:
            self.last, self.held = self.last + self.interval, False
            yield self.last, self.best

    def ready(self, until: int | None) -> Iterator[tuple[int, float]]:
        """Says what is known for sure: events up to a time (None: all), in order."""
        self.waiting.sort()
        while self.waiting and (until is None or self.waiting[0][0] <= until):
            yield from self.event(*self.waiting.pop(0))
        if until is not None:
            yield from self.timer(until)

    def next(self) -> int | None:
        """When there is something to do without another event."""
        times = [self.waiting[0][0]] if self.waiting else []
        return min([*times, *([self.last + self.interval] if self.held else [])], default=None)

    def row(self) -> tuple:
        return self.last, self.held, self.best, [w[0] for w in self.waiting], [w[1] for w in self.waiting], [w[2] for w in self.waiting]


_STATE = StructType([StructField("last", LongType()), StructField("held", BooleanType()), StructField("best", DoubleType()), StructField("ats", ArrayType(LongType())), StructField("shares", ArrayType(DoubleType())), StructField("dones", ArrayType(BooleanType()))])


def throttled(events: DataFrame, job: str, at: str, progress: str, done: Column, interval: int = INTERVAL, late: str = "2 seconds") -> DataFrame:
    """job, said_at and progress: at most one event of a job in ``interval`` microseconds, progress that never falls, and the last event always.

    On a stream events wait until the watermark (``late``) has passed them, so they are taken in order of time and the result is the one of a
    table; timers say held events when no others come. An event that is ``done`` ends its job: all that waits is said and its state is dropped. Events
    without a time or progress are left out; on a table jobs end with their rows.
    """
    kind = events.schema[job].dataType
    out = StructType([StructField("j", kind), StructField("said_at", LongType()), StructField("progress", DoubleType())])
    plain = events.select(F.col(job).alias("j"), F.col(at).cast("timestamp").alias("t"), F.col(progress).cast("double").alias("p"), F.coalesce(done, F.lit(False)).alias("d")).filter("t IS NOT NULL AND p IS NOT NULL")
    frame = lambda key, said: pd.DataFrame([(key, t, p) for t, p in said], columns=["j", "said_at", "progress"])

    def keep(key, parts, state):
        last, held, best, ats, shares, dones = state.get if state.exists else (None, False, 0.0, [], [], [])
        now = Throttle(interval, last, held, best, waiting=list(zip(ats, shares, dones)))
        for pdf in parts:
            now.waiting += [(int(u), float(p), bool(d)) for u, p, d in zip(pdf["u"], pdf["p"], pdf["d"])]
        mark = state.getCurrentWatermarkMs()
        if any(w[2] for w in now.waiting):
            yield frame(key[0], [*now.ready(None), *now.end()])
            if state.exists:
                state.remove()
            return
        yield frame(key[0], now.ready(mark * 1000))
        state.update(now.row())
        if (time := now.next()) is not None:
            state.setTimeoutTimestamp(max(time // 1000, mark) + 1)

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, key, said = None, None, []
        for pdf in parts:
            for j, u, p, d in zip(pdf["j"], pdf["u"], pdf["p"], pdf["d"]):
                if now is None or j != key:
                    said += [(key, *s) for s in now.end()] if now else []
                    now, key = Throttle(interval), j
                said += [(key, *s) for s in now.event(int(u), float(p), bool(d))]
            yield pd.DataFrame(said, columns=["j", "said_at", "progress"])
            said = []
        if now:
            yield pd.DataFrame([(key, *s) for s in now.end()], columns=["j", "said_at", "progress"])

    micros = F.unix_micros("t").alias("u")
    if events.isStreaming:
        from pyspark.sql.streaming.state import GroupStateTimeout

        found = plain.withWatermark("t", late).select("j", "t", micros, "p", "d").groupBy("j").applyInPandasWithState(keep, out, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    else:
        found = plain.select("j", micros, "p", "d").repartition("j").sortWithinPartitions("j", "u", "p", "d").mapInPandas(read, out)
    return found.select(F.col("j").alias(job), F.timestamp_micros("said_at").alias("said_at"), "progress")


def run_available(spark: SparkSession, source: str, schema, build, name: str) -> DataFrame:
    """Runs a streaming query over all files there are, and returns what it gave (kept in memory: for reports and tests)."""
    stream = build(spark.readStream.schema(schema).parquet(source))
    query = stream.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.table(name)
