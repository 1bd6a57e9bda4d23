"""Bounded samples of scenes, and scenes merged by the bounds of their samples without pooling a clip."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from fathomline.operators.sequences import MERGE_SHARE, even_indexes
from fathomline.scratch import Scratch

#: Frames of a scene, and places of a side of a map, that a sample takes at most; and the shares that bound a scene.
FRAMES, PLACES = 32, 64
LOW, HIGH = 0.02, 0.98


def scene_samples(maps: DataFrame, clip: str, scene: str, frame: str, values: str, height: str, width: str, score: Callable[[Column], Column] | None = None, frames: int = FRAMES, places: int = PLACES) -> DataFrame:
    """clip, scene, frames and the ordered finite values at evenly spread places of evenly spread frames of each scene.

    ``values`` is a map row by row; ``score`` takes a value to what is sampled, null where it isn't valid. Places are picked by
    index, so pixels are never exploded, and a map is cut to its places before it crosses the network; what is gathered of a scene is at
    most ``frames * places ** 2`` values.
    """
    rows, columns = even_indexes(F.col(height), places), even_indexes(F.col(width), places)
    at = F.flatten(F.transform(rows, lambda y: F.transform(columns, lambda x: F.get(F.col(values), (y * F.col(width) + x).cast("int")))))
    cut = maps.select(F.col(clip).alias("c"), F.col(scene).alias("s"), F.col(frame).alias("f"), at.alias("at"))
    if score is not None:
        cut = cut.withColumn("at", F.transform("at", score))
    finite = F.filter("at", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    w = Window.partitionBy("c", "s")
    ranked = cut.select("c", "s", "f", finite.alias("at"), (F.row_number().over(w.orderBy("f")) - 1).alias("i"), F.count(F.lit(1)).over(w).cast("int").alias("n"))
    picked = ranked.filter(F.array_contains(even_indexes(F.col("n"), frames), F.col("i")))
    out = picked.groupBy("c", "s").agg(F.count(F.lit(1)).alias("frames"), F.array_sort(F.flatten(F.collect_list("at"))).alias("sample"))
    return out.withColumnsRenamed({"c": clip, "s": scene})


@dataclass(frozen=True)
class Tails:
    """The ends of an ordered sample: enough to tell its bounds and those of any union of up to ``most`` values."""

    n: int
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def kept(most: int) -> int:
        return int(LOW * max(most - 1, 0)) + 2

    @staticmethod
    def of(ordered: np.ndarray, most: int) -> "Tails":
        k = Tails.kept(most)
        return Tails(len(ordered), ordered[:k], ordered[max(0, len(ordered) - k) :])

    def plus(self, other: "Tails", most: int) -> "Tails":
        k = Tails.kept(most)
        low, high = (np.sort(np.concatenate(x), kind="stable") for x in ((self.low, other.low), (self.high, other.high)))
        return Tails(self.n + other.n, low[:k], high[max(0, len(high) - k) :])

    def bounds(self) -> tuple[float, float]:
        """The 2nd and 98th percentile, interpolated; 0 and 0 of nothing."""
        if not self.n:
            return 0.0, 0.0
        at = LOW * (self.n - 1)
        i, part = int(at), at - int(at)
        value = lambda v, j: float(v[min(max(j, 0), len(v) - 1)])
        low = value(self.low, i) + (value(self.low, i + 1) - value(self.low, i)) * part
        at = HIGH * (self.n - 1)
        i, part, back = int(at), at - int(at), self.n - len(self.high)
        return low, value(self.high, i - back) + (value(self.high, i + 1 - back) - value(self.high, i - back)) * part


def alike(a: Tails, b: Tails, share: float) -> bool:
    """Whether bounds differ by at most a share of what both span; of a sample and none they do."""
    if not (a.n and b.n):
        return a.n == b.n
    (la, ha), (lb, hb) = a.bounds(), b.bounds()
    return max(abs(la - lb), abs(ha - hb)) <= share * (max(ha, hb) - min(la, lb))


def merge_scenes(samples: DataFrame, clip: str, scene: str, sample: str = "sample", share: float = MERGE_SHARE) -> DataFrame:
    """Merges neighbouring scenes of alike bounds until none is left to merge: clip, scene, merged_id, low, high, n.

    ``samples``: ordered finite values of each scene, as of ``scene_samples``. Each round reads a clip's scenes in order and
    holds the tails of two blocks, a 25th of their values; rounds end when the number of blocks stays. Between rounds only the block of each scene is kept.
    """
    spark = samples.sparkSession
    store = Scratch(spark, "scenes")
    kind, name = (samples.schema[c].dataType.simpleString() for c in (clip, scene))
    total = F.sum(F.size(sample)).over(Window.partitionBy(clip))
    # As many rows as scenes; each has the clip's total, by which tails are cut.
    rows = store.save(samples.select(F.col(clip).alias("c"), F.col(scene).alias("s"), F.col(sample).cast("array<double>").alias("v"), total.alias("most")), "rows")
    blocks = store.save(rows.select("c", "s", F.col("s").alias("b")), "blocks0")
    out = f"c {kind}, s {name}, b {name}, merged_id int, low double, high double, n long"
    number, count = 0, rows.count()
    while True:
        now = rows.join(blocks, ["c", "s"]).repartition("c").sortWithinPartitions("c", "s")
        made = store.save(now.mapInPandas(lambda parts: _round(parts, share), out), f"round{number}")
        left = made.select("c", "b").distinct().count()
        if left == count:
            return made.select("c", "s", "merged_id", "low", "high", "n").withColumnsRenamed({"c": clip, "s": scene})
        blocks, count, number = made.select("c", "s", "b"), left, number + 1


def _round(parts: Iterator[pd.DataFrame], share: float) -> Iterator[pd.DataFrame]:
    """One pass over scenes in order: a block takes the next one, or is closed by it."""
    clip = None
    done, closed = 0, []  # blocks that were closed in this clip, rows that are ready
    held: tuple[list, Tails] | None = None  # the block that may take more
    coming: tuple[object, list, Tails] | None = None  # the block whose scenes are still being read

    def close():
        nonlocal held, done
        if held:
            names, tails = held
            low, high = tails.bounds()
            closed.extend((clip, s, names[0], done, low, high, tails.n) for s in names)
            held, done = None, done + 1

    def settle():
        nonlocal held, coming
        if coming:
            _, names, tails = coming
            if held and alike(held[1], tails, share):
                held = ([*held[0], *names], held[1].plus(tails, most))
            else:
                close()
                held = (names, tails)
            coming = None

    most = 0
    for pdf in parts:
        for c, s, b, v, total in zip(pdf["c"], pdf["s"], pdf["b"], pdf["v"], pdf["most"]):
            if c != clip:
                settle()
                close()
                clip, done, most = c, 0, int(total)
            tails = Tails.of(np.asarray(v, float), most)
            if coming and coming[0] == b:
                coming = (b, [*coming[1], s], coming[2].plus(tails, most))
            else:
                settle()
                coming = (b, [s], tails)
        yield pd.DataFrame(closed, columns=["c", "s", "b", "merged_id", "low", "high", "n"])
        closed.clear()
    settle()
    close()
    yield pd.DataFrame(closed, columns=["c", "s", "b", "merged_id", "low", "high", "n"])
