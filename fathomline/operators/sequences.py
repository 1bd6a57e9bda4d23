"""Operators on ordered sequences: cuts, ranges, gaps, windows, fills."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Fixed value: neighbouring segments merge if their bounds differ by at most this share of their joint span.
MERGE_SHARE = 0.10


def histogram_distance(a: Column, b: Column) -> Column:
    """Bhattacharyya distance of two histograms given as arrays."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda s, x: s + x)
    root = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(root, F.sqrt(total(a) * total(b))), F.lit(1.0))))


def accepted_cuts(df: DataFrame, clip: str, index: str, distance: str, threshold: float, min_frames: int) -> DataFrame:
    """For each clip its frame count and cut indexes: frames at or over the threshold, each at least ``min_frames`` after the
    last accepted one, and none so late that the tail would be shorter.

    Only candidates are gathered, so a clip's array is as long as it has near-cuts and not frames.
    """
    frames = df.groupBy(clip).agg((F.max(index) + 1).alias("n"), F.array_sort(F.collect_list(F.when(F.col(distance) >= threshold, F.col(index)))).alias("candidates"))

    def accept(kept: Column, i: Column) -> Column:
        last = F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(0))
        return F.when(i - last >= min_frames, F.concat(kept, F.array(i))).otherwise(kept)

    cuts = F.aggregate("candidates", F.array().cast("array<int>"), accept)
    return frames.select(clip, "n", F.filter(cuts, lambda c: F.col("n") - c >= min_frames).alias("cuts"))


def segment_ids(df: DataFrame, clip: str, index: str, is_cut: Column, name: str = "segment_id") -> DataFrame:
    return df.withColumn(name, F.sum(is_cut.cast("int")).over(Window.partitionBy(clip).orderBy(index)).cast("int"))


def ranges(starts: DataFrame, clip: str, start: str, total: str) -> DataFrame:
    """Half-open ranges from the starts of each clip; the last ends with the clip."""
    return starts.withColumn("end", F.lead(start).over(Window.partitionBy(clip).orderBy(start))).withColumn("end", F.coalesce("end", total))


@dataclass(frozen=True)
class _Pool:
    """Segments taken together: their names, and their finite samples in order."""

    names: tuple
    sample: np.ndarray

    @cached_property
    def ends(self) -> np.ndarray:
        return np.percentile(self.sample, [2, 98]) if self.sample.size else np.zeros(2)

    def __add__(self, other: "_Pool") -> "_Pool":
        return _Pool(self.names + other.names, np.sort(np.concatenate([self.sample, other.sample]), kind="stable"))

    def takes(self, other: "_Pool", share: float) -> bool:
        """Whether the ends lie within a share of what both cover; of a sample and none they don't."""
        if not (self.sample.size and other.sample.size):
            return self.sample.size == other.sample.size
        both = np.stack([self.ends, other.ends])
        return bool(np.ptp(both, axis=0).max() <= share * np.ptp(both))


def merge_segments(samples: DataFrame, clip: str, segment: str, value: str, share: float = MERGE_SHARE) -> DataFrame:
    """Merges neighbouring segments of alike 2nd and 98th percentiles until none is left to merge.

    Returns clip, segment, merged_id, low, high and n, the number of finite samples. The samples of a segment are gathered in order by
    Spark; a segment should come with a bounded sample (see ``even_indexes``), as one clip's pools are folded in one group: a pool takes the
    next segment or the next one begins a pool, and pools are folded again until their number stays.
    """

    def fold(pools: list[_Pool]) -> list[_Pool]:
        def add(done: list[_Pool], pool: _Pool) -> list[_Pool]:
            return [*done[:-1], done[-1] + pool] if done and done[-1].takes(pool, share) else [*done, pool]

        once = reduce(add, pools, [])
        return once if len(once) == len(pools) else fold(once)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pools = fold([_Pool((name,), np.asarray(v, float)) for name, v in pdf.sort_values("s")[["s", "v"]].itertuples(index=False)])
        rows = [(pdf["c"].iloc[0], name, i, *pool.ends, pool.sample.size) for i, pool in enumerate(pools) for name in pool.names]
        return pd.DataFrame(rows, columns=["c", "s", "merged_id", "low", "high", "n"])

    kinds, v = dict(samples.dtypes), F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    gathered = samples.groupBy(F.col(clip).alias("c"), F.col(segment).alias("s")).agg(F.array_sort(F.collect_list(F.when(finite, v))).alias("v"))
    out = gathered.groupBy("c").applyInPandas(settle, f"c {kinds[clip]}, s {kinds[segment]}, merged_id int, low double, high double, n long")
    return out.withColumnsRenamed({"c": clip, "s": segment})


def even_indexes(n: Column, k: int) -> Column:
    """At most k indexes of 0..n-1, evenly spread and rounded half to even."""
    every = F.sequence(F.lit(0), n - 1)
    some = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (n - 1) / float(max(k - 1, 1))).cast("int")))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= k, every).otherwise(F.array(F.lit(0)) if k == 1 else some)


def window_starts(n: Column, size: int, stride: int, until_end: bool) -> Column:
    """Starts of overlapping windows: at every multiple of the stride, or only until a window reaches the end."""
    last = F.greatest(F.lit(0), F.ceil((n - size) / float(stride)).cast("int")) * stride if until_end else n - 1
    return F.when(n > 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def runs_where(df: DataFrame, clip: list[str], index: str, flag: Column) -> DataFrame:
    """Maximal runs of consecutive indexes at which a flag holds: clip, run_start, run_end (inclusive), run_length."""
    w = Window.partitionBy(*clip).orderBy(index)
    marked = df.filter(flag).withColumn("__g", F.col(index) - F.row_number().over(w))
    return marked.groupBy(*clip, "__g").agg(F.min(index).alias("run_start"), F.max(index).alias("run_end"), F.count(F.lit(1)).alias("run_length")).drop("__g")


def nearest_valid(df: DataFrame, row: list[str], index: str, valid: Column) -> DataFrame:
    """Adds left_index and right_index, the nearest valid positions on either side (itself included)."""
    w, at = Window.partitionBy(*row).orderBy(index), F.when(valid, F.col(index))
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({"left_index": F.last(at, ignorenulls=True).over(before), "right_index": F.first(at, ignorenulls=True).over(after)})


def fill_gaps(df: DataFrame, row: list[str], index: str, valid: str, value: str, order: str, most: int) -> DataFrame:
    """Fills gaps of at most ``most`` places from the side of the smaller ``order`` (ties: the nearer, then the left).

    Adds filled and is_hole. Values ride along with the window, so there is no self-join.
    """
    w = Window.partitionBy(*row).orderBy(index)
    item = F.when(F.col(valid), F.struct(F.col(index).alias("i"), F.col(value).alias("v"), F.col(order).alias("o")))
    left, right = F.last(item, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(item, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumns({"__l": left, "__r": right})
    l, r, i = F.col("__l"), F.col("__r"), F.col(index)
    use_left = r.isNull() | (l.isNotNull() & ((l["o"] < r["o"]) | ((l["o"] == r["o"]) & (i - l["i"] <= r["i"] - i))))
    # beyond the last valid place on a side the gap reaches to the row's end
    first, last = F.min(index).over(Window.partitionBy(*row)), F.max(index).over(Window.partitionBy(*row))
    gap = F.coalesce(r["i"], last + 1) - F.coalesce(l["i"], first - 1) - 1
    fillable = ~F.col(valid) & (l.isNotNull() | r.isNotNull()) & (gap <= most)
    filled = F.when(F.col(valid), F.col(value)).when(fillable, F.when(use_left, l["v"]).otherwise(r["v"]))
    return df.withColumns({"filled": filled, "is_hole": ~F.col(valid) & ~fillable}).drop("__l", "__r")


def align_windows(frames: DataFrame, clip: str, index: str, value: str, size: int, keep: int) -> DataFrame:
    """Windows of a clip's frames chained by least squares: each is scaled and shifted so that its first
    ``keep`` frames fit the last ``keep`` of what came before, and values of later windows that come out below 0 are 0. Returns clip, index, window_id, aligned.

    Every window depends on the one before, so one clip is one group.
    """

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", kind="stable")
        v, out, windows, start = pdf["v"].to_numpy(float), np.empty(len(pdf)), np.empty(len(pdf), np.int32), 0
        number = 0
        while True:
            end = min(start + size, len(v))
            scale, shift, fresh = 1.0, 0.0, start
            if start:
                x, y, fresh = v[start : start + keep], out[start : start + keep], start + keep
                spread = ((x - x.mean()) ** 2).sum()
                scale = ((x - x.mean()) * (y - y.mean())).sum() / spread if spread > 0 else 1.0
                shift = y.mean() - scale * x.mean()
            out[fresh:end] = np.maximum(0.0, v[fresh:end] * scale + shift) if start else v[fresh:end]
            windows[fresh:end] = number
            if end == len(v):
                return pd.DataFrame({"c": pdf["c"], "i": pdf["i"], "window_id": windows, "aligned": out})
            start, number = start + size - keep, number + 1

    kinds = dict(frames.dtypes)
    plain = frames.select(F.col(clip).alias("c"), F.col(index).alias("i"), F.col(value).cast("double").alias("v"))
    return plain.groupBy("c").applyInPandas(chain, f"c {kinds[clip]}, i {kinds[index]}, window_id int, aligned double").withColumnsRenamed({"c": clip, "i": index})


def ordered_map(df: DataFrame, index: str, work, schema: str, index_kind: str = "long") -> DataFrame:
    """``work(pandas frame) -> pandas frame`` over Arrow batches, in parallel; rows keep ``index``, by which results are sorted again. An error ends the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = work(pdf)
            out.insert(0, index, pdf[index].to_numpy())
            yield out

    return df.mapInPandas(run, f"{index} {index_kind}, {schema}").orderBy(index)
