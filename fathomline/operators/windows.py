"""Overlapping windows of predicted maps chained with carried state, the same on a table and on a stream.

A model predicts a clip in windows of ``size`` maps. The first window's first ``size - blend`` maps are final; its last ``blend`` maps are
pending. Each later window begins with maps of two earlier frames, the references: a scale and a shift that
fit them to what those frames got take the whole window to the clip's scale, values below 0 become 0. Its next ``blend`` maps are
blended with the pending ones, then come final maps, and its last ``blend`` maps are pending. So a clip needs as state ``blend`` pending maps, two
references and a number, and what has come of a window that isn't whole yet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType


@dataclass(frozen=True)
class Shape:
    """Maps of a window, of its overlap with the one before (references and blended maps), and where the second reference comes from.

    ``weights``: what a new map counts for at each place of the blend; they aren't published, so they are a parameter.
    """

    size: int = 32
    overlap: int = 10
    second: int = 12
    weights: tuple[float, ...] = tuple((i + 1) / 9 for i in range(8))

    @property
    def blend(self) -> int:
        return len(self.weights)

    @property
    def step(self) -> int:
        return self.size - self.overlap

    def windows(self, n: int) -> int:
        """Windows of a clip of n frames."""
        return -(-n // self.step)


@dataclass
class Chain:
    """The state of one clip."""

    shape: Shape
    done: int = 0
    references: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    pending: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    waiting: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def feed(self, window: int, position: int, values: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
        """Takes one map and gives the frames that it makes final. Maps of finished windows, as after a retry, give nothing."""
        if window >= self.done:
            self.waiting[window, position] = values
        while all((self.done, p) in self.waiting for p in range(self.shape.size)):
            current = np.stack([self.waiting.pop((self.done, p)) for p in range(self.shape.size)])
            start, final = self._finish(current)
            self.done += 1
            yield from ((start + i, v) for i, v in enumerate(final) if start + i < n)

    def _finish(self, current: np.ndarray) -> tuple[int, np.ndarray]:
        s = self.shape
        if not self.done:
            self.references, self.pending = current[[0, s.second]].copy(), current[s.size - s.blend :].copy()
            return 0, current[: s.size - s.blend]
        two = s.overlap - s.blend
        scale, shift = fit(current[:two], self.references)
        aligned = np.maximum(0.0, current[two:] * scale + shift)
        weights = np.array(s.weights)[:, None]
        blended = self.pending * (1 - weights) + aligned[: s.blend] * weights
        self.references = np.stack([self.references[0], aligned[s.second - two]])
        self.pending = aligned[s.step :].copy()
        return self.done * s.step + two, np.concatenate([blended, aligned[s.blend : s.step]])

    def row(self) -> tuple:
        keys = sorted(self.waiting)
        return self.done, self.references.ravel().tolist(), self.pending.ravel().tolist(), [k[0] for k in keys], [k[1] for k in keys], [self.waiting[k].tolist() for k in keys]

    @staticmethod
    def of(shape: Shape, row: tuple | None) -> "Chain":
        if row is None:
            return Chain(shape)
        done, references, pending, windows, positions, maps = row
        square = lambda v, k: np.array(v, float).reshape(k, -1) if done else np.zeros((0, 0))
        return Chain(shape, done, square(references, 2), square(pending, shape.blend), {(w, p): np.array(m, float) for w, p, m in zip(windows, positions, maps)})


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the least squares from x to y; of an even x the scale is 1."""
    spread = ((x - x.mean()) ** 2).sum()
    scale = ((x - x.mean()) * (y - y.mean())).sum() / spread if spread > 0 else 1.0
    return float(scale), float(y.mean() - scale * x.mean())


STATE = StructType(
    [
        StructField("done", IntegerType()),
        StructField("references", ArrayType(DoubleType())),
        StructField("pending", ArrayType(DoubleType())),
        StructField("windows", ArrayType(IntegerType())),
        StructField("positions", ArrayType(IntegerType())),
        StructField("maps", ArrayType(ArrayType(DoubleType()))),
    ]
)


def chained(maps: DataFrame, shape: Shape = Shape(), clip: str = "clip_id") -> DataFrame:
    """clip, frame_idx and the final map of each frame.

    ``maps``: clip, window (from 0), position (0 to size - 1), n (frames of the clip), values. A table is read in a stream sorted by clip, window and
    position, of which a task holds one window and the state; on a stream the state is kept by Spark between batches. Rows of a window may come in any
    order and batch; a window that never becomes whole holds back the rest of its clip. Repeated maps count once.
    """
    kind = maps.schema[clip].dataType
    out = StructType([StructField("c", kind), StructField("frame_idx", LongType()), StructField("values", ArrayType(DoubleType()))])
    plain = maps.select(F.col(clip).alias("c"), F.col("window").cast("int"), F.col("position").cast("int"), F.col("n").cast("long"), F.col("values").cast("array<double>"))

    def frames(chain: Chain, pdf: pd.DataFrame) -> Iterator[tuple[int, list[float]]]:
        for w, p, n, v in zip(pdf["window"], pdf["position"], pdf["n"], pdf["values"]):
            for i, values in chain.feed(int(w), int(p), np.asarray(v, float), int(n)):
                yield i, values.tolist()

    def as_frame(clip, found) -> pd.DataFrame:
        return pd.DataFrame([(clip, i, v) for i, v in found], columns=["c", "frame_idx", "values"])

    def keep(key, parts, state):
        chain = Chain.of(shape, state.get if state.exists else None)
        for pdf in parts:
            yield as_frame(key[0], frames(chain, pdf))
        state.update(chain.row())

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, now = None, None
        for pdf in parts:
            for c, own in pdf.groupby("c", sort=False, dropna=False):
                if chain is None or c != now:
                    chain, now = Chain(shape), c
                yield as_frame(c, frames(chain, own))

    if maps.isStreaming:
        found = plain.groupBy("c").applyInPandasWithState(keep, out, STATE, "append", "NoTimeout")
    else:
        found = plain.repartition("c").sortWithinPartitions("c", "window", "position").mapInPandas(read, out)
    return found.withColumnRenamed("c", clip)
