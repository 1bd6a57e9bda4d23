"""The chain of windows: what is final when, fits, clamps, tails, and the same result on a stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import windows as win

SHAPE = win.Shape()
SCHEMA = "clip_id long, window int, position int, n long, values array<double>"


def predicted(n, seed=0, pixels=3, drift=True):
    """A clip's true maps, and the windows that a model with another scale in each would give, padded at the end."""
    truth = np.random.default_rng(seed).uniform(1, 9, (n, pixels))
    out = []
    for w in range(SHAPE.windows(n)):
        at = [w * SHAPE.step + p for p in range(SHAPE.size)]
        if w:
            at[:2] = [0, (w - 1) * SHAPE.step + SHAPE.second]
        scale, shift = (1 + 0.25 * (w % 3), 0.5 * (w % 2)) if drift else (1, 0)
        out.append(truth[np.minimum(at, n - 1)] * scale + shift)
    return truth, out


def rows(clip, n, windows):
    return [(clip, w, p, n, m.tolist()) for w, maps in enumerate(windows) for p, m in enumerate(maps)]


def test_emission_and_state():
    _, maps = predicted(80)
    chain, seen = win.Chain(SHAPE), []
    for w, window in enumerate(maps):
        got = [f for p, m in enumerate(window) for f in chain.feed(w, p, m, 80)]
        seen.append([i for i, _ in got])
        assert chain.pending.shape[0] == 8 and chain.references.shape[0] == 2 and not chain.waiting
    assert seen == [list(range(24)), list(range(24, 46)), list(range(46, 68)), list(range(68, 80))]


@pytest.mark.parametrize("n", [1, 23, 24, 25, 32, 46, 47, 100])
def test_every_frame_once_and_on_the_first_scale(spark, n):
    truth, maps = predicted(n, seed=n)
    got = {r.frame_idx: r["values"] for r in win.chained(spark.createDataFrame(rows(1, n, maps), SCHEMA)).collect()}
    assert sorted(got) == list(range(n))
    assert np.allclose([got[i] for i in range(n)], truth, atol=1e-9)  # drifts of scale and shift are undone exactly


def test_fit_clamp_and_blend():
    shape = win.Shape(size=6, overlap=3, second=2, weights=(0.25,))
    first = np.array([[1.0], [2.0], [3.0], [4.0], [5.0], [6.0]])
    chain = win.Chain(shape)
    assert [i for p, m in enumerate(first) for i, _ in chain.feed(0, p, m, 99)] == [0, 1, 2, 3, 4]
    second = np.array([[2.0], [6.0], [10.0], [-5.0], [8.0], [4.0]])  # references 1 and 3: half of 2 and 6
    got = {i: v[0] for p, m in enumerate(second) for i, v in chain.feed(1, p, m, 99)}
    assert got == {5: 6.0 * 0.75 + 5.0 * 0.25, 6: 0.0, 7: 4.0}
    assert chain.pending.tolist() == [[2.0]] and chain.references.tolist() == [[1.0], [5.0]]
    assert win.fit(np.ones(3), np.array([1.0, 2.0, 3.0])) == (1.0, 1.0)


def test_state_survives_its_row():
    _, maps = predicted(60)
    whole, cut = win.Chain(SHAPE), win.Chain(SHAPE)
    for w, p, m in ((w, p, m) for w, window in enumerate(maps) for p, m in enumerate(window)):
        a = [(i, v.tolist()) for i, v in whole.feed(w, p, m, 60)]
        cut = win.Chain.of(SHAPE, cut.row())
        assert [(i, v.tolist()) for i, v in cut.feed(w, p, m, 60)] == a


def test_a_stream_in_any_order_gives_the_same(spark, tmp_path):
    every = [r for clip, n in ((1, 70), (2, 30), (3, 1)) for r in rows(clip, n, predicted(n, seed=clip)[1])]
    order = np.random.default_rng(4).permutation(len(every))
    for i, part in enumerate(np.array_split(order, 5)):
        spark.createDataFrame([every[j] for j in part] + [every[0]], SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    q = win.chained(stream).writeStream.format("memory").queryName("chained_windows").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((r.clip_id, r.frame_idx, np.round(r["values"], 9).tolist()) for r in df.collect())
    assert key(spark.table("chained_windows")) == key(win.chained(spark.createDataFrame(every, SCHEMA)))


def test_missing_maps_hold_a_clip_back(spark):
    maps = [r for r in rows(1, 60, predicted(60)[1]) if (r[1], r[2]) != (1, 5)]
    assert win.chained(spark.createDataFrame(maps, SCHEMA)).count() == 24
    assert win.chained(spark.createDataFrame([], SCHEMA)).count() == 0
    assert win.chained(spark.createDataFrame([], SCHEMA)).agg(F.count("*")).first()[0] == 0
