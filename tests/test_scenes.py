"""Scene samples by index, and merging by tails against merging by pools."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions.depth import inverse_metric
from fathomline.operators import scenes
from fathomline.operators.sequences import merge_segments


def even(n, k):
    return np.arange(n) if n <= k else np.unique(np.rint(np.linspace(0, n - 1, k)).astype(int))


def test_samples_are_two_even_levels(spark):
    rng = np.random.default_rng(1)
    maps = [(1, f // 9, f, 7, 5, rng.normal(size=35).round(3).tolist()) for f in range(20)] + [(2, 0, 4, 1, 1, [float("nan")])]
    df = spark.createDataFrame(maps, "clip int, scene int, f int, h int, w int, `values` array<double>")
    got = {(r.clip, r.scene): r for r in scenes.scene_samples(df, "clip", "scene", "f", "values", "h", "w", frames=4, places=3).collect()}
    for s in range(3):
        own = [m for m in maps if m[0] == 1 and m[1] == s]
        want = sorted(np.concatenate([np.array(own[i][5]).reshape(7, 5)[np.ix_(even(7, 3), even(5, 3))].ravel() for i in even(len(own), 4)]))
        assert got[1, s].sample == want and got[1, s].frames == min(len(own), 4)
    assert got[2, 0].sample == [] and got[2, 0].frames == 1


def test_scores_say_what_is_valid(spark):
    df = spark.createDataFrame([(1, 0, 0, 1, 4, [2.0, -1.0, 0.0, 4.0])], "clip int, scene int, f int, h int, w int, `values` array<double>")
    assert scenes.scene_samples(df, "clip", "scene", "f", "values", "h", "w", score=inverse_metric).first().sample == [0.25, 0.5]


@pytest.mark.parametrize("seed", range(4))
def test_tails_tell_the_percentiles_of_unions(seed):
    rng = np.random.default_rng(seed)
    parts = [np.sort(rng.normal(size=rng.integers(0, 300))) for _ in range(9)]
    most = sum(map(len, parts))
    tails, every = scenes.Tails.of(parts[0], most), parts[0]
    for p in parts[1:]:
        tails, every = tails.plus(scenes.Tails.of(p, most), most), np.concatenate([every, p])
        assert tails.n == len(every) and np.allclose(tails.bounds(), np.percentile(every, [2, 98]) if len(every) else 0)
    assert len(tails.low) <= 0.02 * most + 2


def test_merging_equals_pools(spark):
    rng = np.random.default_rng(6)
    rows = [(c, s, v) for c in range(4) for s in range(12) for v in (rng.normal([0, 0, 0.05, 3, 3.1, 9][rng.integers(6)], 1, rng.integers(0, 60))).tolist() or [None]]
    plain = spark.createDataFrame(rows, "clip int, scene int, v double")
    sampled = plain.groupBy("clip", "scene").agg(F.array_sort(F.collect_list("v")).alias("sample"))
    key = lambda df: {(r.clip, r.scene): (r.merged_id, round(r.low, 9), round(r.high, 9), r.n) for r in df.collect()}
    got = key(scenes.merge_scenes(sampled, "clip", "scene"))
    assert got == key(merge_segments(plain, "clip", "scene", "v")) and len({(c, m[0]) for (c, _), m in got.items()}) < len(got)
    assert scenes.merge_scenes(sampled.filter("false"), "clip", "scene").count() == 0
