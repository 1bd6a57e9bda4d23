"""Connected components of an edge table, with lineage cut by written tables.

Each partition first replaces its edges by a spanning forest (as stars), so that a group of
copies crosses the network as one edge a member and task. Then large-star and small-star
steps alternate: every node hooks its larger, then its smaller neighbours on to its smallest
neighbour. Only minima are grouped by key (with map-side combination); hot centres are joined, where skewed
partitions can be split. Steps end when the edges no longer change.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fathomline.scratch import Scratch

#: Edges that a task holds before it turns them into a forest.
HELD_EDGES = 2_000_000
_SCHEMA = "u long, v long"


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its component) of the graph of these edges."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    parent = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        a, b = parent[a], parent[b]
        open_ = a != b
        a, b = a[open_], b[open_]
    moved = parent != np.arange(len(nodes))
    return nodes[moved], nodes[parent[moved]]


def _forests(batches):
    held_u, held_v, size = [], [], 0

    def flush():
        u, v = forest(np.concatenate(held_u), np.concatenate(held_v))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        held_u.append(np.asarray(batch.column(0)))
        held_v.append(np.asarray(batch.column(1)))
        size += batch.num_rows
        if size >= HELD_EDGES:
            yield flush()
            held_u, held_v, size = [], [], 0
    if size:
        yield flush()


def components(spark: SparkSession, edges: DataFrame, most_steps: int = 60) -> DataFrame:
    """(node, component) of every node with an edge to another; component is the smallest node that it reaches.

    ``edges`` has two columns of longs, in any direction; repeated edges and loops are ignored.
    """
    store = Scratch(spark, "components")
    plain = edges.toDF("u", "v").filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now = store.save(plain.mapInArrow(_forests, _SCHEMA).distinct(), "s0")
    state = None
    for step in range(1, most_steps + 1):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = store.save(large, f"l{step}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = store.save(small.filter("u <> v").distinct(), f"s{step}")
        store.drop(f"s{step - 1}", f"l{step}")
        fresh = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"), F.count_if(F.col("u") < F.col("v")).alias("bad")).first()
        if state == fresh:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = fresh
    raise RuntimeError(f"components did not settle in {most_steps} steps")
