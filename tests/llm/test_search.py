"""Nearest neighbours and ranked search against brute force, and odd tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import multi_index as mi, wavelet_rank as wr
from fathomline.llm.registry import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
VECTORS = "id long, v array<float>"


# --- nearest neighbours -------------------------------------------------------------------------------------------------


def nearest(rows, k, asks):
    """What exact search gives: {query: [(id, distance)]} by distance and id."""
    rows = sorted({(i, tuple(v)) for i, v in rows})
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, v in rows:
        if asks(i) and i not in out:
            far = np.sqrt(((x - np.array(v, float)) ** 2).sum(1))
            out[i] = sorted((d, j) for d, (j, _) in zip(far.tolist(), rows) if j != i)[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_walk_gives_every_pair_in_order():
    rng = np.random.default_rng(1)
    book = mi.Codebook(rng.normal(size=(7, 3)), rng.normal(size=(5, 2)), 5, 1.0)
    q = rng.normal(size=5)
    cells = list(book.walk(q))
    sums = (mi.squares(q[None, :3], book.first)[0][:, None] + mi.squares(q[None, 3:], book.second)[0]).ravel()
    assert sorted(cells) == list(range(35)) and np.all(np.diff(sums[cells]) >= -1e-12)


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(2)
    rows = [(i, np.float32(rng.normal(size=9)).tolist()) for i in range(150)]
    got = found(mi.search(spark, spark.createDataFrame(rows, VECTORS), F.col("id") % 10 == 0, 10, "id", "v"))
    want = nearest(rows, 10, lambda i: i % 10 == 0)
    assert {q: [i for _, i in r] for q, r in got.items()} == {q: [i for _, i in r] for q, r in want.items()}
    assert all(np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]], rtol=0, atol=1e-14) for q in want)


def test_recall_on_clustered_and_on_random_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32)) * 4
    for x in (centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 32)), rng.normal(size=(6000, 32))):
        rows = [(i, np.float32(v).tolist()) for i, v in enumerate(x)]
        got = found(mi.search(spark, spark.createDataFrame(rows, VECTORS), F.col("id") % 100 == 0, 10, "id", "v"))
        want = nearest(rows, 10, lambda i: i % 100 == 0)
        assert got.keys() == want.keys()
        assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want]) >= 0.93


def test_clusters_need_few_cells():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 16))[rng.integers(0, 30, 4000)] * 9 + rng.normal(size=(4000, 16))
    a, b = mi.halves(x)
    assert mi._share(mi.Codebook(mi.k_means(a, 31, 1), mi.k_means(b, 31, 2), 16, 1.0), x, 10) < 0.2


def test_a_third_of_one_vector_and_ties(spark):
    rng = np.random.default_rng(5)
    same = np.float32(rng.normal(size=8)).tolist()
    rows = [(i, same if i % 3 == 0 else np.float32(rng.normal(size=8)).tolist()) for i in range(3000)]
    got = found(mi.search(spark, spark.createDataFrame(rows, VECTORS), F.col("id") % 100 == 0, 10, "id", "v"))
    for q in (0, 300, 2700):
        assert got[q] == [(0.0, i) for i in range(0, 36, 3) if i != q][:10]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0]), (9, [-0.0, 2.0]), (200, [nan, 1.0]), (None, [1.0, 0.1]), (300, [1.0, 0.0])]
    got = found(mi.search(spark, spark.createDataFrame(rows, VECTORS), F.col("id") % 100 == 0, 10, "id", "v"))
    assert {q: [i for _, i in r] for q, r in got.items()} == {100: [300, 1, 9], 300: [100, 1, 9]}
    assert mi.search(spark, spark.createDataFrame([], VECTORS), F.col("id") % 100 == 0, 10, "id", "v").count() == 0
    clash = spark.createDataFrame([(100, [1.0, 0.0], 1, "x"), (1, [1.0, 1.0], 2, "y")], "id long, v array<float>, tile int, cells string")
    assert found(mi.search(spark, clash, F.col("id") == 100, 10, "id", "v")) == {100: [(1.0, 1)]}
    one = spark.createDataFrame([(100, [2.0]), (1, [5.0])], VECTORS)
    assert found(mi.search(spark, one, F.col("id") == 100, 10, "id", "v")) == {100: [(3.0, 1)]}


def test_several_tiles_and_a_cell_over_many(spark, monkeypatch):
    monkeypatch.setattr(mi, "TILE_MOST", 64)
    monkeypatch.setattr(mi, "QUERIES_AT_ONCE", 3)
    monkeypatch.setattr(mi, "ENTRIES_AT_ONCE", 16)
    rng = np.random.default_rng(7)
    rows = [(i, (np.float32(rng.normal(size=6)) * (0.001 if i % 2 else 1) + 1).tolist()) for i in range(1000)]
    book_share = mi._share
    monkeypatch.setattr(mi, "_share", lambda *a: 1.0)
    got = found(mi.search(spark, spark.createDataFrame(rows, VECTORS), F.col("id") % 50 == 0, 10, "id", "v"))
    want = nearest(rows, 10, lambda i: i % 50 == 0)
    assert {q: [i for _, i in r] for q, r in got.items()} == {q: [i for _, i in r] for q, r in want.items()} and book_share


def test_query_reaches_its_recall(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got, want = found(QUERIES["op11_nearest_neighbours"](spark, "/root/testdata/sf0.01")), nearest(rows, 10, lambda i: i % 100 == 0)
    assert got.keys() == want.keys() and np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want]) >= 0.9


# --- ranked search ------------------------------------------------------------------------------------------------------


def ranked(docs, items, k=10):
    terms = [Counter(t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")) for _, text in docs]
    n_docs, n_terms = sum(map(bool, terms)), sum(sum(c.values()) for c in terms)
    df = Counter(t for c in terms for t in c)
    out = {}
    merged = {}
    for item, text in set(items):
        merged.setdefault(item, Counter()).update(t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or ""))
    for item, query in merged.items():
        scores = []
        for (doc, _), c in zip(docs, terms):
            if c:
                m = 25 + 75 * sum(c.values()) * n_docs // n_terms
                s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in query.items() if t in c)
                if s > 0:
                    scores.append((-s, doc is None, doc or 0, doc))
        out |= {(item, i + 1): (doc, -s) for i, (s, _, _, doc) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])}
    return out


def searched(spark, docs, items, k=10, doc_schema="doc_id long, text string"):
    index = wr.build(spark, spark.createDataFrame(docs, doc_schema))
    got = wr.search(spark, index, spark.createDataFrame(items, "item_id long, text string"), k)
    return {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in got.collect()}


WORDS = [f"w{i}" for i in range(60)] + ["Ünï", "日本", "x1"]


def corpus(n, seed):
    rnd = random.Random(seed)
    return [(i, rnd.choice(" \n-").join(rnd.choice(WORDS[: rnd.randrange(2, len(WORDS))]).upper() if rnd.random() < 0.2 else rnd.choice(WORDS) for _ in range(rnd.randrange(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_trees_find_the_top(seed):
    rng = np.random.default_rng(seed)
    n, terms = int(rng.integers(1, 70)), 9
    have = rng.random((terms, n)) < 0.4
    imp = rng.integers(1, 6, (terms, n))
    term, doc = np.nonzero(have)
    order = np.lexsort((doc, -imp[term, doc], term))
    tree = wr.Tree(wr.tree_bits(doc[order].astype(np.int64), wr.depth(n)), imp[term, doc][order].astype(np.int32), n)
    ends = np.cumsum(have.sum(1))
    weights = rng.integers(0, 4, terms)
    scores = ((have * imp) * weights[:, None]).sum(0)
    want = sorted(((int(s), d) for d, s in enumerate(scores) if s > 0), key=lambda x: (-x[0], x[1]))
    for k in (1, 3, 10, 100):
        assert tree.top(ends - have.sum(1), ends, weights.astype(np.int64), k) == want[:k]


def test_against_brute_force(spark):
    docs = corpus(300, 1) + [(5, "w1 w2"), (5, "w1 w2"), (None, "w1 w1"), (301, None), (302, ""), (303, "  -- ")]
    items = [(1, "w1 w2 w2 Ünï"), (2, "W3, w59!"), (3, None), (4, "nothing here"), (5, ""), (1, "w1 w2 w2 Ünï"), (6, "w7"), (6, "w8 日本"), (None, "w1")]
    assert searched(spark, docs, items) == ranked(docs, items)


def test_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(wr, "SHARD_DOCS", 7)
    monkeypatch.setattr(wr, "BLOCK_TERMS", 4)
    docs, items = corpus(120, 2), [(i, f"w{i} w{i + 1} x1") for i in range(9)]
    assert searched(spark, docs, items, 4) == ranked(docs, items, 4)


def test_one_very_long_text(spark):
    docs = [(1, "w1 w2 " * 400_000 + "w3"), (2, "w3 w3"), (3, "x" * 3_000_000 + " w1")]
    items = [(1, "w1 w3"), (2, "w2")]
    assert searched(spark, docs, items) == ranked(docs, items)


def test_pieces_hold_every_word_once():
    text = ("ab cd-" * 300_000 + "z" * 1_200_000 + " end").encode()
    data, offsets = np.frombuffer(b"first doc" + text, np.uint8), np.array([0, 9, 9, 9 + len(text)])
    got = Counter()
    for first, piece, offs in wr._pieces(data, offsets):
        row, words = wr.words_of(piece, offs)
        got.update(zip((row + first).tolist(), words.to_pylist()))
    assert got == Counter({(0, "first"): 1, (0, "doc"): 1, (2, "ab"): 300_000, (2, "cd"): 300_000, (2, "z" * 1_200_000): 1, (2, "end"): 1})


def test_empty_tables_and_extra_columns(spark):
    assert searched(spark, [], [(1, "w1")]) == {} and searched(spark, corpus(5, 3), []) == {}
    docs = corpus(20, 4)
    wide = [(i, t, "x", [1], 7) for i, t in docs]
    assert searched(spark, wide, [(1, "w1 w2")], doc_schema="doc_id long, text string, term string, ids array<int>, score int") == ranked(docs, [(1, "w1 w2")])


def test_a_task_holds_one_shard_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(wr, "SHARD_POSTINGS", 100)
    docs, items = [(i, " ".join([*WORDS[i % 7 :], *["w1 w2"] * 30_000])) for i in range(30)], [(1, "w1 w2 x1"), (2, "w7")]
    shards = wr.build(spark, spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).shards
    assert shards.count() > 3 and shards.agg(F.max(F.size("ids"))).first()[0] < 10
    assert shards.groupBy(F.input_file_name()).count().filter("count > 1").isEmpty()
    assert searched(spark, docs, items) == ranked(docs, items)
