"""The Jaccard join and substring dedup against brute force, and on odd tables."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import graph, ngram_join as nj, substring_dedup as sd

SCHEMA = "doc_id long, text string, n_shingles string, component_id string"


def words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def corpus():
    """Near copies of many sizes, a hot passage, exact copies, short, empty and null texts."""
    rng = random.Random(4)
    texts, passage = [], words(rng, 60)
    for size in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 20, 24, 40, 85, 120, 300, 700):
        base = words(rng, size)
        texts.append(" ".join(base))
        for cut in (0.0, 0.02, 0.05, 0.1):
            copy = list(base)
            for _ in range(int(size * cut) + (cut > 0)):
                copy[rng.randrange(size)] = f"x{rng.randrange(999)}"
            texts.append(" ".join(copy))
        texts.append(" ".join(base[: max(1, size * 4 // 5)]))
        texts.append(" ".join(base + words(rng, max(1, size // 4))))
    texts += [" ".join(passage + words(rng, rng.randrange(5, 60))) for _ in range(40)]
    texts += [" ".join(passage)] * 6 + ["", "   ", None, "A\tB c", "a b\nC"]
    return [(i * 3 + 1, t, "x", None) for i, t in enumerate(texts)]


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {(i, len(s), root(i)) for i, s in sets.items()}


def joined(df):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()}


def test_join_equals_brute_force(spark):
    rows = corpus()
    assert joined(nj.join(spark, spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_join_with_hot_signatures_and_small_blocks(spark, monkeypatch):
    """Lowered limits make every signature hot, and deal lists and pairs out in many blocks."""
    for name, value in {"LOCAL_LEAST": 1, "HOT_LEAST": 1, "HELD": 500, "LIST_MOST": 7, "LEADERS": 1, "BLOCK_DOCS": 3, "READ_ROWS": 2}.items():
        monkeypatch.setattr(nj, name, value)
    rows = corpus()
    assert joined(nj.join(spark, spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def near_copies(n, seed):
    """Copies of one text whose edits bring many pairs just below and just above the threshold."""
    rng = random.Random(seed)
    base, rows = words(rng, 120), []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randrange(1, 6)):
            copy[rng.randrange(len(copy))] = f"y{rng.randrange(10**6)}"
        rows.append((i * 7 % 1009, " ".join(copy[rng.randrange(0, 12) :]), "x", None))
    return rows


@pytest.mark.parametrize("parts", [1, 6])
def test_join_of_a_large_group(spark, monkeypatch, parts):
    """A hot group, most of whose pairs aren't similar, and documents that share two thirds of their words."""
    monkeypatch.setattr(nj, "LIST_MOST", 100)
    rng = random.Random(12)
    passage = words(rng, 100)
    rows = near_copies(300, 5) + [(2000 + i, " ".join(passage + words(rng, rng.randrange(20, 55))), "x", None) for i in range(200)]
    assert joined(nj.join(spark, spark.createDataFrame(rows, SCHEMA).repartition(parts))) == brute(rows)


def similar_sets(rng):
    n = int(rng.integers(3, 200))
    a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() * 0.2], rng.integers(0, 2**64, int(rng.integers(0, 1 + n // 6)), dtype=np.uint64)]))
    inter = len(np.intersect1d(a, b))
    return a, b, len(b) > 0 and 100 * inter >= 75 * (len(a) + len(b) - inter)


def test_signatures_meet_for_every_similar_pair():
    """Similar sets share a signature, and each is within the other's reach in the first that they share."""
    rng = np.random.default_rng(1)
    for hot in (0, 40):
        for _ in range(300):
            a, b, similar = similar_sets(rng)
            if not similar:
                continue
            known = np.unique(nj.signatures(a)[:hot])
            scheme = nj.Scheme(hot=known, hot_count=np.full(len(known), 50))
            doc, key, place = nj.allocate(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), scheme)
            one, two = ({k: p for k, p in zip(key[doc == d].tolist(), place[doc == d].tolist())} for d in (0, 1))
            first = min(set(one) & set(two))
            assert scheme.reach(np.int64(len(a)), one[first]) >= len(b) and scheme.reach(np.int64(len(b)), two[first]) >= len(a)


def test_lists_keep_all_that_may_be_similar():
    """Pairs within each other's reach are links, or in a list that is handed on, and are found there if their components differ."""
    rng, scheme = np.random.default_rng(3), nj.Scheme()
    for _ in range(300):
        m = int(rng.integers(1, 50))
        keys, n, ids = rng.integers(0, 4, m).astype(np.uint64), rng.integers(20, 80, m), rng.permutation(1000)[:m]
        place = (n * rng.random(m) * 0.4).astype(np.int64)
        pairs, (key, doc, size, reach) = nj.links_of(keys, ids, n, place, scheme)
        found = set(map(tuple, pairs.tolist()))
        label = rng.integers(0, 5, 1000)
        for k in np.unique(key):
            at = key == k
            maps = [np.zeros(int(rng.integers(1, 3)), np.uint64)] * int(at.sum())  # which rule nothing out
            found |= set(map(tuple, nj.pairs_across(doc[at], size[at], reach[at], label[doc[at]], maps, scheme).tolist()))
        far = scheme.reach(n, place)
        want = {(int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for i in range(m) for j in range(i) if keys[i] == keys[j] and n[i] <= far[j] and n[j] <= far[i]}
        assert set(map(tuple, pairs.tolist())) <= want and {p for p in want if label[p[0]] != label[p[1]]} <= found <= want


def test_nul_is_a_character(spark):
    rows = [(1, "a\x00b c d e f", "x", None), (2, "a\x01b c d e f", "x", None), (3, "a\x00b c d e f", "x", None)]
    assert joined(nj.join(spark, spark.createDataFrame(rows, SCHEMA))) == {(1, 1, 1), (2, 1, 2), (3, 1, 1)}


def test_join_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nj.join(spark, empty).count() == 0
    rows = [(1, "a b c d e f g", "x", None), (1, "a b c d e f g", "x", None), (None, "a b c d e f g", "x", None), (2, None, None, None), (5, "a b c d e f g", "x", "y")]
    got = sorted(map(tuple, nj.join(spark, spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (None, 3, None), (2, 0, 2), (5, 3, 1)], key=str)
    # an id with two texts is one document, and links the copies of either; a long text is read whole
    long = " ".join(f"z{i}" for i in range(60_000))
    two = [(9, "a b c d e f g", "x", None), (9, "p q r s t u v", "x", None), (3, "a b c d e f g", "x", None), (5, "p q r s t u v", "x", None), (11, long, "x", None), (12, long + " end", "x", None)]
    for parts in (1, 4):
        assert joined(nj.join(spark, spark.createDataFrame(two, SCHEMA).repartition(parts))) == {(9, 3, 3), (3, 3, 3), (5, 3, 3), (11, 59_996, 11), (12, 59_997, 11)}
    kept = nj.keep_one(spark, spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "n_shingles", "component_id"]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 2]


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    got = {r.node: r.component for r in graph.components(spark, spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {x: root(x) for x in parent}
    assert {k: v for k, v in want.items() if k != v or k in got} == got
    assert graph.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_chain_prefers_collinear_runs():
    runs = [(0, 100, 10), (12, 112, 10), (30, 130, 10), (20, 500, 8)]
    best = sd.chains(runs, 8)
    assert best[0] == [(0, 100, 10), (12, 112, 10), (30, 130, 10)] and best[1] == [(20, 500, 8)]
    assert sd.chains([(0, 50, 10), (20, 10, 10)], 8) == [[(0, 50, 10)], [(20, 10, 10)]]  # crossing runs don't chain


def test_alignment():
    a = list("abcdefghijklmnop")
    b = list("xxcdefghZjklmnopq")
    (stretch,) = sd.align(a, b, [(3, 3, 4), (10, 10, 4)])
    assert stretch == (2, 16, 2, 13, 14)
    assert sd.edit_matches(list("abcd"), list("abd")) == (3, 4)
    assert sd.edit_matches([], list("ab")) == (0, 2)


def documents_with_repeats():
    rng = random.Random(8)
    passage = words(rng, 80)
    fuzzy = list(passage)
    for i in (20, 41, 60):
        fuzzy[i] = "changed"
    rows = [(1, words(rng, 30) + passage + words(rng, 30)), (2, words(rng, 200)), (3, words(rng, 10) + passage), (4, fuzzy + words(rng, 40)), (5, passage[:49]), (6, words(rng, 90)), (7, passage[10:65] + words(rng, 200))]
    rows.append((9, rows[5][1]))
    return [(i, " ".join(t)) for i, t in rows], passage


@pytest.mark.parametrize("small", [False, True])
def test_repeats(spark, monkeypatch, small):
    if small:
        for name, value in {"BUCKET_MOST": 1, "PARTNER_DOCS": 1, "READ_ROWS": 1}.items():
            monkeypatch.setattr(sd, name, value)
    rows, passage = documents_with_repeats()
    rows += [(None, rows[0][1]), (20, None), (21, ""), (2, rows[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.start_word, r.end_word, r.partner_id) for r in sd.repeats(spark, df).collect()}
    assert got == {3: (10, 90, 1), 4: (0, 80, 1), 7: (0, 55, 1), 9: (0, 90, 6)}
    assert sd.repeats(spark, df.limit(0)).count() == 0


def test_repeats_of_a_very_common_passage(spark, monkeypatch):
    """Seeds held more often than LOCAL_MOST are anchored inside the task; everything is still found."""
    monkeypatch.setattr(sd, "LOCAL_MOST", 2)
    rng = random.Random(3)
    passage = " ".join(words(rng, 70))
    rows = [(i, " ".join(words(rng, 25)) + " " + passage + " " + " ".join(words(rng, 25))) for i in range(60)]
    got = {r.doc_id: (r.start_word, r.end_word) for r in sd.repeats(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    # The word before the passage is part of it where an earlier document happens to have the same one (document 24 has that of 5).
    before = [t.split()[24] for _, t in rows]
    chance = {i for i in range(60) if before[i] in before[:i]}
    assert chance == {24} and got.pop(24) in ((24, 95), (25, 95))
    assert got == {i: (25, 95) for i in range(1, 60) if i != 24}


def test_removed_passages(spark):
    rows, passage = documents_with_repeats()
    df = spark.createDataFrame([(i, t, "__cut", "en") for i, t in rows] + [(None, "left alone", "a", None), (30, None, None, None)], "doc_id long, text string, __cut string, lang string")
    out = {r.doc_id: r.text for r in sd.remove(spark, df).collect()}
    assert sd.remove(spark, df).columns == df.columns
    texts = dict(rows)
    assert 9 not in out  # nothing is left of a whole copy
    assert out[1] == texts[1] and out[2] == texts[2] and out[30] is None and out[None] == "left alone"
    assert out[3].split() == texts[3].split()[:10] and out[4].split() == texts[4].split()[80:]


@pytest.mark.parametrize("n", [0, 1, 2, 50])
def test_fenwick(n):
    rng = np.random.default_rng(n)
    tree, best = sd.Fenwick(n), [(-1e18, -1)] * n
    for step in range(2 * n):
        at, value = int(rng.integers(0, n)), (float(rng.normal()), step)
        tree.put(at, value)
        best[at] = max(best[at], value)
        until = int(rng.integers(0, n + 1))
        assert tree.most(until) == max(best[:until], default=(-1e18, -1))


def found_in(spark, rows, parts):
    """The passages of ``rows``, whose partitions are filled in their order."""
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string")
    return sorted((r.doc_id, r.start_word, r.end_word, r.partner_id) for r in sd.repeats(spark, df).collect())


@pytest.mark.parametrize("held", [1 << 21, 1])
def test_copies_out_of_order(spark, monkeypatch, held):
    """The smallest copy is seeded, also where larger ones are read, or handed on, before it."""
    monkeypatch.setattr(sd, "HELD", held)
    monkeypatch.setattr(sd, "slices", lambda offsets: ((i, i + 1) for i in range(len(offsets) - 1)))
    rng = random.Random(6)
    old, new = words(rng, 60), words(rng, 60)
    copy = " ".join(old + words(rng, 30) + new)
    rows = [(9, copy), (8, copy), (7, " ".join(words(rng, 20) + new)), (5, copy), (6, copy), (5, copy), (3, " ".join(words(rng, 25) + old))]
    got = found_in(spark, rows, 1)
    assert got == [(5, 0, 60, 3), (6, 0, 150, 5), (7, 20, 80, 5), (8, 0, 150, 5), (9, 0, 150, 5)]


def test_runs_of_one_word(spark):
    """Runs of one word count with their whole length, alone, inside a passage, and against shorter and longer ones."""
    rng = random.Random(7)
    run, left, right, odd = ["-"] * 60, words(rng, 10), words(rng, 10), words(rng, 8)
    texts = {
        1: words(rng, 20) + ["-"] * 20 + words(rng, 20),
        2: words(rng, 30) + run + words(rng, 30),
        3: words(rng, 15) + run + words(rng, 15),
        4: run,
        5: words(rng, 12) + run * 5 + words(rng, 12),
        6: words(rng, 15) + left + ["="] * 30 + right + words(rng, 15),
        7: words(rng, 5) + left + ["="] * 30 + right + words(rng, 5),
        8: words(rng, 15) + ["+"] * 42 + odd + words(rng, 15),
        9: words(rng, 15) + ["+"] * 45 + odd + words(rng, 15),
        10: words(rng, 20) + ["_"] * 60,
        11: words(rng, 20) + ["_"] * 20,
    }
    rows = [(i, " ".join(t)) for i, t in texts.items()]
    for parts in (1, 2, 11):
        got = {(d, s, e) for d, s, e, _ in found_in(spark, rows[::-1], parts)}
        assert got == {(3, 15, 75), (4, 0, 60), (5, 12, 312), (7, 5, 55), (9, 15, 68)}, parts  # 9: the run from its start and from its end, which overlap


def test_a_very_common_passage_twice_in_a_document(spark, monkeypatch):
    """The smallest document of a task that holds a hot passage repeats the earlier document at each of its places."""
    monkeypatch.setattr(sd, "LOCAL_MOST", 2)
    rng = random.Random(9)
    passage = words(rng, 70)
    rows = [(1, words(rng, 25) + passage), (2, words(rng, 200)), (3, words(rng, 200)), (4, words(rng, 200))]
    rows += [(5, words(rng, 20) + passage + words(rng, 40) + passage + words(rng, 40) + passage)]
    rows += [(i, words(rng, 25) + passage + words(rng, 30) + passage) for i in (6, 7, 8)]
    got = {(d, s, e) for d, s, e, _ in found_in(spark, [(i, " ".join(t)) for i, t in rows], 2)}
    assert got == {(5, 20, 90), (5, 130, 200), (5, 240, 310)} | {(i, s, s + 70) for i in (6, 7, 8) for s in (25, 125)}


@pytest.mark.parametrize("edits", [0, 5, 10, 15])
def test_recall_of_edited_passages(spark, edits):
    """Forty passages of 120 words, each in two documents, with so many of a hundred words replaced at random in the second."""
    rng = np.random.default_rng(edits)
    word = lambda: f"w{rng.integers(0, 20_000)}"
    rows = []
    for i in range(40):
        passage = [word() for _ in range(120)]
        other = [word() if rng.random() < edits / 100 else w for w in passage]
        rows += [(i, " ".join([*(word() for _ in range(90)), *passage, *(word() for _ in range(80))])), (100 + i, " ".join([*(word() for _ in range(70)), *other, *(word() for _ in range(60))]))]
    got = {r.doc_id for r in sd.repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got & {100 + i for i in range(40)}) >= {0: 40, 5: 40, 10: 38, 15: 32}[edits] and not got & set(range(40))


def test_chains_of_many_runs_that_follow_no_other():
    start = time.time()
    assert len(sd.chains([(20 * i, 0, 10) for i in range(20_000)], 8)) == 20_000
    one = sd.chains([(12 * i, 12 * i, 10) for i in range(20_000)], 8)
    assert len(one) == 1 and len(one[0]) == 20_000 and time.time() - start < 5
    assert sd.chains([(0, 0, 10), (20, 20, 10), (45, 40, 10), (20, 100, 8)], 8) == [[(0, 0, 10), (20, 20, 10), (45, 40, 10)], [(20, 100, 8)]]


def test_a_line_repeated_all_over_in_two_documents(spark):
    line = " ".join(f"l{i}" for i in range(12))
    rows = [(1, " ".join([line] * 3200)), (2, " ".join([line] * 3100)), (3, "a b c")]
    start = time.time()
    got = [r for r in sd.repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id == 2]
    assert got and time.time() - start < 60
