"""Decontamination, fingerprints, language ID, licences, quality: against brute force, held-out accuracy, and on odd tables."""

import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from fathomline.llm import decontaminate as dc, fingerprint as fp, language_id as li, licenses as lic, quality as q, textkit as tk
from fathomline.llm.registry import ORACLE_SQL, QUERIES
from tests.conftest import SF, as_rows

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum_words(text):
    return ALNUM.findall((text or "").translate(LOWER))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n.,1ü日\x0b\x00\x01\x7f", max_size=40)), max_size=8))
def test_words_are_the_patterns(texts):
    data, offsets = tk.text_bytes(pa.array(texts, pa.string()))
    for table, pattern in ((tk.ALNUM_WORDS, ALNUM), (tk.SPACE_WORDS, re.compile(r"[^\x20\x09-\x0D]+"))):
        words = tk.Words(data, offsets, table)
        seen = {}
        for i, t in enumerate(texts):
            want = pattern.findall((t or "").translate(LOWER))
            a, b = words.first[i], words.first[i + 1]
            assert b - a == len(want)
            for h, w in zip(words.hash[a:b].tolist(), want):
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("name", sorted(n for n in ORACLE_SQL if not n.startswith("op1_")))
def test_query_equals_its_sql(spark, duck, name):
    assert as_rows(QUERIES[name](spark, SF).toPandas()) == as_rows(duck.execute(ORACLE_SQL[name]).df())


def test_windows_and_blocks(spark):
    item = [(1, "One two three four five six seven eight nine ten eleven"), (2, "short item"), (3, None), (None, "x1 y2 z3"), (1, "One two three four five six seven eight nine ten eleven")]
    docs = [(1, "zero one TWO three, four five six seven eight nine ten end"), (2, "a short-item here"), (3, None), (4, ""), (5, "x1 y2 z3 x1 y2 z3"), (None, "short item"), (1, "nothing")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    b = spark.createDataFrame(item, "item_id long, text string")
    want = [(None, 2, 2, ["2"]), (1, 1, 0, []), (1, 12, 10, ["1"]), (2, 4, 2, ["2"]), (3, 0, 0, []), (4, 0, 0, []), (5, 6, 6, [""])]
    for block in (dc.BLOCK_WINDOWS, 1):  # one broadcast, or a block for each item
        got = dc.scan(d, b, block_windows=block).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == sorted(want, key=str)
    assert dc.scan(d, b.limit(0)).filter("n_hit > 0").count() == 0 and dc.scan(d.limit(0), b).count() == 0
    assert sorted(r.doc_id for r in dc.remove(d, b).collect()) == [1, 3, 4]
    spans = {r.doc_id: r.text for r in dc.remove(d.filter("doc_id = 2 OR doc_id = 5"), b, spans_only=True).collect()}
    assert spans == {2: "a  here", 5: ""}


def test_clashing_columns(spark):
    d = spark.createDataFrame([(1, "short item", 3, "k")], "doc_id long, text string, n_hit int, __made string")
    b = spark.createDataFrame([(1, "short item")], "item_id long, text string")
    assert dc.remove(d, b.limit(0)).collect()[0].asDict() == {"doc_id": 1, "text": "short item", "n_hit": 3, "__made": "k"}
    assert dc.remove(d, b).count() == 0


def test_equal_parts_have_equal_phrases():
    rng = np.random.default_rng(0)
    body = "".join(rng.choice(list("abcdefgh  "), 3000))
    for level in (1, 2, 3):
        names = []
        for text in (body, "qqq zzz" + body, body[1:]):
            x, rows = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64), np.zeros(len(text), np.int64)
            for _ in range(level):
                x, rows = fp.parse_level(x, rows)
            names.append(x.tolist())
        for other in names[1:]:
            assert len(set(names[0]) & set(other)) >= len(set(names[0])) - 6


def test_fingerprint_cases():
    texts = ["", "aaaaaaa", "ab", "The quick brown fox " * 30, "x" * 5000, "\U0001f600é日本"]
    one = fp.Fingerprints(texts * 2).texts()
    assert one[:6] == one[6:] and [fp.Fingerprints([t]).texts()[0] for t in texts] == one[:6]
    assert fp.likeness(one[3], one[3]) == 1.0 and fp.likeness(one[0], one[0]) == 1.0 and fp.likeness(one[0], one[3]) == 0.0


def test_edited_neighbours(spark):
    rng = np.random.default_rng(5)
    body = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(n))
    rows = [(i * 7, body(int(n))) for i, n in enumerate(rng.integers(1, 300, 40))] + [(500, None), (501, ""), (7, body(20)), (None, body(30))]
    got = fp.with_edited(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        e = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    long = [r for r in got if r.n_chars > 300]
    assert all(0.4 < r.near_edited < 0.95 and r.near_next < 0.2 for r in long)
    assert fp.with_edited(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
    (alone,) = fp.with_edited(spark, spark.createDataFrame([(3, "abcdef")], "doc_id long, text string")).collect()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and alone.near_next == 1.0


def held_out_share(pdf, k, left):
    return pdf.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % k == left)


def test_language_id(spark):
    got = QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    assert (got.held_out == held_out_share(got, 4, 2)).all() and got.score.between(0, 1).all()
    held = got[got.held_out].merge(docs, on="doc_id")
    assert (held.lang_pred == held.lang).mean() > 0.97


def test_language_id_odd_tables(spark):
    rows = [(i, t * 20, g) for i, (t, g) in enumerate([("the cat sat on that mat ", "en"), ("der hund und die katze ", "de")] * 12)]
    rows += [(100, None, "en"), (101, "123 ... !!", "de"), (102, "", None), (103, "the mat and that cat", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.predict(df, li.train(df)).collect()}
    assert [got[i] for i in (100, 101, 102)] == [("und", 0.0)] * 3 and got[103][0] == "en"
    nothing = df.filter("doc_id = 100")
    assert li.train(nothing) is None and li.predict(nothing, None).first()["lang_pred"] == "und"
    assert sorted(r.doc_id for r in li.keep_named(df, li.train(df)).filter("doc_id >= 100").collect()) == [103]


def test_license_scan(spark):
    texts = [
        "Released under the MIT License.",
        "apache license, VERSION 2.0 and again Apache License version 2",
        "CC BY-NC 4.0 here; Licensed under CC BY NC 4.0 International License",
        "This work is licensed under the GNU General Public License, version 3.",
        "licensed under the GNU General Public License as published by the Free Software Foundation, either version 2",
        "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "under the mit licence",
        None,
        "",
    ]
    out = lic.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.base_labels for r in out] == ["mit", "apache-2", "cc-by-nc", "", "", "", "", "", ""]
    assert [r.labels for r in out] == ["mit", "apache-2", "cc-by-nc", "gpl-3", "gpl-2", "isc", "", "", ""]
    assert [(r.n_base, r.first_word, r.last_word) for r in out[:4]] == [(1, 1, 1), (2, 0, 7), (2, 0, 8), (0, None, None)]
    assert out[7].n_words == 0 and out[7].score == 0 and all(0 <= r.score <= 1 for r in out)


def test_license_base_by_brute_force(spark):
    got = {r.doc_id: r for r in QUERIES["op8_license_scan"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = alnum_words(r.text)
        places = [(i, label) for phrase, label in lic.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        row = got[r.doc_id]
        assert (row.n_words, row.n_base, row.base_labels) == (len(w), len(places), ",".join(sorted({x for _, x in places})))


def test_automaton():
    a = lic.Automaton("one two three <<optional>> four <<optional>> five <<end>> <<end>> six <<var 2>> end")
    match = lambda t: a.match([w.encode() for w in t.split()])
    assert match("one two three six end") == 5 and match("one two three four five six x y end tail") == 9
    assert match("one two three five six end") == 0 and match("one two three six x y z end") == 0
    with pytest.raises(ValueError):
        lic.Automaton("one <<optional>> two <<end>>")


def test_quality(spark):
    got = QUERIES["op10_quality_classifier"](spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    assert (got.held_out == held_out_share(got, 5, 0)).all() and (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert len(bad) and (good.to_numpy()[:, None] > bad.to_numpy()[None, :]).mean() > 0.97


def test_quality_gradients():
    rng = np.random.default_rng(0)
    d, sizes = 6, np.array([1, 3, 2])
    offs = np.concatenate(([0], np.cumsum(sizes)))
    x, y = rng.normal(size=(6, d)), np.array([1.0, 0.0, 1.0])
    w = {"E": rng.normal(size=(d, q.HIDDEN)), "e": rng.normal(size=q.HIDDEN), "V": rng.normal(size=(q.HIDDEN, q.HIDDEN)), "U": rng.normal(size=(q.HIDDEN, q.HIDDEN)), "a": rng.normal(size=q.HIDDEN), "c": rng.normal(size=q.HIDDEN), "b": rng.normal(size=1)}
    fixed = {"mean": np.zeros(d), "scale": np.ones(d)}

    def loss(v):
        p = q.Model(v | fixed).forward(x, offs)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    f = q.Model(w | fixed).forward(x, offs)
    g = q._gradients(w, f, offs, sizes, (f["p"] - y) / 3)
    for k in w:
        at = tuple(rng.integers(0, n) for n in w[k].shape)
        up, down = {n: v.copy() for n, v in w.items()}, {n: v.copy() for n, v in w.items()}
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert g[k][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-6)


def test_quality_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = q.classify(docs, q.train(docs, none))
    assert out.count() == 5 and {r.score for r in out.collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, None), (2, 1)], "doc_id long, quality int")
    scores = [r.score for r in q.classify(docs, q.train(docs, labels)).orderBy("doc_id").collect()]
    assert all(0 <= s <= 1 for s in scores) and scores[1] == scores[2] and scores[3] == scores[4]


def test_language_id_learns_from_whole_texts(spark):
    """What tells languages apart comes late in long texts, after more than 20,000 characters that all share."""
    late = {"en": "the cat sat on that mat and ", "de": "der hund und die katze sind "}
    rows = [(i, "0 1 x 2 3 " * 2100 + late[g] * 3000, g) for i, g in enumerate(["en", "de"] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = li.train(df)
    got = li.predict(df, model, keep=("doc_id", "lang")).collect()
    assert all(r.lang_pred == r.lang and r.score > 0.9 and not r.rejected for r in got)


def test_language_id_of_a_small_table(spark):
    """Two hundred documents are enough to tell four languages apart, and none is turned away."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = li.predict(docs, li.train(docs), keep=("lang",)).toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97 and not got.rejected.any()


def test_language_id_trains_in_a_task(spark, monkeypatch):
    """The driver neither gathers the sample nor learns from it."""
    rows = [(i, t * 20, g) for i, (t, g) in enumerate([("the cat sat on that mat ", "en"), ("der hund und die katze ", "de")] * 12)]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string")
    fit, driver = li.fit, os.getpid()

    def away(*of):
        assert os.getpid() != driver
        return fit(*of)

    monkeypatch.setattr(li, "fit", away)
    model = li.train(df)
    assert model.languages == ("de", "en") and model.table.shape == (li.BUCKETS, 2)
    assert all(r.lang_pred == r.lang for r in li.predict(df, model, keep=("doc_id", "lang")).collect())


@pytest.mark.parametrize("n", [0, 1, 3, 700, 5000])
def test_whole_texts_are_counted_in_slices(monkeypatch, n):
    """The counts of a text's subwords are those of the whole of it, however it is cut; and passages come anew for each epoch from all of it."""
    rng = np.random.default_rng(n)
    text = "".join(rng.choice(list("abé ñ."), n)) if n else ""
    whole = li.whole_text(text)
    counts = np.zeros(li.BUCKETS)
    for grams in li.subwords(np.frombuffer(text.encode(), np.uint8)):
        counts += np.bincount(grams, minlength=li.BUCKETS)
    buckets = np.flatnonzero(counts)
    assert np.array_equal(np.frombuffer(whole[0], np.uint16), buckets) and np.allclose(np.frombuffer(whole[1], np.float32), counts[buckets] / max(counts.sum(), 1))
    monkeypatch.setattr(li, "SLICE_BYTES", 97)
    assert li.whole_text(text) == whole
    pieces = li._passages(text, 7)
    assert len(pieces) == li.EPOCHS * min(-(-len(text.encode()) // li.PASSAGE_BYTES), li.PASSAGES) and all(p in text.encode() for p in pieces)
    assert n < 5000 or len(set(pieces)) > li.PASSAGES


def test_numerals_are_no_letters(spark):
    """Superscripts, fractions and Roman numerals are no letters; an ideograph and a letter that joins a number are."""
    assert [li.has_letter(t) for t in ("½ ² 3", "Ⅳ", "_ 12 ٣", "", "日", "12a", "é")] == [False, False, False, False, True, True, True]
    rows = [(i, t * 20, g) for i, (t, g) in enumerate([("the cat sat on that mat ", "en"), ("der hund und die katze ", "de")] * 12)]
    df = spark.createDataFrame([*rows, (90, "½ ² 3", None), (91, "Ⅳ", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.predict(df, li.train(df)).collect()}
    assert got[90] == got[91] == ("und", 0.0)


def test_many_ranges_of_ids(spark, monkeypatch):
    """Ranges by bytes, more than there are rows, ids that repeat at their cuts, and every row in one place."""
    monkeypatch.setattr(fp, "RANGE_BYTES", 20)
    rows = [(i // 3, f"text {i} of some letters") for i in range(120)] + [(None, "x"), (None, None)]
    got = fp.with_edited(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t = t or ""
        want.append((i, hashlib.sha256((t[: len(t) - len(t) // 3] + (after or "")[: len(t) // 3]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
