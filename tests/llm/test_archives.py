"""Packing, byte-pair encoding, WARC bundles, HTML text and the pipeline: round trips and odd tables."""

import hashlib
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from fathomline.llm import html_text as ht, packing, warc
from fathomline.llm.bpe import Encoder
from fathomline.llm.registry import QUERIES
from tests.conftest import SF


@pytest.fixture(scope="module")
def encoder():
    return Encoder(packing.tokenizer_path())


ODD = ["", "x's it'll", "Ünï ×÷ 12ab\x00\x01 ~~ ¡hola! ½²", "日本語 é", "a" * 60 + " b", "é" * 30, "<|endoftext|> hi", "   ", " a\u0085b", "ß ẞ ÿ", None]


def test_encoder_gives_the_tokenizers_ids(encoder):
    for first, ids, offs in encoder.encode(pa.array(ODD)):
        for i in range(len(offs) - 1):
            want = encoder.tokenizer.encode(ODD[first + i] or "", add_special_tokens=False).ids
            assert ids[offs[i] : offs[i + 1]].tolist() == want, ODD[first + i]


def test_encoder_holds_one_small_group(encoder):
    draw = np.random.default_rng(3)
    words = np.array(["".join(chr(97 + c) for c in draw.integers(0, 26, n)) for n in draw.integers(2, 9, 3000)])
    texts = [" ".join(draw.choice(words, 4000)) for _ in range(700)]
    column = pa.array(texts)
    assert column.nbytes > 14e6
    tracemalloc.start()
    try:
        firsts, sizes = [], []
        for first, ids, offsets in encoder.encode(column):
            firsts.append(first)
            sizes += np.diff(offsets).tolist()
            assert ids[: offsets[1]].tolist() == encoder.tokenizer.encode(texts[first], add_special_tokens=False).ids
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(firsts) > 4 and len(sizes) == len(texts) and peak < 100e6, (len(firsts), peak)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abcdeinorstTHE ÉéÿÀ×.,!#0129\n'日", max_size=60), min_size=1, max_size=5))
def test_encoder_on_any_text(texts):
    encoder = packing._encoder(packing.tokenizer_path())
    for first, ids, offs in encoder.encode(pa.array(texts)):
        for i in range(len(offs) - 1):
            assert ids[offs[i] : offs[i + 1]].tolist() == encoder.tokenizer.encode(texts[first + i], add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), max_size=40))
def test_plan_places_every_length_once(lengths):
    h = np.zeros(65, np.int64)
    for k, n in lengths.items():
        h[k] = n
    runs = packing.plan(h)
    assert (np.bincount(runs[:, 0], weights=runs[:, 2], minlength=65) == h).all()
    slots = [(s + i, o, n) for n, _, c, s, o in runs.tolist() for i in range(c)]
    by = {}
    for s, o, n in slots:
        by.setdefault(s, []).append((o, n))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64


def test_plan_fills_sequences():
    h = np.concatenate(([0], np.full(2048, 20)))
    runs = packing.plan(h)
    total = int((h * np.arange(2049)).sum())
    assert (runs[:, 3] + runs[:, 2]).max() <= 1.01 * -(-total // 2048)


def test_pack(spark, encoder):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, "word " * 5000), (50, "word " * 5000), (None, "no id")]
    got = packing.pack(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).toPandas()
    want = sum(len(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert got.length.sum() == want
    g = got.sort_values(["sequence_id", "offset"])
    ends = (g.offset + g.length).groupby(g.sequence_id).shift().fillna(0)
    assert (ends == g.offset).all() and (g.offset + g.length).max() <= 2048
    long = got[got.doc_id == 50].sort_values(["piece", "sequence_id"])
    ids = np.array(encoder.tokenizer.encode("word " * 5000, add_special_tokens=False).ids + [0], "<u4")
    for r in long.itertuples():
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert packing.pack(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bundle_round_trip():
    w = warc.BundleWriter(frame_bytes=500)
    records = [warc.record_bytes(str(i), f"http://h/{i}", bytes([65 + i % 26]) * i, "d", None if i % 3 else "0") for i in range(40)]
    places = [w.add(r) for r in records]
    reader = warc.BundleReader(w.close())
    assert len(reader) > 5
    for r, (frame, offset) in zip(records, places):
        assert reader.frame(frame)[offset : offset + len(r)] == r
        got = reader.record(frame, offset, len(r))
        assert got["fields"]["WARC-Type"] in ("response", "revisit")
    import zstandard

    assert b"".join(reader.frame(k) for k in range(len(reader))) == b"".join(records)
    whole = zstandard.ZstdDecompressor().stream_reader(reader.bundle, read_across_frames=True).read()
    assert whole == b"".join(records)  # plain readers see one stream and skip the table


def test_archive(spark, tmp_path):
    body = "é" * 60
    rows = [(5, "u5", body), (3, "u3", body), (9, None, body), (4, "u4", "short"), (6, "u6", "short"), (7, "u7", None), (8, "u8", ""), (3, "u3", body), (None, "n", body)]
    bundles = warc.archive(spark, spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted(((r.record_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_bundles(bundles).collect()), key=str)
    assert got == sorted([("5", "revisit", "3", 120), ("3", "response", None, 120), ("9", "revisit", "3", 120), ("4", "response", None, 5), ("6", "response", None, 5), ("7", "response", None, 0), ("8", "response", None, 0), ("3", "response", None, 120), ("", "revisit", "3", 120)], key=str)
    one = warc.fetch(bundles, ["4"])["4"]
    assert one["payload"] == b"short" and one["fields"]["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(b"short").hexdigest()
    assert warc.export(bundles, str(tmp_path)).count() == len(list(tmp_path.glob("*.warc.zst")))
    assert warc.read_bundles(warc.archive(spark, spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


PAGE = """<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use</div>
<main><article><header><h1>Title &eacute; {0}</h1></header><p>First <b>bold</b>  text &amp; more {0}<p>Second <script>x("<p>")</script>part {0}<form>mail</form><aside>side</aside>
<ul><li>one {0}<li>two {0}</ul><div class="post-comments"><p>bad</p></div></article></main><div id="sidebar">zz</div><footer>f</footer>"""


def test_html_text(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i)) for i in range(6)]
    rows += [(20, "http://other.example/", "<p>plain &lt;text&gt;<br>line<div class=ad>buy</div>"), (21, None, None), (22, "x", ""), (23, "http://h.example/z", "<nav>only</nav>"), (0, "http://h.example/0", PAGE.format(0))]
    got = {r.page_id: r for r in ht.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "Title é 3\nFirst bold text & more 3\nSecond part 3\none 3\ntwo 3" and got[3].n_chars == len(got[3].text)
    assert got[20].text == "plain <text>\nline"
    assert [got[i].text for i in (21, 22, 23)] == ["", "", ""]
    assert ht.extract(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_text_goes(spark):
    """A text that all pages of a host hold outside of marked regions is the template's; their own texts stay."""
    rows = [(i, f"http://h.example/{i}", f"<body><div><p>Welcome to our site</p><p>Follow us</p></div><div><p>Own words of page {i}</p></div>") for i in range(8)]
    got = {r.page_id: r.text for r in ht.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Own words of page {i}" for i in range(8)}


def test_html_of_test_pages(spark):
    import html
    import re

    got = {r.page_id: r.text for r in QUERIES["op9_html_extraction"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?p>|<br>|</?h1>", article)]
        assert got[r.page_id] == "\n".join(x for x in blocks if x)


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as cp
    from fathomline.llm import decontaminate as dc
    from tests.llm.test_dedup import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    named = cp.name_language(spark, docs, SF)
    assert named.columns == docs.columns and named.count() >= 0.98 * docs.count()
    rows = [(r.doc_id, r.text) for r in named.collect()]
    one = cp.drop_near_copies(spark, named, SF)
    assert {r.doc_id for r in one.collect()} == {i for i, _, c in brute(rows) if i == c}
    cut = cp.cut_repeats(spark, one, SF)
    assert cut.columns == docs.columns
    seen = {}
    for r in sorted(cut.collect(), key=lambda r: r.doc_id):
        w = r.text.lower().split()
        for i in range(len(w) - 49):
            assert seen.setdefault(" ".join(w[i : i + 50]), r.doc_id) == r.doc_id
    clean = cp.drop_benchmark_leaks(spark, cut, SF)
    windows = dc.item_windows([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()], 10)
    leaks = {r.doc_id for r in cut.collect() if any(b" ".join(w[i : i + n]) in windows for w in [dc.item_words(r.text)] for n in {k.count(b" ") + 1 for k in windows} for i in range(len(w) - n + 1))}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in cut.collect()} - leaks
    assert {r.doc_id for r in cp.pack_sequences(spark, clean, SF).collect()} == {r.doc_id for r in clean.collect()}
