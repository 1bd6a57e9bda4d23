"""Main text of web pages on odd tables."""

import random
import re
import time
from collections import Counter

import pytest

from fathomline.llm import html_text as ht

SCHEMA = "page_id long, url string, html string"


def page(text, marked=True):
    tag = "article" if marked else "div"
    return f"<html><body><div class='crumbs'><p>Home</p></div><{tag}><h1>{text} title</h1><p>{text} first</p><p>{text} second</p></{tag}></body></html>"


def texts(spark, rows, parts):
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), SCHEMA)
    return {r.page_id: r.text for r in ht.extract(spark, df).collect()}


@pytest.mark.parametrize("most", [8 << 20, 0])
def test_copies_of_a_page_are_one_page(spark, monkeypatch, most):
    """A host that serves one html many times, in as many partitions, keeps its article, by both ways to deal copies."""
    monkeypatch.setattr(ht, "BROADCAST_BYTES", most)
    whole = "solo title\nsolo first\nsolo second"
    rows = [(i, f"https://one.example/{i}", page("solo")) for i in range(10)]
    rows += [(20 + i, f"https://two.example/{i}", page("solo" if i < 9 else f"other{i}")) for i in range(11)]
    rows += [(50, "https://one.example/0", page("solo")), (60, None, None), (61, None, "")]
    random.Random(1).shuffle(rows)
    got = texts(spark, rows, 12)
    assert {i: t for i, t in got.items() if i < 29 or i == 50} == dict.fromkeys([*range(10), *range(20, 29), 50], whole)
    assert got[29] == "other9 title\nother9 first\nother9 second" and got[60] == got[61] == ""
    assert got == texts(spark, rows, 1)


def plain(i, order=("Top", "Latest", "End")):
    """A page without a marked article or telling names: a frame of blocks that all pages have around a text of its own."""
    top, latest, end = order
    items = "".join(f"<li><p>{latest} {k}</p></li>" for k in range(3))
    return f"<html><body><div class='a1'><p>{top} line</p><p>{top} more</p></div><div class='b2'><h1>Story {i}</h1><p>Text {i} of its own.</p><p>More &amp; more of {i}</p></div><div class='c3'><ul>{items}</ul><p>{end} line</p></div></body></html>"


def test_template_decides_where_nothing_is_marked(spark):
    """An empty template fails there, the one built from the host's pages gives the text; the frame out of its order is no template."""
    own = lambda i: f"Story {i}\nText {i} of its own.\nMore & more of {i}"
    rows = [(i, f"https://plain.example/{i}", plain(i)) for i in range(12)] + [(90, "https://single.example/", plain(90))]
    for parts in (1, 5):
        got = texts(spark, rows, parts)
        assert all(got[i] == own(i) for i in range(12))
        assert got[90] == ht.main_text(plain(90), ht.Template()) != own(90)
    # a class whose tokens are in another order on a page isn't its template
    blocks, tokens = ht.parse("<p>B</p><p>A</p>")
    a, b = (ht._hash("text", blocks[0].path, t) for t in "AB")
    assert ht.Template([{"class": 0, "place": 0, "token": a}, {"class": 0, "place": 1, "token": b}]).valid_tokens(blocks, tokens) == set()
    assert ht.Template([{"class": 0, "place": 0, "token": b}, {"class": 0, "place": 1, "token": a}]).valid_tokens(blocks, tokens) == {a, b}
    # nor is one with places in two slots of the root
    blocks, tokens = ht.parse("<p>x</p><p>R</p><p>x</p>")
    r, x = (ht._hash("text", blocks[0].path, t) for t in "Rx")
    assert ht.Template([{"class": 0, "place": 0, "token": r}, {"class": 1, "place": 0, "token": x}]).valid_tokens(blocks, tokens) == {r}


def test_article_keeps_what_other_pages_have(spark):
    rows = [(i, f"https://one.example/{i}", f"<body><article><h1>Report {i}</h1><p>By the staff</p><p>Own {i}</p><p>All rights kept</p></article></body>") for i in range(8)]
    assert texts(spark, rows, 3)[3] == "Report 3\nBy the staff\nOwn 3\nAll rights kept"


def test_odd_markup():
    read = lambda html: ht.main_text(html, ht.Template())
    assert read("<p title='a > b'>x</p><p class=\"q\">y") == "x\ny"
    assert read("<p>1 < 2</p><a href=") == "1 < 2\n<a href="
    assert read("<p title='never closed>x</p>") == "x"
    long = "<p>" + "word " * 300_000 + "</p>"
    assert len(read(long)) == 5 * 300_000 - 1
    for hostile in ("<a '" + "<a b" * 100_000, '<a "' * 100_000, "<a '\"" * 50_000 + ">"):
        start = time.time()
        read(hostile)
        assert time.time() - start < 5


def test_empty_table_and_extra_columns(spark):
    assert ht.extract(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "u", "<p>x</p>", "t", 3)], SCHEMA + ", text string, n_chars int")
    assert ht.extract(spark, df).first().asDict() == {"page_id": 1, "url": "u", "text": "x", "n_chars": 1}


def test_unmarked_copies_of_a_page(spark):
    rows = [(i, f"https://one.example/{i}", page("solo", marked=False)) for i in range(10)]
    got = texts(spark, rows, 10)
    assert set(got.values()) == {"Home\nsolo title\nsolo first\nsolo second"}


def test_slots_are_extracted_where_nothing_tells(spark):
    """The driver's pages with article tags, telling elements and names taken away: the template built of them gives the articles, the empty one none."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    want, rows = {}, []
    for r in pages:
        want[r.page_id] = "\n".join(b.text for b in ht.parse(r.html)[0] if b.article)
        bare = re.sub(r'\s(class|id|role)="[^"]*"', "", r.html)
        rows.append((r.page_id, r.url, re.sub(r"<(/?)(article|nav|footer|aside|header|form)\b", r"<\1div", bare)))
    got, hosts = texts(spark, rows, 4), Counter(ht.host_of(url) for _, url, _ in rows)
    asked = [(i, page) for i, url, page in rows if hosts[ht.host_of(url)] >= ht.LEAST_PAGES]
    assert len(asked) > 100 and sum(got[i] == want[i] for i, _ in asked) >= 0.9 * len(asked)
    assert sum(ht.main_text(page, ht.Template()) == want[i] for i, page in asked) <= 0.05 * len(asked)


def test_names_inside_an_article_have_to_say_it_as_a_whole():
    read = lambda inner: ht.main_text(f"<body><article><p>Start.</p>{inner}</article></body>", ht.Template())
    for kept in ("<p class='share-price'>x</p>", "<div class='legal-analysis'>x</div>", "<p class='follow-up'>x</p>", "<div id='menu-of-the-day'>x</div>", "<section class='popular-science'>x</section>"):
        assert read(kept) == "Start.\nx", kept
    for gone in ("<div class='ad'>x</div>", "<div class='ad-slot'>x</div>", "<div class='comments'>x</div>", "<div id='reader-comments'>x</div>", "<ul class='social share'><li>x</li></ul>", "<div class='relatedArticles'>x</div>", "<aside>x</aside>"):
        assert read(gone) == "Start.", gone


def test_several_articles_and_teasers():
    read = lambda body: ht.main_text(f"<body>{body}</body>", ht.Template())
    story = "<p>" + "Word after word. " * 30 + "</p>"
    text = ("Word after word. " * 30).strip()
    assert read(f"<div>{story}</div><article><p>Read on</p></article>").startswith(text)
    assert read(f"<article>{story}</article><article><p>Read on</p></article>") == text
    assert read(f"<article>{story}</article><article>{story}</article>") == f"{text}\n{text}"
    assert read(f"<main><h1>Head</h1><article>{story}</article><article><p>Teaser</p></article></main><p>out</p>") == f"Head\n{text}"
    assert read(f"<article>{story}<article><p>Nested</p></article></article>") == f"{text}\nNested"


def test_long_pages_in_slots(spark):
    own = "One sentence. " * 20_000
    rows = [(i, f"https://long.example/{i}", f"<body><div>Top {i}</div><div><p>{own}{i}</p><div>Small {i}</div></div><div>End {i}</div></body>") for i in range(6)]
    assert texts(spark, rows, 2)[4] == f"{own}4\nSmall 4"


def test_slots_of_the_template_hold_the_marked_article():
    page = "<body><div><p>Menu</p><article><p>Short news of the day.</p><div>More of it.</div></article></div><div>" + "<p>Talk of others on and on.</p>" * 3 + "</div></body>"
    blocks, _ = ht.parse(page)
    held = {ht._hash("held", slot, ""): n for slot, n in {"": 1100, "/body1": 1100, "/body1/div1": 100, "/body1/div1/article1": 90, "/body1/div1/article1/div1": 80, "/body1/div2": 1000}.items()}
    by_mark = ht.marked(blocks)
    slots = ht.Template(held=held).slots(blocks, {b.mark for b in by_mark})
    assert by_mark and all(any(f"{b.slot}/".startswith(f"{s}/") for s in slots) for b in by_mark)
    less = {**held, ht._hash("held", "", ""): 100, ht._hash("held", "/body1", ""): 100, ht._hash("held", "/body1/div2", ""): 0}
    assert ht.Template(held=less).slots(blocks, {b.mark for b in by_mark}) == {"/body1/div1/article1"}
    assert ht.main_text(page, ht.Template(held=held)) == "Short news of the day.\nMore of it."
