"""Main text of web pages by equivalence classes of tokens across the pages of a host.

Tokens are a page's structural tags with their paths and its text blocks with
theirs. Over all pages of a host each token has an occurrence vector; two numbers and a
64-bit XOR stand for it (pages, occurrences, and a hash of page and count XORed over pages),
so it is summed map-side and shuffled as one row a token and task. Tokens that
share a vector form an equivalence class. A class of enough tokens on enough of the host's
pages may be of its template; its tokens are put in the order of their first places, summed over the pages. The largest class that is
on most pages, once on each, is the root.

A page's own tokens validate a class there: all its tokens must be on the page in the class's order, and every place
of a class but the root must lie in one slot of the root, between two of its tokens. Text blocks of valid classes are the template's and go.

Elements that hold others are tokens by their ordinals too (the third div of the body), so what the pages share is told apart even where all names are
alike. Each is a slot; its characters are summed over the host's pages, and the page is descended from its top into the slot that holds by far most text,
until the text is the element's own or several slots share it: those are extracted. Slots that hold mostly links over the host's pages go, and so do
regions whose element or class says that they are menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles or reader comments; inside an article a class has to say so as a whole.

Where a page marks its article (the large ones, if there are several, or what is in ``main``) and that is no teaser, the marked element is a slot
that the descent stops at, and one on the way to it is never passed over for a larger one. A check follows: of the extracted slots' blocks those outside of the mark go, and those
inside stay, whatever of them other pages have as well.

Defined cases: a null or empty html, or one without main text, gives an empty text
(0 characters); a null url is a host of its own with an empty name; exact copies of a page on a host
count once over the whole table; hosts of fewer than ``LEAST_PAGES`` pages have no template; unclosed and stray tags
are read as browsers do, roughly; repeated rows get equal rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from fathomline.llm.frames import fits_broadcast, partitions
from fathomline.scratch import Scratch

#: A token is of the template if it is on this share of a host's pages, and on so many.
SUPPORT = 0.5
LEAST_PAGES = 5
#: A class of fewer tokens is no evidence of a template.
LEAST_TOKENS = 2
LINK_SHARE = 0.5
#: A slot counts beside the largest of its element, and an article beside the largest of its page, from this share of it on.
BESIDE = 0.2
#: A marked article of less than this share of the page's text is a teaser.
TEASER = 0.25
#: Above this size the templates are joined by a shuffle instead of being broadcast.
BROADCAST_BYTES = 8 << 20
#: Tokens that a task holds before it hands its counts on.
HELD_TOKENS = 200_000

#: Elements by what they mean for the main text.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
OUT = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "svg", "math", "canvas", "object", "audio", "video", "head", "fieldset", "datalist"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
ROLES_OUT = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar", "tooltip"}
#: Words in a class or id that say what a region is, at its start or its end.
NAMES_OUT = set(
    """ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promos promoted promotion
    banner sidebar sidebars side rail nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs footer foot footers header masthead topbar toolbar
    cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay lightbox disclaimer
    newsletter subscribe subscription signup login register search searchbox form share sharing shares social follow
    related recommended recommendations recommendation trending popular widget widgets pagination pager
    comment comments commentlist disqus respond reply replies discussion feedback copyright legal imprint skip outbrain taboola""".split()
)
#: Words that a class of a region inside an article may have besides.
NAMES_WITH = set("box list block section wrapper wrap container inner outer area bar links link item items slot unit buttons button icons reader readers user users article articles post posts posted here news top bottom left right inline main".split())
#: Elements that hold others; each is a slot by its ordinal among those of its name.
HOLDERS = {"body", "div", "section", "main", "article", "table", "tbody", "tr", "td", "center", "ul", "ol", "dl", "form", "details", "figure", "header", "blockquote"}
NAMES_KEEP = {"no", "has", "with", "without", "hide", "is", "js"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_STOP = re.compile("[\"'>]")
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>|\Z", re.I | re.S) for t in RAW}
_SPACES = re.compile(r"\s+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _says_out(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in OUT or tag == "header" and not in_article:
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in ROLES_OUT or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w.lower() for w in _WORD.findall(name)]
        if not words or words[0] in NAMES_KEEP:
            continue
        if in_article:  # the whole name says so, not a word of it
            if not NAMES_OUT.isdisjoint(words) and NAMES_OUT | NAMES_WITH >= {*words} and words[-1] not in ("header", "side"):
                return True
        elif words[0] in NAMES_OUT or words[-1] in NAMES_OUT:
            return True
    return False


class Block:
    """A text block: its text, the path of tags and classes to it, the number of the article that holds it (0: none), whether ``main`` does, its characters in links, the number of tags before it, the slot that it is in, by ordinals, and the slot of the outermost ``main`` or article that holds it (empty: none)."""

    __slots__ = ("text", "path", "article", "main", "linked", "place", "slot", "mark")

    def __init__(self, text: str, path: str, article: int, main: bool, linked: int, place: int, slot: str, mark: str):
        self.text, self.path, self.article, self.main, self.linked, self.place, self.slot, self.mark = text, path, article, main, linked, place, slot, mark


def _tag_end(page: str, at: int) -> int:
    """Where the tag whose attributes begin here ends, or -1; quotes hold what they enclose, but for one that is never closed. What is scanned is used, so a page is scanned once."""
    while m := _STOP.search(page, at):
        at = m.end()
        if m[0] == ">":
            return at
        close = page.find(m[0], at)
        if close < 0:
            return page.find(">", at) + 1 or -1
        at = close + 1
    return -1


def parse(page: str) -> tuple[list[Block], list[str]]:
    """The blocks of a page outside of regions that say they are no main text, and its structural tokens."""
    blocks: list[Block] = []
    tokens: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, whether it begins an excluded region, an article, a main part
    names: list[str] = []
    slots: list[str] = [""]  # of each element of the stack
    ordinals: dict[tuple[str, str], int] = {}
    parts: list[str] = []
    mark = ""
    linked = out = articles = mains = links = at = number = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACES.sub(" ", "".join(parts)).strip()
            if text:
                blocks.append(Block(text, "/".join(names), number if articles else 0, mains > 0, linked, len(tokens), slots[-1], mark if articles or mains else ""))
            parts.clear()
        linked = 0

    def pop() -> None:
        if stack[-1][0] in BLOCK:
            flush()
        leave(len(stack) - 1)

    def leave(i: int) -> None:
        nonlocal out, articles, mains, links
        tag, was_out, was_article, was_main = stack.pop(i)
        names.pop(i)
        slots.pop(i + 1)
        out -= was_out
        articles -= was_article
        mains -= was_main
        links -= tag == "a"

    def say(text: str) -> None:
        nonlocal linked
        if text and not out:
            text = entities.unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                linked += len(text)

    while True:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end() if m[2] is None else _tag_end(page, m.end())
        if at < 0:  # no tag ends any more
            say(page[m.start() :])
            break
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:-3])
            continue
        tag, said = m[2].lower(), page[m.end() : at - 1]
        if m[1]:
            if any(s[0] == tag for s in stack):
                if tag in BLOCK or stack[-1][0] == tag:
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                else:  # an inline end tag out of order closes nothing else
                    leave(max(k for k, s in enumerate(stack) if s[0] == tag))
            elif tag in ("p", "br"):
                flush()
            tokens.append(f"{'/'.join(names)}</{tag}")
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end()
            continue
        if tag in BLOCK:
            flush()
            if tag not in ("br", "hr"):  # a paragraph ends where another block begins
                below = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ("p", "li", "td", "th", "tr", "dd", "dt", "ul", "ol", "table", "div", "article", "section", "aside", "body")), None)
                if below is not None and (stack[below][0] == "p" or stack[below][0] == tag == "li" or stack[below][0] in ("td", "th") and tag in ("td", "th", "tr") or stack[below][0] == tag == "tr" or stack[below][0] in ("dd", "dt") and tag in ("dd", "dt")):
                    while len(stack) > below:
                        pop()
        attributes = {a.lower(): b or c or d for a, b, c, d in _ATTR.findall(said)} if said else {}
        if said and re.search(r"(?:^|\s)hidden(?:\s|/|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", said)):
            attributes["hidden"] = ""
        name = tag + "." + attributes["class"] if attributes.get("class") else tag
        tokens.append(f"{'/'.join(names)}<{name}")
        if tag in VOID or said.endswith("/"):
            if tag == "br":
                parts.append(" ")
            continue
        is_out, role = _says_out(tag, attributes, articles + mains > 0), attributes.get("role", "").lower()
        is_article, is_main = tag == "article" or role == "article" or attributes.get("itemprop") == "articleBody", tag == "main" or role == "main"
        number += is_article and not articles
        slot = slots[-1]
        if tag in HOLDERS:
            ordinals[slot, tag] = ordinals.get((slot, tag), 0) + 1
            slot = f"{slot}/{tag}{ordinals[slot, tag]}"
        if (is_article or is_main) and not articles + mains:
            mark = slot
        stack.append((tag, is_out, is_article, is_main))
        names.append(name)
        slots.append(slot)
        out += is_out
        articles += is_article
        mains += is_main
        links += tag == "a"
    while stack:
        pop()
    flush()
    return blocks, tokens


def _hash(kind: str, path: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}\0{path}\0{text}") - (1 << 63)


def token_places(blocks: list[Block], tokens: list[str]) -> dict[int, list[int]]:
    """The places of each token of a page, tags and text blocks, in their order."""
    places: dict[int, list[int]] = defaultdict(list)
    for i, t in enumerate(tokens):
        places[_hash("tag", t, "")].append(2 * i)
    for b in blocks:
        places[_hash("text", b.path, b.text)].append(2 * b.place - 1)
    return places


def held_by_slots(blocks: list[Block]) -> dict[str, int]:
    """The characters outside of links that each slot holds, those of the slots in it as well."""
    held: dict[str, int] = defaultdict(int)
    for b in blocks:
        n = len(b.text) - b.linked
        slot = b.slot
        held[slot] += n
        while slot:
            slot = slot.rpartition("/")[0]
            held[slot] += n
    return held


# ---- occurrence vectors and templates ----------------------------------------------

COUNTS = StructType([StructField("host", StringType()), StructField("token", LongType())] + [StructField(c, LongType()) for c in ("pages", "total", "vector", "chars", "linked", "place")])
_PAGES_TOKEN = 0


def occurrences(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Partial occurrence vectors: (host, token, pages, total, vector, chars, linked, sum of first places) of each task.

    Exact copies of a page on a host must be in one task, see ``copies_together``.
    """
    arrow = to_arrow_schema(COUNTS)

    def run(batches):
        held: dict[tuple[str, int], list[int]] = {}
        copies: set[tuple[str, int]] = set()

        def flush():
            keys = list(held)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64())]
            columns += [pa.array([held[k][i] for k in keys], pa.int64()) for i in range(6)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for batch in batches:
            for address, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                host, page = host_of(address), page or ""
                key = xxhash.xxh64_intdigest(page.encode("utf-8", "surrogatepass"))
                if (host, key) in copies:
                    continue
                copies.add((host, key))
                blocks, tokens = parse(page)
                places = token_places(blocks, tokens)
                count = {token: len(at) for token, at in places.items()}
                slots: dict[int, list[int]] = defaultdict(lambda: [0, 0])
                for b in blocks:
                    slot = _hash("slot", b.path, "")
                    count[slot] = count.get(slot, 0) + 1
                    slots[slot][0] += len(b.text)
                    slots[slot][1] += b.linked
                for slot, n in held_by_slots(blocks).items():
                    count[_hash("held", slot, "")] = 1
                    slots[_hash("held", slot, "")][0] = n
                count[_PAGES_TOKEN] = 1
                for token, n in count.items():
                    row = held.setdefault((host, token), [0, 0, 0, 0, 0, 0])
                    row[0] += 1
                    row[1] += n
                    row[2] ^= xxhash.xxh64_intdigest(f"{key}:{n}") - (1 << 63)
                    if token in slots:
                        row[3] += slots[token][0]
                        row[4] += slots[token][1]
                    elif token in places:
                        row[5] += places[token][0]
                if len(held) >= HELD_TOKENS:
                    yield flush()
        yield flush()

    return pages.select(F.col(f"`{url}`"), F.col(f"`{html}`")).mapInArrow(run, COUNTS)


def _digest(page: str) -> int:
    return xxhash.xxh64_intdigest(page.encode("utf-8", "surrogatepass")) - (1 << 63)


def copies_together(rows: DataFrame, store: Scratch) -> DataFrame:
    """(url, html) of ``rows`` with all exact copies of a page on a host in one task; a task sends on one of them.

    Digests alone are shuffled to find the pages that recur; only those cross the network.
    """
    digest = F.xxhash64(F.coalesce("html", F.lit("")))
    again = store.save(rows.select(digest.alias("digest")).groupBy("digest").count().filter("count > 1").select("digest"), "again")
    plain = rows.select("url", "html")
    dealt = StructType([StructField("host", StringType()), StructField("page", LongType()), StructField("url", StringType()), StructField("html", StringType())])
    arrow = to_arrow_schema(dealt)

    def once(batches):
        sent: set[tuple[str, int]] = set()
        for batch in batches:
            urls, pages = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keys, picked = [], []
            for i, (address, page) in enumerate(zip(urls, pages)):
                key = host_of(address), _digest(page or "")
                if key not in sent:
                    sent.add(key)
                    keys.append(key)
                    picked.append(i)
            body = batch.take(pa.array(picked, pa.int64()))
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), *body.columns]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def deal(some: DataFrame) -> DataFrame:
        return some.mapInArrow(once, dealt).repartition(partitions(rows.sparkSession), "host", "page").select("url", "html")

    if not fits_broadcast(again, BROADCAST_BYTES, 24):
        return deal(plain)
    known = F.broadcast(again.withColumnRenamed("digest", "__digest"))
    alike = digest == F.col("__digest")
    return plain.join(known, alike, "left_anti").union(deal(plain.join(known, alike, "left_semi")))


#: A token of a template: its class (0: the root) and its place in the order of the class.
TEMPLATE = "array<struct<class:int,place:int,token:bigint>>"


def templates(counts: DataFrame, store: Scratch) -> DataFrame:
    """For each host its template: tokens of its classes in their order (the root is class 0), and link slots."""
    sums = [F.sum(c).alias(c) for c in ("pages", "total", "chars", "linked", "place")]
    summed = store.save(counts.groupBy("host", "token").agg(*sums, F.bit_xor("vector").alias("vector")).filter((F.col("pages") >= LEAST_PAGES)), "summed")
    hosts = summed.filter(F.col("token") == _PAGES_TOKEN).select("host", F.col("pages").alias("host_pages"))
    often = summed.filter(F.col("token") != _PAGES_TOKEN).join(hosts, "host").filter(F.col("pages") >= SUPPORT * F.col("host_pages"))
    links = often.filter(F.col("linked") > LINK_SHARE * F.col("chars")).groupBy("host").agg(F.array_sort(F.collect_list("token")).alias("link_slots"))
    held = often.filter("chars > 0 AND total = pages AND linked = 0").groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("token", "chars"))).alias("held"))
    parts = often.filter("chars = 0").groupBy("host", "vector", "pages", "total").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("members")).filter(F.size("members") >= LEAST_TOKENS)
    rank = F.struct((F.col("total") != F.col("pages")).alias("many"), (-F.col("pages")).alias("p"), (-F.size("members")).alias("s"), "vector", "members")
    listed = parts.groupBy("host").agg(F.array_sort(F.collect_list(rank)).alias("classes"))
    # the root is class 0, if there is a class of one place a page
    shift = F.when(F.element_at("classes", 1)["many"], 1).otherwise(0)
    tokens = F.flatten(F.transform("classes", lambda c, i: F.transform(c["members"], lambda m, j: F.struct((i + shift).cast("int").alias("class"), j.cast("int").alias("place"), m["token"].alias("token")))))
    return listed.select("host", tokens.cast(TEMPLATE).alias("tokens")).join(links, "host", "full").join(held, "host", "full")


class Template:
    """The classes of a host's template: their tokens in order."""

    def __init__(self, tokens=(), link_slots=(), held=()):
        self.held = dict(held or ())
        self.classes: dict[int, list[int]] = defaultdict(list)
        for t in tokens or ():
            self.classes[t["class"]].append(t["token"])
        self.link_slots = set(link_slots or ())

    def valid_tokens(self, blocks: list[Block], tokens: list[str]) -> set[int]:
        """Tokens of the classes that the page has in order, nested in one slot of the root."""
        places, out, root = token_places(blocks, tokens), set(), []
        for number, members in self.classes.items():
            first = [places[t][0] if t in places else None for t in members]
            if None in first or any(a >= b for a, b in zip(first, first[1:])):
                continue
            if number == 0:
                root = first
            elif root and len({bisect_left(root, at) for t in members for at in places[t]}) > 1:
                continue
            out.update(members)
        return out


    def slots(self, blocks: list[Block], marks: set[str]) -> set[str]:
        """The slots of a page that hold its host's main text; empty if the page isn't of the template.

        A slot that the page marks is taken whole, and one that holds a mark counts as a large one does.
        """
        inside: dict[str, set[str]] = defaultdict(set)
        for slot in held_by_slots(blocks):
            if slot:
                inside[slot.rpartition("/")[0]].add(slot)
        size = lambda slot: self.held.get(_hash("held", slot, ""), 0)
        at = ""
        while size(at):
            share = {slot: size(slot) for slot in inside[at]}
            own = size(at) - sum(share.values())
            most = max(own, *share.values()) if share else own
            large = {slot for slot, n in share.items() if n >= BESIDE * most or any(f"{m}/".startswith(f"{slot}/") for m in marks)}
            if at in marks or own >= BESIDE * most or not large:
                return {at}
            if len(large) > 1:
                return large
            at = large.pop()
        return set()


def marked(blocks: list[Block]) -> list[Block]:
    """The blocks of the page's marked article: of ``main`` and of articles but small ones; none if that is a teaser."""
    sizes: dict[int, int] = defaultdict(int)
    for b in blocks:
        sizes[b.article] += len(b.text)
    sizes.pop(0, None)
    most = max(sizes.values(), default=0)
    found = [b for b in blocks if (b.article or b.main) and (not b.article or sizes[b.article] >= BESIDE * most)]
    plain = lambda some: sum(len(b.text) - b.linked for b in some)
    return found if sum(len(b.text) for b in found) and plain(found) >= TEASER * plain(blocks) else []


def main_text(page: str, template: Template) -> str:
    """The text of the page's remaining slots, without what lies beside its marked article there."""
    blocks, tokens = parse(page)
    by_mark = marked(blocks)
    slots = template.slots(blocks, {b.mark for b in by_mark})
    inside = [b for b in blocks if any(b.slot == s or b.slot.startswith(s + "/") for s in slots)] if slots else blocks
    own = {id(b) for b in by_mark}
    if found := [b for b in inside if id(b) in own]:
        return "\n".join(b.text for b in found)
    known = template.valid_tokens(blocks, tokens) if template.classes else set()
    return "\n".join(b.text for b in inside if _hash("text", b.path, b.text) not in known and _hash("slot", b.path, "") not in template.link_slots and b.linked <= LINK_SHARE * len(b.text))


def extract(spark: SparkSession, pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    store = Scratch(spark, "html")
    made = store.save(templates(occurrences(copies_together(rows, store)), store), "templates")
    store.drop("again", "summed")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST.pattern, 1))
    size = made.agg(F.sum(F.coalesce(F.size("tokens"), F.lit(0)) * 2 + F.coalesce(F.size("link_slots"), F.lit(0)) + F.coalesce(F.size("held"), F.lit(0)) * 2)).first()[0] or 0
    small = size * 8 <= BROADCAST_BYTES and fits_broadcast(made, BROADCAST_BYTES, 100)
    joined = rows.withColumn("host", host).join(F.broadcast(made) if small else made, "host", "left").select("page_id", "url", "html", "host", "tokens", "link_slots", "held")
    schema = StructType([*rows.schema.fields[:2], StructField("text", StringType()), StructField("n_chars", LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        last, template = None, Template()
        for batch in batches:
            texts = []
            for i, (page, name) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if name != last:
                    last, template = name, Template(*(batch.column(k)[i].as_py() for k in (4, 5, 6)))
                texts.append(main_text(page or "", template))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=arrow)

    return joined.mapInArrow(run, schema)
