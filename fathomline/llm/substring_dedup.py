"""Repeated passages across documents by collinear chaining of shared seeds.

Seeds are k-mers of words, thinned to the minimizers of windows of ``WINDOW`` k-mers, so any
``K + WINDOW - 1`` equal words share a seed; a long run of one word has seeds of its own. Seeds are packed by bucket as in a join; every
occurrence is anchored to the seed's first document (smallest id), so a passage of n documents makes n - 1
anchors for each seed and not all pairs. A task that holds a seed very often anchors those
occurrences itself and sends on those of its own first document alone.

Anchors come together by document. For each (document, earlier document) equal diagonals are
joined into runs, and runs are chained: the best chain that ends in a run is found by a prefix maximum in
a Fenwick tree over the partner's positions, with a gap cost for each word that is left out on
either side. Chains long enough to matter are aligned on the words of both texts: ends grow while
words agree, over replaced ones as well, and gaps are aligned by edit distance. A document's aligned stretches
(against any earlier documents) that touch or overlap are one passage; those of ``LEAST_WORDS`` words or
more, at ``IDENTITY`` or more, are returned. The first document keeps its passage.

Seeds are exact, so recall falls with the share of replaced words: of a hundred planted passages of 120 words all are found with 10 of 100 words
replaced at random, and 88 with 15. A gap of more than
``ALIGN_MOST`` words between two stretches isn't looked into: they are two passages if each is long enough.

Exact copies are found by the hash of their words first; the smallest id of each such group
in a task is seeded, in whatever order they are read, and the rest repeat it as a whole.

Defined cases: null and empty texts, and those of fewer words than a passage, have none; a null
doc_id has none; repeated rows of one doc_id are one document, which doesn't repeat itself; repeats
inside one document alone are not returned; ties go to the smaller id and position; other columns are ignored
(``repeats``) or passed on (``remove``).
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from fathomline.llm.arrowmap import add_struct, pack_texts, tidy, unpack_texts
from fathomline.llm.frames import partitions
from fathomline.llm.textkit import SPACE_WORDS, U64, Words, mix, row_sums, slices, text_bytes, window_hashes
from fathomline.scratch import Scratch

K = 6
WINDOW = 8
LEAST_WORDS = 50
IDENTITY = 0.8
#: Cost of a word that a chain leaves out on one side; a matched word is worth 1.
GAP_COST = 0.15
#: Words between two runs that alignment still looks into.
ALIGN_MOST = 64
#: Cost of a word that is replaced beyond a chain's end, so that growth keeps ``IDENTITY``; and how far growth may fall behind its best.
REPLACED, DROP = 4, 32
#: Words that growth may add to a chain, for which chains are kept that are shorter than a passage.
GROWN = 20
HELD = 1 << 21
#: Occurrences of one seed that a task sends on; with more it anchors them itself, but for those of the seed's first document in the task.
LOCAL_MOST = 64


def seeds(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word in the row and hash of each minimizer; a run of one k-mer is one seed, with more of other keys if it is long."""
    counts = words.counts()
    every = window_hashes(words.hash, K)
    rows = np.repeat(np.arange(len(counts)), counts)[: len(every)]
    place = np.arange(len(every)) - words.first[rows]
    ok = place + K <= counts[rows]
    index = np.flatnonzero(ok)
    if not len(index):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    h, r = every[index], rows[index]
    order = mix(h.copy())  # minima of a second hash, so that keys stay evenly spread
    low = order.copy()
    chosen = np.zeros(len(h), bool)
    if len(h) >= WINDOW:
        low = np.lib.stride_tricks.sliding_window_view(order, WINDOW)
        at = low.argmin(axis=1) + np.arange(len(low))
        whole = r[: len(low)] == r[WINDOW - 1 :]
        chosen[at[whole]] = True
    per_row = np.bincount(r, minlength=len(counts))
    first = np.concatenate(([0], np.cumsum(per_row)))
    for row in np.flatnonzero((per_row > 0) & (per_row < WINDOW)).tolist():  # too short for a window
        a, b = first[row], first[row + 1]
        chosen[a + int(order[a:b].argmin())] = True
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    chosen &= ~same
    row, at, key = r[chosen], place[index][chosen], h[chosen]
    begins = np.flatnonzero(~same)
    length = np.diff(np.append(begins, len(h)))
    long = np.flatnonzero(length > WINDOW)
    if not len(long):
        return row, at, key
    more = [(b, *_run_seeds(n + K - 1)) for b, n in zip(begins[long].tolist(), length[long].tolist())]
    of = np.repeat([b for b, _, _ in more], [len(p) for _, p, _ in more])
    extra = mix(h[of] ^ mix(np.concatenate([k for _, _, k in more])))
    return np.concatenate([row, r[of]]), np.concatenate([at, place[index][of] + np.concatenate([p for _, p, _ in more])]), np.concatenate([key, extra])


def _run_seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and kinds of the further seeds of a run of one word ``n`` times, which lie at most WINDOW apart.

    The k-th from the run's start and the k-th from its end meet in all runs that are long enough to have them; so anchors cover
    what two runs share, seen from either end. A run as long as a passage is cut into pieces of that length, which meet those of any other.
    """
    near = np.arange(0, min(n, LEAST_WORDS) - K + 1, WINDOW)
    at, kind = [near, n - K - near], [near + 1, near + 1001]
    if n >= LEAST_WORDS:
        inside = np.append(np.arange(0, LEAST_WORDS - K, WINDOW), LEAST_WORDS - K)
        pieces = np.append(np.arange(0, n - LEAST_WORDS, LEAST_WORDS), n - LEAST_WORDS)
        at.append((pieces[:, None] + inside).ravel())
        kind.append(np.tile(inside + 2001, len(pieces)))
    return np.concatenate(at), np.concatenate(kind).astype(U64)


def leaders(doc: np.ndarray, pos: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts occurrences by (key, doc, pos); returns that order, each one's group, and each group's first."""
    order = np.lexsort((pos, doc, key))
    k = key[order]
    begin = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(k))))
    return order, group, begin


PACKED = StructType([StructField("kind", IntegerType()), StructField("bucket", IntegerType())] + [StructField(c, BinaryType()) for c in ("a", "b", "c", "d")])


def _rows_by_bucket(kind: int, bucket: np.ndarray, columns: list[np.ndarray], arrow: pa.Schema) -> pa.RecordBatch | None:
    """Arrays cut by bucket, a row each."""
    order = np.argsort(bucket, kind="stable")
    names, begin = np.unique(bucket[order], return_index=True)
    ends = np.append(begin[1:], len(order))
    cut = [[c[order[s:e]].tobytes() for s, e in zip(begin.tolist(), ends.tolist())] for c in columns]
    n = len(names)
    body = [pa.array(np.full(n, kind, np.int32)), pa.array(names.astype(np.int32)), *[pa.array(c, pa.binary()) for c in cut], *[pa.nulls(n, pa.binary())] * (4 - len(cut))]
    return pa.RecordBatch.from_arrays(body, schema=arrow) if n else None


def _doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc.astype(U64)) % U64(buckets)).astype(np.int32)


def _seeded(rows: DataFrame, buckets: int) -> DataFrame:
    """kind 0: seeds by bucket of key (doc, pos, key); 1: anchors by bucket of document (doc, pos, partner, partner's pos); 2: exact copies (doc, first, words)."""
    arrow = to_arrow_schema(PACKED)

    def run(batches):
        seen: dict[tuple[int, int], int] = {}  # the group of each text
        smallest: list[int] = []  # of each group: its smallest id, and the flush that its seeds go with
        flushed: list[int] = []
        held: list[list[np.ndarray]] = [[], [], []]
        copies: list[tuple[int, int, int]] = []
        size = flushes = 0

        def flush():
            member, pos, key = (np.concatenate(x) for x in held)
            doc = np.array(smallest, np.int64)[member]
            order, group, begin = leaders(doc, pos, key)
            doc, pos, key = doc[order], pos[order], key[order]
            often = np.bincount(group, minlength=len(begin))[group] > LOCAL_MOST
            first = begin[group]
            anchor = often & (doc != doc[first])
            if (out := _rows_by_bucket(1, _doc_bucket(doc[anchor], buckets), [doc[anchor], pos[anchor].astype(np.int32), doc[first[anchor]], pos[first[anchor]].astype(np.int32)], arrow)) is not None:
                yield out
            send = ~often | (doc == doc[first])
            doc, pos, key = doc[send], pos[send], key[send]
            if (out := _rows_by_bucket(0, (key % U64(buckets)).astype(np.int32), [doc, pos.astype(np.int32), key], arrow)) is not None:
                yield out

        for batch in batches:
            valid = np.asarray(batch.column(0).is_valid())
            ids = np.asarray(batch.column(0).fill_null(0))
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets):
                base = offsets[a]
                words = Words(data[base : offsets[b]], offsets[a : b + 1] - base, SPACE_WORDS)
                counts = words.counts()
                place = np.arange(len(words.hash)) - np.repeat(words.first[:-1], counts)
                salted = mix(words.hash + place.astype(U64) * U64(0x9E3779B97F4A7C15))
                high, low = row_sums(salted, words.first), row_sums(mix(salted), words.first)
                fresh = np.zeros(b - a, bool)
                groups = np.zeros(b - a, np.int64)
                for i in np.flatnonzero(valid[a:b] & (counts >= K)).tolist():
                    doc = int(ids[a + i])
                    group = groups[i] = seen.setdefault((int(high[i]), int(low[i])), len(smallest))
                    if group == len(smallest):
                        smallest.append(doc)
                        flushed.append(flushes)
                        fresh[i] = True
                    elif doc != smallest[group]:
                        if counts[i] >= LEAST_WORDS:
                            copies.append((max(doc, smallest[group]), group, int(counts[i])))
                        if doc < smallest[group]:  # equal texts have equal seeds: those held are of the smaller id from now on
                            smallest[group] = doc
                            fresh[i] = flushed[group] != flushes
                            flushed[group] = flushes
                row, pos, key = seeds(words)
                use = fresh[row]
                for to, x in zip(held, (groups[row[use]], pos[use], key[use])):
                    to.append(x)
                size += int(use.sum())
                if size >= HELD:
                    yield from flush()
                    held, size, flushes = [[], [], []], 0, flushes + 1
        if size:
            yield from flush()
        if copies:
            table = np.array(copies, np.int64)
            table[:, 1] = np.array(smallest, np.int64)[table[:, 1]]
            yield _rows_by_bucket(2, np.zeros(len(table), np.int32), [table[:, 0], table[:, 1], table[:, 2]], arrow)

    return rows.mapInArrow(tidy(run), PACKED)


#: Seeds or anchors of one bucket, on average at most.
BUCKET_MOST = 1 << 21


def _buckets_for(seeded: DataFrame, buckets: int) -> int:
    """As many buckets as the seeds ask for: the given ones, each cut into equally many where they hold too much."""
    held = seeded.filter("kind < 2").agg(F.sum(F.octet_length("a"))).first()[0] or 0
    return buckets * max(1, -(-held // (8 * BUCKET_MOST * buckets)))


def _dealt(table: DataFrame, buckets: int, many: int) -> DataFrame:
    """Rows of one kind in ``many`` buckets, a multiple of those that they are in, a bucket in one task."""
    parts = max(partitions(table.sparkSession), many // 4)
    if many == buckets:
        return table.repartition(parts, "bucket").sortWithinPartitions("bucket")
    arrow = to_arrow_schema(PACKED)

    def run(batches):
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(6))):
                kind = row[0].as_py()
                arrays = [np.frombuffer(x.as_buffer(), t) for x, t in zip(row[2:], _TYPES[kind])]
                bucket = (arrays[2] % U64(many)).astype(np.int32) if kind == 0 else _doc_bucket(arrays[0], many)
                yield _rows_by_bucket(kind, bucket, arrays, arrow)

    return table.mapInArrow(tidy(run), PACKED).repartition(parts, "bucket").sortWithinPartitions("bucket")


_TYPES = {0: (np.int64, np.int32, U64), 1: (np.int64, np.int32, np.int64, np.int32)}


def _by_bucket(batches, work):
    """Calls ``work`` with the concatenated arrays of each bucket; rows come sorted by bucket."""
    types, bucket, held = None, None, []

    def done():
        parts = list(zip(*held))
        return work([np.concatenate([np.frombuffer(x, t) for x in p]) for p, t in zip(parts, types)])

    for batch in batches:
        for row in zip(*(batch.column(i) for i in range(batch.num_columns))):
            types = types or _TYPES[row[0].as_py()]
            if held and row[1].as_py() != bucket:
                yield from done()
                held = []
            bucket = row[1].as_py()
            held.append([x.as_buffer() for x in row[2 : 2 + len(types)]])
    if held:
        yield from done()


def _anchored(seeded: DataFrame, buckets: int, many: int) -> DataFrame:
    """Anchors of every seed's occurrences to its first document, by bucket of document, of which there are ``many``."""
    arrow = to_arrow_schema(PACKED)

    def work(arrays):
        doc, pos, key = arrays
        order, group, begin = leaders(doc, pos, key)
        doc, pos = doc[order], pos[order]
        first = begin[group]
        keep = doc != doc[first]
        out = _rows_by_bucket(1, _doc_bucket(doc[keep], many), [doc[keep], pos[keep], doc[first[keep]], pos[first[keep]]], arrow)
        if out is not None:
            yield out

    return _dealt(seeded.filter("kind = 0"), buckets, many).mapInArrow(lambda batches: _by_bucket(batches, work), PACKED)


# ---- chaining -----------------------------------------------------------------------


class Fenwick:
    """Prefix maxima of (value, index)."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(-1e18, -1)] * (n + 1)

    def put(self, at: int, value: tuple[float, int]) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at]:
                self.best[at] = value
            at += at & -at

    def most(self, until: int) -> tuple[float, int]:
        """The maximum over places before ``until``."""
        out = (-1e18, -1)
        while until > 0:
            out = max(out, self.best[until])
            until -= until & -until
        return out


def runs_of(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """Anchors of one diagonal that overlap or touch, joined: (x, y, words)."""
    order = np.lexsort((x, x - y))
    x, y = x[order], y[order]
    diagonal = x - y
    new = np.ones(len(x), bool)
    new[1:] = (diagonal[1:] != diagonal[:-1]) | (x[1:] > x[:-1] + K)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(x)) - 1
    return sorted(zip(x[begin].tolist(), y[begin].tolist(), (x[last] - x[begin] + K).tolist()))


def chains(runs: list[tuple[int, int, int]], least: int) -> list[list[tuple[int, int, int]]]:
    """Collinear chains of runs, best first, each run in one chain, of at least ``least`` matched or bridged words.

    One pass finds the best chain that ends in each run. Chains are then taken by score; one that meets a run of a better chain begins
    after it. So n runs take n log n steps, also if none of them can follow another.
    """
    runs = sorted(runs)
    ends = sorted({y + n for _, y, n in runs})
    rank = {y: i for i, y in enumerate(ends)}
    tree, score, back = Fenwick(len(ends)), [0.0] * len(runs), [-1] * len(runs)
    # a run may follow those that end before it begins on both sides
    waiting = sorted(range(len(runs)), key=lambda i: (runs[i][0] + runs[i][2], i))
    done = 0
    for i, (x, y, n) in enumerate(runs):
        while done < len(waiting) and runs[waiting[done]][0] + runs[waiting[done]][2] <= x:
            j = waiting[done]
            px, py, pn = runs[j]
            tree.put(rank[py + pn], (score[j] + GAP_COST * (px + py + 2 * pn), j))
            done += 1
        value, j = tree.most(bisect_right(ends, y))
        gain = value - GAP_COST * (x + y)
        score[i], back[i] = (n + gain, j) if j >= 0 and gain > 0 else (float(n), -1)
    taken, out = [False] * len(runs), []
    for at in sorted(range(len(runs)), key=lambda i: (-score[i], i)):
        chain = []
        while at >= 0 and not taken[at]:
            taken[at] = True
            chain.append(runs[at])
            at = back[at]
        if chain and chain[0][0] + chain[0][2] - chain[-1][0] >= least:
            out.append(chain[::-1])
    return out


CHAIN = StructType([StructField(c, LongType()) for c in ("doc_id", "partner")] + [StructField(c, ArrayType(ArrayType(IntegerType()))) for c in ("xs", "ys", "ns")])


def _chained(anchors: DataFrame, many: int) -> DataFrame:
    """A row for each document and partner with the chains in stretches that, with what seeding leaves out at the ends, are long enough for a passage."""
    arrow = to_arrow_schema(CHAIN)
    margin = 2 * (WINDOW - 1) + GROWN

    def work(arrays):
        doc, pos, partner, partner_pos = arrays
        order = np.lexsort((pos, partner, doc))
        doc, pos, partner, partner_pos = doc[order], pos[order].astype(np.int64), partner[order], partner_pos[order].astype(np.int64)
        cut = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (partner[1:] != partner[:-1]))))
        by_doc: dict[int, list] = defaultdict(list)
        rows = []

        def close(d):
            spans = sorted((c[0][0], c[-1][0] + c[-1][2], p, c) for p, c in by_doc.pop(d))
            kept, group, until = defaultdict(list), [], None
            for span in [*spans, None]:
                if group and (span is None or span[0] > until + margin):
                    if until - group[0][0] + margin >= LEAST_WORDS:
                        for _, _, p, c in group:
                            kept[p].append(c)
                    group, until = [], None
                if span is not None:
                    group.append(span)
                    until = max(until or 0, span[1])
            rows.extend((d, p, *([[r[k] for r in c] for c in cs] for k in range(3))) for p, cs in kept.items())

        last = None
        for s, e in zip(cut.tolist(), np.append(cut[1:], len(doc)).tolist()):
            d = int(doc[s])
            if last is not None and d != last:
                close(last)
            last = d
            by_doc[d] += [(int(partner[s]), c) for c in chains(runs_of(pos[s:e], partner_pos[s:e]), K)]
        if last is not None:
            close(last)
        for i in range(0, len(rows), 5000):
            columns = list(zip(*rows[i : i + 5000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return _dealt(anchors, many, many).mapInArrow(lambda batches: _by_bucket(batches, work), CHAIN)


# ---- alignment -------------------------------------------------------------------------


def edit_matches(a: list, b: list) -> tuple[int, int]:
    """Matches and columns of an alignment of two word lists by least edits."""
    if len(a) > ALIGN_MOST or len(b) > ALIGN_MOST or not a or not b:
        return 0, max(len(a), len(b))
    row = [(j, 0) for j in range(len(b) + 1)]  # (edits, -matches)
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], (i, 0)
        for j, y in enumerate(b, 1):
            over = row[j]
            row[j] = (before[0], before[1] - 1) if x == y else min((before[0] + 1, before[1]), (over[0] + 1, over[1]), (row[j - 1][0] + 1, row[j - 1][1]))
            before = over
    edits, matches = row[-1]
    return -matches, edits - matches


def align(a: list, b: list, chain: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Aligned stretches of a chain: (start, end, partner's start, matches, columns); cut where a gap doesn't align."""
    out = []
    x0, y0, n = chain[0]
    before, same = grow(a, b, x0 - 1, y0 - 1, -1)
    x, y, matches, columns, start, partner_start = x0 + n, y0 + n, n + same, n + before, x0 - before, y0 - before

    def extend(x, y):
        i = 0
        while x + i < len(a) and y + i < len(b) and a[x + i] == b[y + i]:
            i += 1
        return i

    for nx, ny, n in chain[1:]:
        more = extend(x, y)
        x, y, matches, columns = x + more, y + more, matches + more, columns + more
        if nx < x or ny < y:  # the extension ran into the next run
            skip = max(x - nx, y - ny)
            if skip >= n:
                continue
            nx, ny, n = nx + skip, ny + skip, n - skip
        got, wide = edit_matches(a[x:nx], b[y:ny])
        if wide > ALIGN_MOST or wide and matches + got < IDENTITY * (columns + wide):
            out.append((start, x, partner_start, matches, columns))
            while nx > x and ny > y and a[nx - 1] == b[ny - 1]:
                nx, ny, n = nx - 1, ny - 1, n + 1
            start, partner_start, matches, columns = nx, ny, n, n
        else:
            matches, columns = matches + got + n, columns + wide + n
        x, y = nx + n, ny + n
    more, same = grow(a, b, x, y, 1)
    out.append((start, x + more, partner_start, matches + same, columns + more))
    return out


def grow(a: list, b: list, x: int, y: int, step: int) -> tuple[int, int]:
    """How far a stretch grows word by word from its end, and how many of those words agree.

    It may grow over words that were replaced, as long as what agrees behind them makes up for them at ``IDENTITY``, and ends where it has fallen ``DROP`` behind its best.
    """
    length = matches = score = best = 0
    grown = (0, 0)
    while 0 <= x < len(a) and 0 <= y < len(b) and score > best - DROP:
        length += 1
        if a[x] == b[y]:
            matches, score = matches + 1, score + 1
            if score > best:
                best, grown = score, (length, matches)
        else:
            score -= REPLACED
        x, y = x + step, y + step
    return grown


#: A document's stretches against one partner.
STRETCHES = StructType([StructField("doc_id", LongType()), StructField("stretches", ArrayType(StructType([StructField(c, LongType()) for c in ("start", "end", "partner", "partner_start", "matches", "columns")])))])


def _words(column) -> list[np.ndarray]:
    data, offsets = text_bytes(column)
    out = []
    for a, b in slices(offsets):
        base = offsets[a]
        words = Words(data[base : offsets[b]], offsets[a : b + 1] - base, SPACE_WORDS)
        out += [words.hash[s:e] for s, e in zip(words.first[:-1].tolist(), words.first[1:].tolist())]
    return out


#: Documents that are aligned with one partner in one group, and rows of texts that are unpacked at once.
PARTNER_DOCS, READ_ROWS = 256, 16


def _aligned(chained: DataFrame, texts: DataFrame) -> DataFrame:
    """Aligned stretches of each document and partner.

    A partner's text goes before the documents that are aligned with it, once for each group of them, so
    it is neither repeated in rows nor unpacked again, and a partner of very many documents is spread over tasks.
    All wishes for a text are joined with the texts at once, so those cross the network once to be found.
    """
    arrow = to_arrow_schema(STRETCHES)
    pairs = chained.filter("doc_id <> partner")
    groups = pairs.groupBy("partner").agg(F.ceil(F.count(F.lit(1)) / PARTNER_DOCS).alias("groups"))
    own = pairs.join(groups, "partner").withColumn("salt", F.pmod(F.xxhash64("doc_id"), "groups")).drop("groups").withColumn("reads", F.col("doc_id"))
    lead = groups.select("partner", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("salt"), F.col("partner").alias("reads"))
    wanted = own.unionByName(lead, allowMissingColumns=True)
    rows = wanted.hint("merge").join(texts.withColumnRenamed("doc_id", "reads"), "reads").select("partner", "salt", "doc_id", "xs", "ys", "ns", "packed")
    dealt = rows.repartition(partitions(chained.sparkSession), "partner", "salt").sortWithinPartitions("partner", "salt", F.col("doc_id").asc_nulls_first())

    def run(batches):
        now, held = None, []
        for whole in batches:
            for at in range(0, whole.num_rows, READ_ROWS):
                batch = whole.slice(at, READ_ROWS)
                partners, salts, docs, xs, ys, ns = (batch.column(i).to_pylist() for i in range(6))
                ids, found = [], []
                for i, text in enumerate(_words(unpack_texts(batch.column(6)))):
                    if (partners[i], salts[i]) != now:
                        now, held = (partners[i], salts[i]), []
                    if docs[i] is None:  # an id may have two texts
                        held.append(text.tolist())
                        continue
                    own_words, mine = text.tolist(), []
                    for chain in zip(xs[i], ys[i], ns[i]):
                        runs = list(zip(*chain))
                        for other_words in held:
                            if runs[-1][0] + runs[-1][2] <= len(own_words) and runs[-1][1] + runs[-1][2] <= len(other_words):
                                mine += [dict(zip(_FIELDS, (start, end, partners[i], to, matches, columns))) for start, end, to, matches, columns in align(own_words, other_words, runs)]
                    ids.append(docs[i])
                    found.append(mine)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, arrow.field(1).type)], schema=arrow)

    return dealt.mapInArrow(tidy(run), STRETCHES)


_FIELDS = ("start", "end", "partner", "partner_start", "matches", "columns")
PASSAGE = StructType(
    [StructField(c, LongType()) for c in ("doc_id", "start_word", "end_word", "partner_id", "partner_start")] + [StructField("partners", ArrayType(LongType())), StructField("identity", DoubleType())]
)


def _passages(stretches: DataFrame) -> DataFrame:
    """Stretches of one document that touch or overlap, as passages. One document's rows are as many as its chains."""

    def step(acc, s):
        last = F.element_at(acc, -1)
        joined = F.struct(
            last["start"].alias("start"),
            F.greatest(last["end"], s["end"]).alias("end"),
            F.when(s["end"] - s["start"] > last["best_words"], s["partner"]).otherwise(last["partner"]).alias("partner"),
            F.when(s["end"] - s["start"] > last["best_words"], s["partner_start"]).otherwise(last["partner_start"]).alias("partner_start"),
            F.greatest(last["best_words"], s["end"] - s["start"]).alias("best_words"),
            F.array_union(last["partners"], F.array(s["partner"])).alias("partners"),
            (last["matches"] + s["matches"]).alias("matches"),
            (last["columns"] + s["columns"]).alias("columns"),
        )
        fresh = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["partner"].alias("partner"), s["partner_start"].alias("partner_start"), (s["end"] - s["start"]).alias("best_words"), F.array(s["partner"]).alias("partners"), s["matches"].alias("matches"), s["columns"].alias("columns"))
        touch = (F.size(acc) > 0) & (s["start"] <= F.try_element_at(acc, F.lit(-1))["end"])
        return F.when(touch, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(fresh)))

    item = "array<struct<start:bigint,end:bigint,partner:bigint,partner_start:bigint,best_words:bigint,partners:array<bigint>,matches:bigint,columns:bigint>>"
    grouped = stretches.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("stretches")))).alias("all"))
    joined = grouped.select("doc_id", F.explode(F.aggregate("all", F.array().cast(item), step)).alias("p"))
    return joined.filter(f"p.end - p.start >= {LEAST_WORDS} AND p.matches >= {IDENTITY} * p.columns").select(
        "doc_id",
        F.col("p.start").alias("start_word"),
        F.col("p.end").alias("end_word"),
        F.col("p.partner").alias("partner_id"),
        F.col("p.partner_start").alias("partner_start"),
        F.array_sort("p.partners").alias("partners"),
        (F.col("p.matches") / F.col("p.columns")).alias("identity"),
    )


def repeats(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each passage of a document that repeats an earlier document's (by id): words [start_word, end_word), the partner with the longest stretch, all partners, identity."""
    store = Scratch(spark, "substring")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    buckets = 4 * partitions(spark)
    seeded = store.settle(_seeded(rows, buckets), "seeded")
    many = _buckets_for(seeded, buckets)
    held_back = seeded.filter("kind = 1")  # anchored inside of tasks, in the first buckets
    anchors = _anchored(seeded, buckets, many).union(held_back if many == buckets else _dealt(held_back, buckets, many))
    chained = store.settle(_chained(anchors, many), "chained")
    copies = store.save(seeded.filter("kind = 2").mapInArrow(tidy(_copies), STRETCHES), "copies")
    store.drop("seeded")  # before texts take its place on the disks
    stretches = _aligned(chained, pack_texts(rows)).union(copies)
    found = store.save(_passages(stretches), "passages")
    store.drop("chained", "copies")
    return found


def _copies(batches):
    """Whole copies as stretches; of two equal documents the one of the larger id repeats the other."""
    arrow = to_arrow_schema(STRETCHES)
    for batch in batches:
        for row in zip(*(batch.column(i) for i in range(2, 5))):
            doc, first, n = (np.frombuffer(x.as_buffer(), np.int64) for x in row)
            late, early = np.maximum(doc, first), np.minimum(doc, first)
            whole = [[dict(zip(_FIELDS, (0, k, e, 0, k, k)))] for k, e in zip(n.tolist(), early.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(late), pa.array(whole, arrow.field(1).type)], schema=arrow)


CUT = StructType([StructField("text", StringType())])


def remove(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with all columns, without the repeated passages of their texts; a document of which no word is left goes.

    What is left is joined by one line break where a passage was cut out.
    """
    found = repeats(spark, docs, doc_id=doc_id, text=text, **options)
    spans = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_word", "end_word"))).alias("s"))
    name = "__cut"
    while name in docs.columns:
        name += "_"
    lists = spans.select(F.col("doc_id").alias(name + "id"), F.concat_ws(",", F.transform("s", lambda x: F.concat_ws("-", x["start_word"].cast("string"), x["end_word"].cast("string")))).alias(name))
    marked = docs.join(lists.hint("merge"), F.col(f"`{doc_id}`") == F.col(name + "id"), "left").drop(name + "id")
    body = F.concat(F.coalesce(name, F.lit("")), F.lit("\0"), F.coalesce(F.col(f"`{text}`"), F.lit("")))
    made, out = add_struct(marked.withColumn(name + "body", body), name + "body", lambda: _cut_column, CUT)
    left = made.filter(F.col(name).isNull() | F.col(out)["text"].isNotNull())
    return left.withColumn(text, F.when(F.col(name).isNull(), F.col(f"`{text}`")).otherwise(F.col(out)["text"])).select(*[F.col(f"`{c}`") for c in docs.columns])


def _cut_column(column):
    out = []
    for value in column.to_pylist():
        spans, _, text = value.partition("\0")
        if not spans:
            out.append(None)
            continue
        raw = text.encode()
        words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), SPACE_WORDS)
        parts, at = [], 0
        for span in spans.split(","):
            s, e = map(int, span.split("-"))
            parts.append(raw[at : words.start[s]].strip())
            at = int(words.end[e - 1])
        parts.append(raw[at:].strip())
        out.append(b"\n".join(p for p in parts if p).decode() or None)
    return [pa.array(out, pa.string())]
