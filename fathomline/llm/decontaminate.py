"""Benchmark decontamination by a broadcast set of normalised n-grams.

Every run of ``n`` words of a benchmark item is a window (an item of fewer words,
but not none, is one window). The hashes of all windows go to the executors; each
document's words are rolled over them, every hit is compared word for word, and
the words inside any occurrence are marked.

The set is sent only up to ``BLOCK_WINDOWS`` windows. A larger benchmark is dealt
into blocks of that size, each block scans the documents, and the marks of the
blocks are united for each document, so any benchmark gives whole results.

Defined cases: a null or empty text has no words and no hits; an item without words
has no window; repeated items count once by id, and an item without an id is named
by the empty string; repeated documents each get their row; other columns of either
table are ignored (``scan``) or passed on (``remove``).
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from fathomline.llm.arrowmap import add_struct, map_text
from fathomline.llm.textkit import ALNUM_WORDS, SEPARATOR_BYTE, Words, slices, text_bytes, window_hashes

NGRAM = 10
#: Windows in one broadcast; with their words about 100 bytes each.
BLOCK_WINDOWS = 200_000
_SIEVE_BITS = 20


def item_words(text: str | None) -> list[bytes]:
    """The words of one text, as the scan sees them."""
    raw = (text or "").encode("utf-8", "replace")
    return [w for w in raw.translate(bytes(ALNUM_WORDS)).split(SEPARATOR_BYTE) if w]


def item_windows(items, n: int) -> dict[bytes, set[str]]:
    """The words of each window, joined by spaces, and the ids of the items that hold it."""
    windows: dict[bytes, set[str]] = defaultdict(set)
    for item_id, text in items:
        words = item_words(text)
        size = min(n, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows[b" ".join(words[i : i + size])].add("" if item_id is None else str(item_id))
    return windows


class WindowSet:
    """Hashes of windows by their number of words, and the windows themselves."""

    def __init__(self, windows: dict[bytes, set[str]]):
        self.items = {w: sorted(ids) for w, ids in windows.items()}
        by_size: dict[int, list[bytes]] = defaultdict(list)
        for w in self.items:
            by_size[w.count(b" ") + 1].append(w)
        self.hashes = {}
        for size, members in sorted(by_size.items()):
            data = np.frombuffer(b" ".join(members), np.uint8)
            hashes = window_hashes(Words(data, np.array([0, len(data)]), ALNUM_WORDS).hash, size)[::size]
            sieve = np.zeros(1 << _SIEVE_BITS, bool)
            sieve[hashes >> np.uint64(64 - _SIEVE_BITS)] = True
            self.hashes[size] = (np.unique(hashes), sieve)

    def occurrences(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, list[tuple[int, int, bytes]]]:
        """The words of some rows, and (first word, number of words, window) of each occurrence."""
        words, found = Words(data, offsets, ALNUM_WORDS), []
        for size, (known, sieve) in self.hashes.items():
            every = window_hashes(words.hash, size)
            maybe = np.flatnonzero(sieve[every >> np.uint64(64 - _SIEVE_BITS)])
            at = np.minimum(np.searchsorted(known, every[maybe]), len(known) - 1)
            maybe = maybe[known[at] == every[maybe]]
            row = np.searchsorted(words.first, maybe, side="right") - 1
            maybe = maybe[maybe + size <= words.first[row + 1]]
            for i in maybe.tolist():
                text = bytes(data[words.start[i] : words.end[i + size - 1]]).translate(bytes(ALNUM_WORDS))
                window = b" ".join(w for w in text.split(SEPARATOR_BYTE) if w)
                if window in self.items:
                    found.append((i, size, window))
        return words, found


RESULT = StructType(
    [
        StructField("n_words", LongType()),
        StructField("hit_starts", ArrayType(IntegerType())),
        StructField("hit_ends", ArrayType(IntegerType())),
        StructField("byte_starts", ArrayType(IntegerType())),
        StructField("byte_ends", ArrayType(IntegerType())),
        StructField("items", ArrayType(StringType())),
    ]
)


#: What blocks of windows find in a text is put together.
FOUND = ("hit_starts", "hit_ends", "items")


def _scanner(windows: WindowSet):
    """Makes the text function: for each row its number of words, its hit spans in words and bytes, and the items."""

    def make():
        def apply(column):
            data, offsets = text_bytes(column)
            out: list[list] = [[], [], [], [], [], []]
            for a, b in slices(offsets):
                base = offsets[a]
                words, found = windows.occurrences(data[base : offsets[b]], offsets[a : b + 1] - base)
                marks = np.zeros(len(words.hash) + 1, np.int32)
                items: dict[int, set[str]] = defaultdict(set)
                if found:
                    rows = np.searchsorted(words.first, [i for i, _, _ in found], side="right") - 1
                    for (i, size, window), row in zip(found, rows.tolist()):
                        marks[i] += 1
                        marks[i + size] -= 1
                        items[row].update(windows.items[window])
                hit = np.cumsum(marks[:-1]) > 0
                for row in range(b - a):
                    first, last = int(words.first[row]), int(words.first[row + 1])
                    out[0].append(last - first)
                    if row not in items:
                        for column_out in out[1:]:
                            column_out.append([])
                        continue
                    edge = np.diff(np.concatenate(([0], hit[first:last].astype(np.int8), [0])))
                    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    origin = int(offsets[a + row] - base)
                    for column_out, values in zip(out[1:], (starts, ends, words.start[first + starts] - origin, words.end[first + ends - 1] - origin)):
                        column_out.append(values.tolist())
                    out[5].append(sorted(items[row]))
            ints = pa.list_(pa.int32())
            return [pa.array(out[0], pa.int64()), *[pa.array(x, ints) for x in out[1:5]], pa.array(out[5], pa.list_(pa.string()))]

        return apply

    return make


def _blocks(benchmark: DataFrame, item_id: str, text: str, n: int, block_windows: int):
    """Window sets of the benchmark's items, of about ``block_windows`` windows each."""
    pending: list[tuple] = []
    size = 0
    for row in benchmark.select(F.col(f"`{item_id}`"), F.col(f"`{text}`")).toLocalIterator():
        count = max(1, len(item_words(row[1])) - n + 1)
        if pending and size + count > block_windows:
            yield WindowSet(item_windows(pending, n))
            pending, size = [], 0
        pending.append(tuple(row))
        size += count
    yield WindowSet(item_windows(pending, n))


def _union_spans(starts, ends, n_words):
    """Number of words in the union of spans given as two arrays."""
    spans = F.array_sort(F.arrays_zip(starts.alias("s"), ends.alias("e")))
    zero = F.struct(F.lit(0).cast("int").alias("to"), F.lit(0).cast("long").alias("n"))

    def step(acc, x):
        begin = F.greatest(x["s"], acc["to"])
        return F.struct(F.greatest(x["e"], acc["to"]).alias("to"), (acc["n"] + F.greatest(x["e"] - begin, F.lit(0))).cast("long").alias("n"))

    return F.aggregate(spans, zero, step)["n"]


def scan(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, items (sorted as strings), hit_starts, hit_ends (word spans).

    Each block of windows reads a text as the block before passed it on, in one task: one scan of the documents and no shuffle.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    sets = list(_blocks(benchmark, item_id, item_text, n, block_windows))  # as large as the benchmark
    for i, windows in enumerate(sets):
        text_on = ["text"] if i + 1 < len(sets) else []
        made = map_text(rows, "text", _scanner(windows), RESULT, ["doc_id", *text_on, *[f"before_{c}" for c in FOUND if i]])
        every = {c: F.concat(f"before_{c}", c) if i else F.col(c) for c in FOUND}
        every["items"] = F.array_sort(F.array_distinct(every["items"])) if i else every["items"]
        rows = made.select("doc_id", *text_on, "n_words", *[value.alias(f"before_{c}") for c, value in every.items()])
    found = rows.select("doc_id", "n_words", *[F.col(f"before_{c}").alias(c) for c in FOUND])
    return found.select("doc_id", "n_words", _union_spans(F.col("hit_starts"), F.col("hit_ends"), F.col("n_words")).alias("n_hit"), "items", "hit_starts", "hit_ends")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns of ``scan``'s rows."""
    return scanned.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, text: str = "text", item_id: str = "item_id", item_text: str = "text", spans_only: bool = False, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` without its contaminated rows or, with ``spans_only``, without the hit passages of their texts.

    All columns are passed on. A text that loses passages keeps the rest, byte for byte.
    """
    kept = docs
    for windows in _blocks(benchmark, item_id, item_text, n, block_windows):
        made, name = add_struct(kept, text, _scanner(windows), RESULT)
        hits = F.size(F.col(name)["items"]) > 0
        if not spans_only:
            kept = made.filter(~hits).drop(name)
            continue
        raw = F.encode(F.col(f"`{text}`"), "UTF-8")
        begins = F.concat(F.array(F.lit(0)), F.col(name)["byte_ends"])
        ends = F.concat(F.col(name)["byte_starts"], F.array(F.octet_length(raw)))
        left = F.array_join(F.zip_with(begins, ends, lambda a, b: F.decode(F.substring(raw, a + 1, b - a), "UTF-8")), "")
        kept = made.withColumn(text, F.when(hits, left).otherwise(F.col(f"`{text}`"))).drop(name)
    return kept
