"""Best-fit packing of documents into fixed-length sequences by length patterns.

Packing needs only the histogram of piece lengths, which has as many bins as a
sequence has tokens, however large the corpus. On the driver: patterns of one to
three lengths that fill a sequence exactly are enumerated, repeat counts are fitted
to the histogram by non-negative least squares (multiplicative updates), rounded,
and held to what the histogram still has; that is repeated on the rest while it
pays. What remains is packed best-fit, longest first, again on the histogram.

The plan is a bounded table of runs (length, first rank, count, first sequence,
offset). Each piece finds its place by its rank among pieces of its length: the rank
inside its input partition, counted while tokenizing, plus the pieces of that
length in earlier partitions. So no task ever holds all pieces of a length.

Defined cases: a null text is empty; an empty text is the closing id alone; repeated
rows are packed each; rows with a null id are packed like others; an empty table
gives no rows. Only documents longer than a sequence are cut. The partitions are those of
the scan of ``docs``, which must give the same rows when a task is run again, as a table does.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from fathomline.llm.arrowmap import tidy
from fathomline.scratch import Scratch

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
#: Third lengths of the enumerated patterns are multiples of capacity / THIRD_STEPS.
THIRD_STEPS = 64
FIT_ROUNDS = 6
FIT_STEPS = 150
_ENCODERS: dict[str, object] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoder(path: str):
    from fathomline.llm.bpe import Encoder

    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---- planning on the histogram -------------------------------------------------


def fill_patterns(histogram: np.ndarray) -> np.ndarray:
    """Rows of three lengths (0: none), descending, that sum to the capacity and occur in the histogram."""
    capacity = len(histogram) - 1
    has = histogram > 0
    has[0] = True
    step = max(1, capacity // THIRD_STEPS)
    thirds = np.arange(0, capacity // 3 + 1, step)
    a = np.arange(1, capacity + 1)
    a, c = (x.ravel() for x in np.meshgrid(a, thirds, indexing="ij"))
    b = capacity - a - c
    ok = (a >= b) & (b >= c) & (b >= 0)
    a, b, c = a[ok], b[ok], c[ok]
    ok = has[a] & has[b] & has[c]
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def fit_counts(histogram: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """Non-negative least squares: repeat counts whose lengths come close to the histogram."""
    size = len(histogram)
    h = histogram.astype(float)
    h[0] = 0
    used = patterns > 0
    gain = (h[patterns] * used).sum(axis=1)
    x = np.ones(len(patterns))
    for _ in range(FIT_STEPS):
        made = np.bincount(patterns.ravel(), weights=np.repeat(x, 3), minlength=size)
        x *= gain / np.maximum((made[patterns] * used).sum(axis=1), 1e-9)
    return x


def plan(histogram: np.ndarray) -> np.ndarray:
    """Runs (length, first rank, count, first sequence, offset) that place every piece of the histogram once."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    capacity = len(left) - 1
    chosen: list[tuple[tuple[int, ...], int]] = []
    for _ in range(FIT_ROUNDS):
        patterns = fill_patterns(left)
        if not len(patterns):
            break
        x = np.rint(fit_counts(left, patterns)).astype(np.int64)
        before = left.sum()
        for i in np.lexsort((np.arange(len(x)), -x))[: np.count_nonzero(x)].tolist():
            parts = tuple(p for p in patterns[i].tolist() if p)
            times = min(int(x[i]), *(int(left[p]) // parts.count(p) for p in parts))
            if times > 0:
                chosen.append((parts, times))
                for p in parts:
                    left[p] -= times
        if left.sum() > 0.98 * before:
            break
    chosen += best_fit(left, capacity)
    runs, rank, sequence = [], defaultdict(int), 0
    for parts, times in chosen:
        offset = 0
        for p in parts:
            runs.append((p, rank[p], times, sequence, offset))
            rank[p] += times
            offset += p
        sequence += times
    out = np.array(runs, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each length into the tightest open pattern that has room."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    spaces: list[int] = []

    def put(parts: tuple[int, ...], times: int, space: int) -> None:
        if space not in open_:
            insort(spaces, space)
        open_[space].append((parts, times))

    for length in range(capacity, 0, -1):
        count = int(left[length])
        while count:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                each = min(capacity // length, count)
                put((length,) * each, count // each, capacity - each * length)
                count -= count // each * each
                continue
            space = spaces[at]
            parts, times = open_[space].pop()
            if not open_[space]:
                del open_[space], spaces[at]
            each = min(space // length, count)
            taken = min(times, count // each)
            put(parts + (length,) * each, taken, space - each * length)
            if times > taken:
                put(parts, times - taken, space)
            count -= taken * each
    return [x for space in sorted(open_) for x in open_[space]]


# ---- pieces and places -----------------------------------------------------------

PIECE = [StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids_crc32", LongType()), StructField("part", LongType()), StructField("part_rank", LongType())]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The token pieces of every document, each with its rank among those of its length in its partition."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = StructType([rows.schema[0], *PIECE])
    arrow = to_arrow_schema(schema)

    def run(batches):
        encoder, part, seen = _encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for first, ids, offsets in encoder.encode(batch.column(1)):
                owner, number, starts, lengths, sums = [], [], [], [], []
                raw, closing = ids.astype("<u4").tobytes(), np.uint32(END_ID).astype("<u4").tobytes()
                for i, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    total = e - s + 1
                    for k, at in enumerate(range(0, total, capacity)):
                        until = min(at + capacity, total)
                        body = raw[4 * (s + at) : 4 * (s + min(until, total - 1))]
                        owner.append(first + i)
                        number.append(k)
                        starts.append(at)
                        lengths.append(until - at)
                        sums.append(zlib.crc32(body + closing if until == total else body))
                length = np.array(lengths, np.int64)
                order = np.argsort(length, kind="stable")
                values, begin, counts = np.unique(length[order], return_index=True, return_counts=True)
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - np.repeat(begin, counts) + np.repeat(seen[values], counts)
                seen[values] += counts
                columns = [batch.column(0).take(pa.array(owner, pa.int64())), number, starts, lengths, sums, np.full(len(length), part), rank]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return rows.mapInArrow(tidy(run), schema)


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    store = Scratch(spark, "packing")
    cut = store.save(pieces(docs, path or tokenizer_path(), capacity, doc_id, text), "pieces")
    counts = store.save(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row a length
        histogram[row["length"]] = row["n"]
    runs = plan(histogram)
    ahead = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("ahead"))
    ranked = cut.join(ahead, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("part_rank") + F.col("ahead")).alias("rank"))
    schema = StructType([*ranked.schema.fields[:5], StructField("sequence_id", LongType()), StructField("offset", LongType())])
    arrow = to_arrow_schema(schema)
    keys = runs[:, 0] << 44 | runs[:, 1]

    def place(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (3, 5))
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            made = [pa.array(runs[at, 3] + rank - runs[at, 1]), pa.array(runs[at, 4])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *made], schema=arrow)

    return ranked.mapInArrow(tidy(place), schema)
