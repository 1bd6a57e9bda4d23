"""Document fingerprints by locally consistent parsing.

A text is a sequence of code points. At each level runs of one symbol are named as
one, deterministic coin tossing turns the symbols into labels of a few values (each step
keeps the lowest bit in which a symbol differs from its left neighbour), phrases begin
at local maxima of the labels, and a phrase's name is a hash of its symbols. Where phrases
begin hangs on a handful of neighbours only, so equal substrings are cut and named alike
at any offset, but for a few phrases at their ends.

The fingerprint keeps, for each of ``LEVELS``, the number of phrases and a sketch of
the set of their names: ``BINS`` bins, each with 8 bits of the smallest name hashed
there. ``likeness`` compares two fingerprints at the coarsest level at which both
have ``LEAST`` phrases (else at the finest): from the sketches' resemblance it estimates
the share of the larger set of phrases that is in the other.

Defined cases: a null text is empty; equal texts have equal fingerprints and likeness 1,
empty ones too; an empty and another text have likeness 0; the next document of ``with_edited`` is
that of the next smaller id (ties by text; null ids last), after the last the first; a
table of one row is its own next; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from fathomline.llm.frames import partitions
from fathomline.llm.textkit import SHINGLE_MULT, U64, mix, slices

LEVELS = (1, 2, 3)
BINS = 64
LEAST = 8
COIN_STEPS = 4
_EMPTY_BIN = 0xFFFFFFFF
#: Code points that are parsed at once.
GROUP_CHARS = 1 << 18


def _collapse(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names runs of one symbol inside a row; returns symbols and their rows."""
    begins = np.empty(len(x), bool)
    begins[:1] = True
    np.not_equal(x[1:], x[:-1], out=begins[1:])
    begins[1:] |= rows[1:] != rows[:-1]
    at = np.flatnonzero(begins)
    if len(at) == len(x):
        return x, rows
    length = np.diff(np.append(at, len(x)))
    named = x[at]
    long_ = length > 1
    named[long_] = mix(named[long_] * SHINGLE_MULT[0] + length[long_].astype(U64) * SHINGLE_MULT[1])
    return named, rows[at]


def _coin(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels of few values in which neighbours differ; ``first`` marks the rows' first symbols."""
    label = x
    for _ in range(COIN_STEPS):
        left = np.empty_like(label)
        left[1:] = label[:-1]
        left[first] = ~label[first]
        differ = label ^ left
        low = differ & (~differ + U64(1))
        bit = np.bitwise_count(low - U64(1)).astype(U64)
        label = U64(2) * bit + ((label >> bit) & U64(1))
    return label


def parse_level(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of one level: names and their rows."""
    if not len(x):
        return x, rows
    x, rows = _collapse(x, rows)
    first = np.empty(len(x), bool)
    first[:1] = True
    np.not_equal(rows[1:], rows[:-1], out=first[1:])
    label = _coin(x, first)
    top = np.zeros(len(x), bool)
    top[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    top[:-1] &= ~first[1:]  # a row's last symbol begins no phrase, whatever row comes after it
    begins = top | first
    at = np.flatnonzero(begins)
    place = np.arange(len(x)) - np.repeat(at, np.diff(np.append(at, len(x))))
    names = np.add.reduceat((x + U64(1)) * SHINGLE_MULT[place & 63], at)
    return mix(names), rows[at]


def _sketches(names: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row its number of distinct-place phrases, and for each bin the smallest 32-bit rest of a name."""
    table = np.full(n * BINS, _EMPTY_BIN, np.uint32)
    spread = mix(names ^ U64(0xD6E8FEB86659FD93))
    cell = rows * BINS + (spread >> U64(58)).astype(np.int64)
    np.minimum.at(table, cell, np.minimum(spread & U64(0xFFFFFFFF), U64(_EMPTY_BIN - 1)).astype(np.uint32))
    return np.bincount(rows, minlength=n), table.reshape(n, BINS)


class Fingerprints:
    """Fingerprints of some texts: counts and sketches by level."""

    def __init__(self, texts: list[str]):
        n = len(texts)
        counts, sketches = np.zeros((len(LEVELS), n), np.int64), np.full((len(LEVELS), n, BINS), _EMPTY_BIN, np.uint32)
        sizes = np.zeros(n + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=sizes[1:])
        for a, b in slices(sizes, GROUP_CHARS):
            raw = "".join(texts[a:b]).encode("utf-32-le", "surrogatepass")
            x = np.frombuffer(raw, "<u4").astype(U64)
            rows = np.repeat(np.arange(b - a), np.diff(sizes[a : b + 1]))
            for level in range(1, max(LEVELS) + 1):
                x, rows = parse_level(x, rows)
                if level in LEVELS:
                    k = LEVELS.index(level)
                    counts[k, a:b], sketches[k, a:b] = _sketches(x, rows, b - a)
        self.counts, self.full = counts.T, sketches.transpose(1, 0, 2)
        self.used = self.full != _EMPTY_BIN
        self.bytes = np.where(self.used, (self.full >> np.uint32(8)) & np.uint32(0xFF), 0).astype(np.uint8)

    def texts(self) -> list[str]:
        """As text: for each level the count in 8 hex digits, the used bins in 16, then a byte for each bin."""
        out = []
        for counts, used, body in zip(self.counts, self.used, self.bytes):
            out.append("".join(f"{int(c):08x}{np.packbits(u).tobytes().hex()}{b.tobytes().hex()}" for c, u, b in zip(counts, used, body)))
        return out

    def likeness(self, other: "Fingerprints") -> np.ndarray:
        both = (self.counts >= LEAST) & (other.counts >= LEAST)
        level = np.where(both.any(axis=1), both.shape[1] - 1 - both[:, ::-1].argmax(axis=1), 0)
        at = np.arange(len(level))
        a, b, ua, ub = self.bytes[at, level], other.bytes[at, level], self.used[at, level], other.used[at, level]
        union = (ua | ub).sum(axis=1)
        same = (ua & ub & (a == b)).sum(axis=1)
        r = same / np.maximum(union, 1)
        chance = 1 / 256  # two different names agree in their byte
        r = np.clip((r - chance) / (1 - chance), 0, 1)
        ca, cb = self.counts[at, level], other.counts[at, level]
        share = r / (1 + r) * (ca + cb) / np.maximum(np.maximum(ca, cb), 1)
        share = np.where((ca == 0) & (cb == 0), 1.0, np.clip(share, 0, 1))
        equal = (self.counts == other.counts).all(axis=1) & (self.bytes == other.bytes).all(axis=(1, 2)) & (self.used == other.used).all(axis=(1, 2))
        return np.where(equal, 1.0, share)


def likeness(a: str, b: str) -> float:
    """The likeness of two fingerprints in their text form."""
    return float(_read(a).likeness(_read(b))[0])


def _read(text: str) -> Fingerprints:
    out = Fingerprints.__new__(Fingerprints)
    width = 8 + BINS // 4 + 2 * BINS
    parts = [text[i : i + width] for i in range(0, len(text), width)]
    out.counts = np.array([[int(p[:8], 16) for p in parts]])
    out.used = np.array([[np.unpackbits(np.frombuffer(bytes.fromhex(p[8 : 8 + BINS // 4]), np.uint8)).astype(bool) for p in parts]])
    out.bytes = np.array([[np.frombuffer(bytes.fromhex(p[8 + BINS // 4 :]), np.uint8) for p in parts]])
    return out


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the fingerprint of every row's text."""
    from fathomline.llm.arrowmap import map_text

    def make():
        return lambda column: [pa.array(Fingerprints([t or "" for t in column.to_pylist()]).texts(), pa.string())]

    return map_text(docs, text, make, StructType([StructField("fingerprint", StringType())]), list(keep))


# ---- each document beside its edited text and its next document -------------------------

EDITED = [
    StructField("n_chars", LongType()),
    StructField("edited_sha256", StringType()),
    StructField("fingerprint", StringType()),
    StructField("edited_fingerprint", StringType()),
    StructField("near_edited", DoubleType()),
    StructField("near_next", DoubleType()),
]
#: Bytes of text in a range of ids, on average at most.
RANGE_BYTES = 64 << 20
#: Rows whose fingerprints are made together.
GROUP_ROWS = 256


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following`` (or all of it)."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def with_edited(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts are dealt out once, by ranges of ids cut at quantiles, a partition each, so that every document is
    beside the next but for each range's last; for that the first document of the range after it is
    sent along. The cuts are ids of the table, so that document is known by its id alone.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63))).cast("long")  # null ids come last
    whole = rows.agg(F.max(key).alias("most"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if whole["most"] is None:
        return spark.createDataFrame([], StructType([rows.schema[0], *EDITED]))
    n = max(partitions(spark), -(-whole["bytes"] // RANGE_BYTES))
    shares = F.lit(np.arange(1, n + 1) / n)
    found = rows.agg(F.percentile_approx(key, shares, max(10_000, 4 * n)).alias("q")).first()["q"]
    cuts = np.array(sorted({*found, whole["most"]}), np.int64)

    @F.pandas_udf("array<int>")
    def ranges(keys: pd.Series) -> pd.Series:
        """The range of each id and, of a range's greatest id, the one whose last document it follows."""
        ids = keys.to_numpy(np.int64)
        at = np.searchsorted(cuts, ids)
        return pd.Series([[i, (i + 1) % len(cuts)] if lead else [i] for i, lead in zip(at.tolist(), (cuts[at] == ids).tolist())])

    dealt = rows.select("doc_id", "text", F.posexplode(ranges(key)).alias("halo", "chunk")).select("doc_id", "text", "chunk", "halo")
    dealt = dealt.repartitionById(len(cuts), "chunk").sortWithinPartitions("chunk", "halo", F.col("doc_id").desc_nulls_last(), "text")
    schema = StructType([rows.schema[0], *EDITED])
    arrow = to_arrow_schema(schema)

    def run(batches):
        held = None  # the last row seen, which waits for the next of its range
        for batch in batches:
            ids, texts, chunks, halos = (batch.column(i).to_pylist() for i in range(4))
            if held:
                ids, texts, chunks, halos = [held[0], *ids], [held[1], *texts], [held[2], *chunks], [held[3], *halos]
            held = ids[-1], texts[-1], chunks[-1], halos[-1]
            for s in range(0, len(ids) - 1, GROUP_ROWS):
                e = min(s + GROUP_ROWS, len(ids) - 1)
                use = [i for i in range(s, e) if not halos[i]]  # a range's last row is its halo
                own, after = Fingerprints(texts[s : e + 1]), [edited(texts[i], texts[i + 1]) for i in use]
                changed = Fingerprints(after)
                at = np.array(use, np.int64) - s
                mine, following = _pick(own, at), _pick(own, at + 1)
                columns = [
                    [ids[i] for i in use],
                    [len(texts[i]) for i in use],
                    [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in after],
                    mine.texts(),
                    changed.texts(),
                    mine.likeness(changed),
                    mine.likeness(following),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return dealt.mapInArrow(run, schema)


def _pick(f: Fingerprints, at: np.ndarray) -> Fingerprints:
    out = Fingerprints.__new__(Fingerprints)
    out.counts, out.used, out.bytes = f.counts[at], f.used[at], f.bytes[at]
    return out
