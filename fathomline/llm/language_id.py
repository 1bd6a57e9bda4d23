"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its subwords, the byte n-grams of
``ORDERS`` over its lower-cased UTF-8 bytes, hashed into ``BUCKETS`` rows; a linear softmax
reads that mean. Embeddings and softmax are trained together in numpy, in one task, by
stochastic gradient descent on a bounded sample of labelled rows (the driver gets their hashes and the model alone): on each whole text, as the counts of its subwords by bucket, of which there are
no more than ``BUCKETS`` however long it is, and on passages, drawn anew for each epoch from all of the text by the task that reads it. A temperature and a rejection threshold are
then fitted on the whole texts of sampled rows that training left out, so that the score is a
calibrated probability.

Since the softmax is linear, embeddings times weights is one table of bucket by
language; a prediction is the mean of that table's rows over all subwords of the whole
text. The table (``BUCKETS`` x languages, float32) is all that executors get.

Defined cases: a null text or one without a letter is ``und`` with score 0; labels
that are null are never learned from; without any labelled row everything is
``und``; ties between languages go to the first in alphabetical order; repeated
rows get the same answer; the language, source and id columns are never inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, StringType, StructField, StructType

from fathomline.llm.arrowmap import add_struct, map_text, tidy
from fathomline.llm.textkit import SLICE_BYTES, slices, text_bytes

ORDERS = (2, 3, 4)
BUCKETS = 1 << 15
DIM = 16
#: The bounded sample of labelled rows that training and calibration read.
SAMPLE_ROWS = 3000
PASSAGE_BYTES = 300
#: Passages of a sampled text that one epoch trains on beside the whole text.
PASSAGES = 4
EPOCHS = 3
#: A small sample's epochs are gone over again until so many steps are done.
LEAST_STEPS = 12_000
RATE = 0.5
#: Share of the calibration rows, rightly named, that rejection may cost at most.
REJECT_QUANTILE = 0.0005
UNKNOWN = "und"
RESULT = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
_SAMPLED = StructType([StructField("pieces", ArrayType(BinaryType())), StructField("buckets", BinaryType()), StructField("shares", BinaryType())])
_MODEL = "languages array<string>, table binary, temperature double, threshold double"


def has_letter(text: str) -> bool:
    """Letters are of a Unicode category L: superscripts, fractions and Roman numerals are none."""
    return any(map(str.isalpha, text))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def subwords(data: np.ndarray) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram that begins at each byte."""
    low = _LOWER[data].astype(np.uint32)
    gram, out = low, []
    for n in range(2, max(ORDERS) + 1):
        if len(gram) < 2:
            break
        gram = (gram[:-1] << np.uint32(8)) | low[n - 1 :]
        if n in ORDERS:
            spread = (gram + np.uint32(n)) * np.uint32(0x9E3779B1)
            spread ^= spread >> np.uint32(15)
            out.append(((spread * np.uint32(0x85EBCA77)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32))
    return out


@dataclass(frozen=True)
class Model:
    """Languages in alphabetical order, the table of bucket by language, and the calibration."""

    languages: tuple[str, ...]
    table: np.ndarray
    temperature: float
    threshold: float

    def means(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The mean of the table's rows over the subwords of each row of text."""
        total = np.zeros((len(offsets) - 1, len(self.languages)), np.float32)
        counts = np.zeros(len(offsets) - 1)
        ones = np.ones(int(np.diff(offsets).max(initial=0)), np.float32)
        for n, grams in zip(ORDERS, subwords(data)):
            ends = np.maximum(offsets[1:] - n + 1, offsets[:-1]).clip(max=len(grams))
            starts = np.minimum(offsets[:-1], ends)
            rows = np.take(self.table, grams, axis=0, mode="clip")
            for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
                total[i] += ones[: e - s] @ rows[s:e]
            counts += ends - starts
        return total / np.maximum(counts, 1)[:, None]

    def probabilities(self, means: np.ndarray) -> np.ndarray:
        logits = means * self.temperature
        logits -= logits.max(axis=1, keepdims=True)
        odds = np.exp(logits)
        return odds / odds.sum(axis=1, keepdims=True)


def _passages(text: str, seed: int) -> list[bytes]:
    """``PASSAGES`` of the passages of a text for each epoch, drawn anew from anywhere in it; all of a text that has no more."""
    raw = text.encode("utf-8", "replace")
    n = -(-len(raw) // PASSAGE_BYTES)
    rng = np.random.Generator(np.random.PCG64(seed & (1 << 64) - 1))
    drawn = np.concatenate([rng.choice(n, min(n, PASSAGES), replace=False) for _ in range(EPOCHS)])
    return [raw[i * PASSAGE_BYTES : (i + 1) * PASSAGE_BYTES] for i in drawn.tolist()]


def whole_text(text: str) -> tuple[bytes, bytes]:
    """The buckets of a text's subwords and their shares, counted in slices."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.zeros(BUCKETS)
    for at in range(0, len(raw), SLICE_BYTES):
        # a slice begins with the bytes that n-grams across its edge need; those that lie before the edge are counted once
        for n, grams in zip(ORDERS, subwords(raw[max(0, at - n_before(at)) : at + SLICE_BYTES])):
            counts += np.bincount(grams[max(0, n_before(at) - n + 1) :], minlength=BUCKETS)
    buckets = np.flatnonzero(counts)
    return buckets.astype(np.uint16).tobytes(), (counts[buckets] / max(counts.sum(), 1)).astype(np.float32).tobytes()


def n_before(at: int) -> int:
    return min(at, max(ORDERS) - 1)


#: What a sampled row brings: its passages by epoch, and the buckets and shares of its whole text.
Sampled = tuple[list[bytes], bytes, bytes]


def _learned(buckets: bytes, shares: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(buckets, np.uint16).astype(np.int64), np.frombuffer(shares, np.float32)


def _counted(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a passage's subwords, and their shares."""
    grams = subwords(np.frombuffer(piece, np.uint8))
    buckets, n = np.unique(np.concatenate(grams) if grams else np.zeros(0, np.int32), return_counts=True)
    return buckets, (n / max(n.sum(), 1)).astype(np.float32)


def fit(rows: list[tuple[Sampled, str]], languages: tuple[str, ...], seed: int = 5) -> np.ndarray:
    """The table of bucket by language, trained on (passages and whole text, language) pairs."""
    rng = np.random.Generator(np.random.PCG64(seed))
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(languages)), np.float32)
    # What is learned from is kept as it came, and taken apart when its turn comes: of each row its whole text (None), and an epoch's passages.
    order: list[list[tuple[int, int | None]]] = [[] for _ in range(EPOCHS)]
    for r, ((pieces, _, _), _) in enumerate(rows):
        each = len(pieces) // EPOCHS
        for e, items in enumerate(order):
            items += [(r, None), *((r, i) for i in range(e * each, (e + 1) * each))]
    once = max(1, sum(map(len, order)))
    order *= -(-LEAST_STEPS // once)
    steps, step = once * len(order) // EPOCHS, 0
    for items in order:
        for at in rng.permutation(len(items)):
            (pieces, held, shared), g = rows[items[at][0]]
            buckets, shares = _learned(held, shared) if items[at][1] is None else _counted(pieces[items[at][1]])
            rate, label = RATE * (1 - step / steps), languages.index(g)
            step += 1
            if not len(buckets):
                continue
            mean = shares @ emb[buckets]
            logits = mean @ out
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            emb[buckets] -= np.outer(rate * shares, back)
    return np.ascontiguousarray(emb @ out, np.float32)


def calibrate(languages: tuple[str, ...], table: np.ndarray, means: np.ndarray, labels: np.ndarray) -> Model:
    """The model with the temperature and threshold that suit these means of whole texts."""
    at = np.arange(len(labels))
    losses = {t: -np.log(np.maximum(Model(languages, table, t, 0).probabilities(means)[at, labels], 1e-9)).mean() for t in np.geomspace(0.25, 16, 25)}
    temperature = float(min(losses, key=losses.get))
    p = Model(languages, table, temperature, 0.0).probabilities(means)
    right = p.max(axis=1)[p.argmax(axis=1) == labels]
    floor = 1.05 / len(languages) if len(languages) > 1 else 0.0
    threshold = max(floor, min(0.4, float(np.quantile(right, REJECT_QUANTILE)) * 0.9)) if len(right) else floor
    return Model(languages, table, temperature, threshold)


def _drawer():
    def apply(column):
        hashes, texts = column.field(0).to_pylist(), column.field(1).to_pylist()
        made = [(_passages(t, h), *whole_text(t)) if has_letter(t) else ([], b"", b"") for h, t in zip(hashes, texts)]
        return [pa.array([m[0] for m in made], pa.list_(pa.binary())), *(pa.array([m[i] for m in made], pa.binary()) for i in (1, 2))]

    return apply


def _trainer(held: set[int]):
    """The model of a sample's rows (hash, language, and what was drawn of the text), as one row; those of the hashes ``held`` are for calibration."""

    def run(batches):
        found: dict[tuple[int, str], Sampled] = {}
        for batch in batches:
            for h, g, *sampled in zip(*(c.to_pylist() for c in batch.columns)):
                if sampled[0] and g:
                    found[h, g] = tuple(sampled)
        if not found:
            return
        rows = [(k[0] in held, sampled, k[1]) for k, sampled in sorted(found.items())]
        languages = tuple(sorted({g for _, _, g in rows}))
        table = fit([(p, g) for out, p, g in rows if not out] or [(p, g) for _, p, g in rows], languages)
        kept = [(p, g) for out, p, g in rows if out] or [(p, g) for _, p, g in rows]
        means = np.array([shares @ table[buckets] for (_, *whole), _ in kept for buckets, shares in [_learned(*whole)]])
        model = calibrate(languages, table, means, np.array([languages.index(g) for _, g in kept]))
        yield pa.RecordBatch.from_pydict({"languages": [list(languages)], "table": pa.array([table.tobytes()], pa.binary()), "temperature": [model.temperature], "threshold": [float(model.threshold)]})

    return run


def train(docs: DataFrame, learn=None, rows: int = SAMPLE_ROWS, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model | None:
    """Learn from at most ``rows`` labelled rows for which ``learn`` holds, those of the smallest hash of id and text; every fifth is kept for calibration."""
    t, g = F.col(f"`{text}`"), F.col(f"`{lang}`")
    every = docs.filter((F.lit(True) if learn is None else learn) & t.isNotNull() & g.isNotNull()).select(F.xxhash64(F.col(f"`{doc_id}`"), t).alias("h"), t.alias("t"), g.alias("g"))
    # hashes are ordered alone, so that no task sends texts that aren't picked; what is drawn of those that are goes to the one task that trains
    picked = [r["h"] for r in every.select("h").distinct().orderBy("h").limit(rows).collect()]
    if not picked:
        return None

    sample = every.join(F.broadcast(docs.sparkSession.createDataFrame([(h,) for h in picked], "h long")), "h")
    drawn = map_text(sample.select("h", "g", F.struct("h", "t").alias("ht")), "ht", lambda: _drawer(), _SAMPLED, ["h", "g"])
    model = drawn.dropDuplicates(["h", "g"]).coalesce(1).mapInArrow(tidy(_trainer(set(picked[4::5]))), _MODEL).first()
    if model is None:
        return None
    languages = tuple(model["languages"])
    return Model(languages, np.frombuffer(model["table"], np.float32).reshape(BUCKETS, len(languages)), model["temperature"], model["threshold"])


def _namer(model: Model | None):
    def make():
        def apply(column):
            n = len(column)
            names, scores, rejected = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
            if model is not None:
                data, offsets = text_bytes(column)
                for a, b in slices(offsets):
                    base = offsets[a]
                    part, offs = data[base : offsets[b]], offsets[a : b + 1] - base
                    p = model.probabilities(model.means(part, offs))
                    best = p.argmax(axis=1)
                    for i in range(b - a):
                        raw = part[offs[i] : offs[i + 1]]
                        if (((raw[:4096] | 32) - 97) < 26).any() or has_letter(bytes(raw).decode("utf-8", "replace")):
                            names[a + i] = model.languages[best[i]]
                            scores[a + i] = p[i, best[i]]
                            rejected[a + i] = p[i, best[i]] < model.threshold
            return [pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)]

        return apply

    return make


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred, score and rejected for every row."""
    return map_text(docs, text, _namer(model), RESULT, list(keep))


def keep_named(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose language the model names with enough confidence."""
    made, name = add_struct(docs, text, _namer(model), RESULT)
    return made.filter(~F.col(name)["rejected"]).drop(name)
