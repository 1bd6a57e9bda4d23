"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage of the whole text is
encoded: shares of kinds of characters and words, repetition inside the passage and
against the rest of the document, and a fixed random projection of its letter pairs. Only
documents have labels. Gated attention, softmax over a bag of
w . (tanh(V h) * sigmoid(U h)), weighs the passages, and a logistic output scores the
weighted mean of their hidden representations. All of it is trained together in numpy by Adam on
a bounded sample of labelled documents; executors get the weights alone (a few thousand numbers).

Defined cases: a null text or one without words is one passage of zeros, and has the score the
model gives to that; documents without a label, and null labels, are never learned from; several labels
of one document each count; with no labels, or labels of one kind only, the score is the share of
label 1 (0.5 without any); repeated rows get equal scores; label, language, source and id columns are
never inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from fathomline.llm.arrowmap import map_text
from fathomline.llm.textkit import SPACE_WORDS, Words, slices, text_bytes, window_hashes

PASSAGE_WORDS = 50
HIDDEN = 16
PROJECTED = 8
#: The bounded sample of labelled documents that training reads.
SAMPLE_DOCS = 4000
EPOCHS = 30
BATCH = 64
RATE = 0.004
DECAY = 1e-4
THRESHOLD = 0.3

_KINDS = [
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b" ",
    b"\n",
    b".",
    b",",
    b"!?",
    b"#$%&*@^~`",
    b"|<>{}[]\\=+_/",
    b"\"'():;-",
    bytes(range(0x80, 0x100)),
]
_KIND_MASKS = np.zeros((len(_KINDS), 256), bool)
for _row, _chars in zip(_KIND_MASKS, _KINDS):
    _row[list(_chars)] = True
_PAIRS = np.random.Generator(np.random.PCG64(3)).normal(0, 1, (4096, PROJECTED)).astype(np.float32)
FEATURES = len(_KINDS) + 9 + PROJECTED


def _repeated(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether each value occurred before in its row."""
    order = np.lexsort((np.arange(len(hashes)), hashes, rows))
    h, r = hashes[order], rows[order]
    out = np.zeros(len(hashes), bool)
    out[order[1:]] = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    return out


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of some rows, and n + 1 offsets; a row without words has one passage of zeros."""
    words = Words(data, offsets, SPACE_WORDS)
    counts = words.counts()
    per_row = np.maximum(1, -(-counts // PASSAGE_WORDS))
    bags = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(per_row, out=bags[1:])
    row = np.repeat(np.arange(len(counts)), per_row)
    place = np.arange(bags[-1]) - bags[row]
    first = words.first[row] + place * PASSAGE_WORDS
    last = np.minimum(first + PASSAGE_WORDS, words.first[row + 1])
    out = np.zeros((bags[-1], FEATURES), np.float32)
    full = last > first
    if not full.any():
        return out, bags
    first, last = first[full], last[full]
    begin = words.start[first]
    end = np.where(last < words.first[row[full] + 1], words.start[np.minimum(last, len(words.start) - 1)], offsets[row[full] + 1])
    size = np.maximum(end - begin, 1)
    x = np.zeros((len(first), FEATURES), np.float32)

    def share(flags: np.ndarray, a: np.ndarray, b: np.ndarray, of: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return (sums[b] - sums[a]) / of

    for k, mask in enumerate(_KIND_MASKS):
        x[:, k] = share(mask[data], begin, end, size)
    n = (last - first).astype(float)
    word_rows = np.repeat(np.arange(len(counts)), counts)
    word_passage = np.repeat(np.arange(len(first)), last - first)
    lengths = words.end - words.start
    k = len(_KINDS)
    heads = data[words.start]
    x[:, k] = share(lengths, first, last, n) / 10
    x[:, k + 1] = share(lengths > 15, first, last, n)
    x[:, k + 2] = share((heads >= 65) & (heads <= 90), first, last, n)
    x[:, k + 3] = share(_repeated(words.hash, word_passage), first, last, n)
    same = np.zeros(len(words.hash), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (word_rows[1:] == word_rows[:-1])
    x[:, k + 4] = share(same, first, last, n)
    runs = window_hashes(words.hash, 4)
    again = np.zeros(len(words.hash), bool)
    again[: len(runs)] = _repeated(runs, word_rows[: len(runs)])
    x[:, k + 5] = share(again, first, last, n)
    tails = data[words.end - 1]
    x[:, k + 6] = share((tails == 46) | (tails == 33) | (tails == 63), first, last, n)
    x[:, k + 7] = np.log1p(n) / 4
    x[:, k + 8] = np.log1p(counts[row[full]]) / 10
    pairs = ((data[:-1].astype(np.int32) * 31 + data[1:]) & 4095) if len(data) > 1 else np.zeros(0, np.int32)
    for i, (a, b) in enumerate(zip(begin.tolist(), end.tolist())):
        if b - a > 1:
            x[i, k + 9 :] = np.bincount(pairs[a : b - 1], minlength=4096).astype(np.float32) @ _PAIRS / (b - a - 1)
    out[full] = x
    return out, bags


@dataclass(frozen=True)
class Model:
    """Weights of encoder, gated attention and output; ``constant`` replaces them where nothing could be learned."""

    weights: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        z = (x - w["mean"]) / w["scale"]
        h = np.tanh(z @ w["E"] + w["e"])
        v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        raw = (v * u) @ w["a"]
        size = np.diff(bags)
        top = np.maximum.reduceat(raw, bags[:-1])
        e = np.exp(raw - np.repeat(top, size))
        att = e / np.repeat(np.add.reduceat(e, bags[:-1]), size)
        bag = np.add.reduceat(att[:, None] * h, bags[:-1], axis=0)
        logit = bag @ w["c"] + w["b"]
        return {"z": z, "h": h, "v": v, "u": u, "att": att, "bag": bag, "p": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))}

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        return np.full(len(bags) - 1, self.constant) if self.constant is not None else self.forward(x, bags)["p"]


def fit(bags: list[np.ndarray], labels: list[int], seed: int = 9) -> Model:
    """Train on bags of passage features with one label each."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model({}, float(y.mean()) if len(y) else 0.5)
    rng = np.random.Generator(np.random.PCG64(seed))
    every = np.concatenate(bags).astype(float)
    d = every.shape[1]
    start = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {"E": start(d, HIDDEN), "e": np.zeros(HIDDEN), "V": start(HIDDEN, HIDDEN), "U": start(HIDDEN, HIDDEN), "a": start(HIDDEN), "c": start(HIDDEN), "b": np.zeros(1)}
    fixed = {"mean": every.mean(axis=0), "scale": every.std(axis=0) + 0.01}
    moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in w.items()}
    step, steps = 0, EPOCHS * -(-len(bags) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for s in range(0, len(order), BATCH):
            some = order[s : s + BATCH]
            x = np.concatenate([bags[i] for i in some]).astype(float)
            size = np.array([len(bags[i]) for i in some])
            offs = np.concatenate(([0], np.cumsum(size)))
            f = Model(w | fixed).forward(x, offs)
            g = _gradients(w, f, offs, size, (f["p"] - y[some]) / len(some))
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k in w:
                m, q = moments[k]
                g[k] = g[k] + DECAY * w[k]
                m += 0.1 * (g[k] - m)
                q += 0.001 * (g[k] ** 2 - q)
                w[k] = w[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
    return Model({k: x for k, x in (w | fixed).items()})


def _gradients(w, f, offs, size, d_logit) -> dict[str, np.ndarray]:
    h, v, u, att = f["h"], f["v"], f["u"], f["att"]
    d_bag = np.repeat(np.outer(d_logit, w["c"]), size, axis=0)
    d_att = (d_bag * h).sum(axis=1)
    d_raw = att * (d_att - np.repeat(np.add.reduceat(att * d_att, offs[:-1]), size))
    d_gate = np.outer(d_raw, w["a"])
    d_v, d_u = d_gate * u * (1 - v**2), d_gate * v * u * (1 - u)
    d_h = att[:, None] * d_bag + d_v @ w["V"].T + d_u @ w["U"].T
    d_z = d_h * (1 - h**2)
    return {"E": f["z"].T @ d_z, "e": d_z.sum(axis=0), "V": h.T @ d_v, "U": h.T @ d_u, "a": (v * u).T @ d_raw, "c": f["bag"].T @ d_logit, "b": np.array([d_logit.sum()])}


# ---- on tables ------------------------------------------------------------------


def _encoder():
    def apply(column):
        data, offsets = text_bytes(column)
        out = []
        for a, b in slices(offsets):
            base = offsets[a]
            x, bags = passages(data[base : offsets[b]], offsets[a : b + 1] - base)
            out += [x[s:e].tobytes() for s, e in zip(bags[:-1].tolist(), bags[1:].tolist())]
        return [pa.array(out, pa.binary())]

    return apply


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "quality", docs_most: int = SAMPLE_DOCS) -> Model:
    """Learn ``label`` from at most ``docs_most`` labelled documents, those of the smallest hash of id."""
    key, y = F.col(f"`{doc_id}`"), F.col(f"`{label}`")
    picked = labels.filter(F.coalesce(F.lit(True) if learn is None else learn, F.lit(False)) & key.isNotNull() & y.isNotNull())
    picked = picked.select(key.alias("id"), (y.cast("double") > 0).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id", "y").limit(docs_most)
    texts = docs.select(key.alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(picked), "id")  # the limit bounds it
    encoded = map_text(texts, "text", lambda: _encoder(), StructType([StructField("x", BinaryType())]), ["id", "y"])
    rows = sorted((r["id"], r["y"], bytes(r["x"])) for r in encoded.collect())
    return fit([np.frombuffer(x, np.float32).reshape(-1, FEATURES) for _, _, x in rows], [y for _, y, _ in rows])


RESULT = StructType([StructField("score", DoubleType()), StructField("predicted", IntegerType())])


def classify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """``keep``, score and predicted (1 from ``threshold`` on) for every row."""

    def make():
        def apply(column):
            data, offsets = text_bytes(column)
            scores = [np.zeros(0)]
            for a, b in slices(offsets):
                base = offsets[a]
                scores.append(model.score(*passages(data[base : offsets[b]], offsets[a : b + 1] - base)))
            score = np.concatenate(scores)
            return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]

        return apply

    return map_text(docs, text, make, RESULT, list(keep))
