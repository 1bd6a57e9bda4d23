"""Byte-pair encoding of whole batches of texts in numpy.

For tokenizers of the kind "lower case, words ended by a marker": NFC, white space
dropped, words are runs of letters, single digits or runs of other characters. The
words of a batch are found in its bytes, each distinct word is merged once (all words
of a length side by side), and the ids are gathered back. Texts with characters
outside ASCII and the letters U+00C0 to U+00FF, with an apostrophe or with ``<|`` go to
the tokenizer itself, as do words of over 48 bytes; so the ids are the tokenizer's own.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from fathomline.llm.textkit import SLICE_BYTES, U64, range_hashes, slices, text_bytes

#: Bytes of text whose words are merged together; a worker holds 20 to 40 bytes for each of them.
GROUP_BYTES = 2 << 20
LONGEST = 48
_NONE = np.int32(2**31 - 1)

#: Classes of bytes: 1 letter, 2 digit, 3 other, 0 white space.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_CLASS[0x30:0x3A] = 2
_SECOND = np.zeros(256, np.uint8)
_SECOND[0x80:0xC0] = 1
_SECOND[[0x97, 0xB7]] = 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _byte_names() -> list[str]:
    """The character that stands for each byte: itself where it prints, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Encoder:
    """Ids of texts under a tokenizer file; ``encode`` takes a string column."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, names, end = model["vocab"], _byte_names(), model["end_of_word_suffix"]
        self.inner = np.array([vocab[n] for n in names], np.int32)
        self.last = np.array([vocab[n + end] for n in names], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.bits = max(18, int(len(pairs)).bit_length() + 3)
        self.slot_key = np.full((1 << self.bits) + 64, -1, np.int64)
        self.slot_rank = np.full((1 << self.bits) + 64, _NONE, np.int32)
        self.reach = 1
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            step = at
            while self.slot_key[step] >= 0:
                step += 1
            self.slot_key[step], self.slot_rank[step] = key, rank
            self.reach = max(self.reach, step - at + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge; ``_NONE`` if it has none or an end of a word (-1) is in it."""
        keys = (left.astype(np.int64) << 20) | right
        keys[right < 0] = -2
        at = self._slot(keys)
        ranks = np.where(self.slot_key[at] == keys, self.slot_rank[at], _NONE)
        open_ = np.flatnonzero(((ranks == _NONE) & (self.slot_key[at] >= 0) & (right >= 0)).ravel())
        for step in range(1, self.reach):
            if not len(open_):
                break
            there = self.slot_key[at.ravel()[open_] + step]
            hit = there == keys.ravel()[open_]
            ranks.ravel()[open_[hit]] = self.slot_rank[at.ravel()[open_[hit]] + step]
            open_ = open_[~hit & (there >= 0)]
        return ranks

    def _merge(self, rows: np.ndarray) -> np.ndarray:
        """Merge words given as rows of symbols, one merge in each row at a time, lowest rank first."""
        live, done = np.arange(len(rows)), rows
        work = rows
        ranks = self._ranks(work[:, :-1].copy(), work[:, 1:].copy())
        while len(live) and work.shape[1] > 1:
            place = ranks.argmin(axis=1)
            best = ranks[np.arange(len(work)), place]
            going = best != _NONE
            if not going.all():
                done[live[~going], : work.shape[1]] = work[~going]
                done[live[~going], work.shape[1] :] = -1
                live, work, ranks, place, best = live[going], work[going], ranks[going], place[going], best[going]
                if not len(live):
                    break
            at = np.arange(len(work))
            columns = np.arange(work.shape[1] - 1)
            work[at, place] = self.made[best]
            after = columns[None, :] > place[:, None]
            work = np.where(after, work[:, 1:], work[:, :-1])
            moved = np.empty((len(work), work.shape[1] - 1), np.int32)
            np.copyto(moved, np.where(after[:, :-1], ranks[:, 1:], ranks[:, :-1]))
            ranks = moved
            if work.shape[1] > 1:
                for near in (place - 1, place):
                    ok = np.flatnonzero((near >= 0) & (near < work.shape[1] - 1))
                    ranks[ok, near[ok]] = self._ranks(work[ok, near[ok]], work[ok, near[ok] + 1])
        if len(live):
            done[live, : work.shape[1]] = work
            done[live, work.shape[1] :] = -1
        return done

    def words_ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of words given by their byte ranges, and n + 1 offsets."""
        sizes = ends - starts
        counts = np.zeros(len(sizes), np.int64)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for size in np.unique(sizes).tolist():
            every = np.flatnonzero(sizes == size)
            for i in range(0, len(every), 20_000):
                some = every[i : i + 20_000]
                if size > LONGEST:
                    ids = [np.array(self.tokenizer.encode(bytes(data[starts[j] : ends[j]]).decode(), add_special_tokens=False).ids, np.int32) for j in some.tolist()]
                    counts[some] = [len(x) for x in ids]
                    kept += [(np.array([j]), x, np.arange(len(x))) for j, x in zip(some.tolist(), ids)]
                    continue
                raw = data[starts[some][:, None] + np.arange(size)]
                rows = self.inner[raw]
                rows[:, -1] = self.last[raw[:, -1]]
                rows = self._merge(rows)
                full = rows >= 0
                counts[some] = full.sum(axis=1)
                r, c = np.nonzero(full)
                kept.append((some[r], rows[r, c], c))
        offsets = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(counts, out=offsets[1:])
        flat = np.empty(offsets[-1], np.int32)
        for owner, ids, c in kept:
            flat[offsets[owner] + c] = ids
        return flat, offsets

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether each row can be encoded from its bytes."""
        odd = (data >= 0x80) & (data != 0xC3)
        odd[1:] &= data[:-1] != 0xC3
        odd |= data == 0x27
        odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(odd, out=sums[1:])
        return sums[offsets[1:]] == sums[offsets[:-1]]

    def encode(self, column: pa.Array):
        """Yields (first row, flat ids, n + 1 offsets) for groups of rows of the column."""
        data, offsets = text_bytes(column)
        for a, b in slices(offsets, GROUP_BYTES):
            base = offsets[a]
            ids, offs = self._group(data[base : offsets[b]], offsets[a : b + 1] - base)
            yield a, ids, offs

    def _group(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain = self._plain(data, offsets)
        starts, ends, hashes, first = [], [], [], [np.zeros(1, np.int64)]
        lowered = np.empty_like(data)
        total = 0
        for a, b in slices(offsets, SLICE_BYTES):
            s, e = offsets[a], offsets[b]
            part, offs = data[s:e], offsets[a : b + 1] - s
            low = _LOWER[part]
            kind = _CLASS[part]
            wide = np.flatnonzero(part[:-1] == 0xC3)
            second = part[wide + 1]
            kind[wide] = kind[wide + 1] = _SECOND[second]
            upper = wide[(second < 0x9F) & (second != 0x97)] + 1
            low[upper] += 32
            lowered[s:e] = low
            # a word begins where the class changes, at each digit and at each row
            begins = np.empty(len(kind), bool)
            begins[:1] = True
            np.not_equal(kind[1:], kind[:-1], out=begins[1:])
            begins |= kind == 2
            begins[offs[:-1][offs[:-1] < len(kind)]] = True
            at = np.flatnonzero(begins)
            until = np.append(at[1:], len(kind))
            word = kind[at] != 0
            at, until = at[word], until[word]
            hashes.append(range_hashes(low, at, until))
            starts.append(at + s)
            ends.append(until + s)
            first.append(np.searchsorted(at, offs[1:]) + total)
            total += len(at)
        if not starts:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        starts, ends, first = np.concatenate(starts), np.concatenate(ends), np.concatenate(first)
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        use = plain[rows]
        _, index, inverse = np.unique(np.concatenate(hashes)[use], return_index=True, return_inverse=True)
        distinct, distinct_offs = self.words_ids(lowered, starts[use][index], ends[use][index])
        sizes = np.diff(distinct_offs)[inverse]
        flat, offs = _gather(distinct, distinct_offs, inverse, sizes)
        row_sizes = np.bincount(rows[use], weights=sizes, minlength=len(offsets) - 1).astype(np.int64)
        if plain.all():
            out = np.zeros(len(offsets), np.int64)
            np.cumsum(row_sizes, out=out[1:])
            return flat, out
        pieces, at = [], 0
        for i in range(len(offsets) - 1):
            if plain[i]:
                pieces.append(flat[at : at + row_sizes[i]])
                at += row_sizes[i]
            else:
                text = bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace")
                pieces.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32))
        out = np.zeros(len(offsets), np.int64)
        np.cumsum([len(p) for p in pieces], out=out[1:])
        return np.concatenate(pieces), out


def _gather(flat: np.ndarray, offsets: np.ndarray, picks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` that ``picks`` names, one after another."""
    out = np.zeros(len(picks) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return flat[np.repeat(offsets[:-1][picks] - out[:-1], sizes) + np.arange(out[-1])], out
