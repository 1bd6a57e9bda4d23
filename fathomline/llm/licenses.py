"""License scans by template markup.

A template is the wording of a licence or notice with ``<<optional>> ... <<end>>``
regions, which a text may leave out, and ``<<var N>>`` regions, which stand for 0 to N
words of any kind. Each compiles into a token automaton over normalised words; a text is
accepted where every mandatory word matches exactly, in order.

Short phrases (``PHRASES``) are searched as plain runs of words; the automata add labels.
Whole texts are scanned: the hashes of all windows of three words are looked up
among the first three words of phrases and templates, and only there do automata run, on the
words themselves.

Defined cases: a null or empty text has no words, no labels, null places and score 0;
overlapping places all count; equal labels count once; ties of longest matches have
one score; repeated rows get equal rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from fathomline.llm.arrowmap import map_text
from fathomline.llm.decontaminate import item_words
from fathomline.llm.textkit import ALNUM_WORDS, SEPARATOR_BYTE, U64, Words, slices, text_bytes, window_hashes

#: The base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Public wordings of licences and of the notices that name them.
TEMPLATES = {
    "mit": [
        "released under the <<optional>> terms of the <<end>> mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>> including the next paragraph <<end>> shall be included in all copies or substantial portions of the software",
    ],
    "apache-2": [
        "licensed under the apache license version 2 0 <<optional>> the license you may not use this <<var 3>> except in compliance with the license <<end>>",
    ],
    "cc-by-nc": [
        "licensed under cc by nc <<optional>> 4 0 <<end>> <<optional>> international license <<end>>",
        "licensed under a creative commons attribution noncommercial <<var 2>> international license",
    ],
    "cc-by": ["licensed under a creative commons attribution 4 0 international license"],
    "gpl-3": [
        "licensed under the gnu general public license <<optional>> as published by the free software foundation <<end>> <<optional>> either <<end>> version 3",
        "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license <<optional>> or at your option any later version <<end>>",
    ],
    "gpl-2": [
        "licensed under the gnu general public license <<optional>> as published by the free software foundation <<end>> <<optional>> either <<end>> version 2",
        "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license <<optional>> or at your option any later version <<end>>",
    ],
    "bsd-2-clause": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<optional>> 1 <<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<optional>> 2 <<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by <<var 12>> as is",
    ],
    "bsd-3-clause": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<optional>> 1 <<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<optional>> 2 <<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<optional>> 3 <<end>> neither the name of <<var 12>> nor the names of <<var 6>> contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "isc": ["permission to use copy modify and <<optional>> or <<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "mpl-2": ["subject to the terms of the mozilla public license v <<optional>> ersion <<end>> 2 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}
LEAD = 3


class Automaton:
    """A nondeterministic automaton over words; state sets that have been seen are kept."""

    def __init__(self, template: str):
        tokens = template.replace("<<var ", "<<var:").split()
        self.steps: list[tuple] = []  # ("word", w) | ("any",) | ("jump", to): go on, or go on at to
        self.mandatory: list[bytes] = []
        opened: list[int] = []
        for token in tokens:
            if token == "<<optional>>":
                opened.append(len(self.steps))
                self.steps.append(("jump", -1))
            elif token == "<<end>>":
                self.steps[opened.pop()] = ("jump", len(self.steps))
            elif token.startswith("<<var:"):
                most = int(token[6:-2])
                end = len(self.steps) + 2 * most
                for _ in range(most):
                    self.steps += [("jump", end), ("any",)]
            else:
                self.steps.append(("word", token.encode()))
                if not opened:
                    self.mandatory.append(token.encode())
        if opened:
            raise ValueError(f"optional region without an end in {template[:60]!r}")
        self.lead = tuple(s[1] for s in self.steps[:LEAD])
        if len(self.steps) < LEAD or any(s[0] != "word" for s in self.steps[:LEAD]):
            raise ValueError(f"a template begins with {LEAD} mandatory words: {template[:60]!r}")
        self.accept = len(self.steps)
        self.start = self._closure([0])
        self.known: dict[tuple[frozenset, bytes], frozenset] = {}
        self.words = {s[1] for s in self.steps if s[0] == "word"}

    def _closure(self, states) -> frozenset:
        out, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in out:
                out.add(s)
                if s < len(self.steps) and self.steps[s][0] == "jump":
                    todo += [s + 1, self.steps[s][1]]
        return frozenset(out)

    def match(self, words: list[bytes]) -> int:
        """The number of words of the longest accepted run that begins with the first word; 0 if none."""
        states, longest = self.start, 0
        for n, word in enumerate(words, 1):
            key = (states, word if word in self.words else b"")
            if key not in self.known:
                self.known[key] = self._closure(s + 1 for s in states if s < self.accept and (self.steps[s][0] == "any" or self.steps[s] == ("word", word)))
            states = self.known[key]
            if not states:
                break
            if self.accept in states:
                longest = n
        return longest

    def longest(self) -> int:
        return sum(s[0] != "jump" for s in self.steps)


RESULT = StructType(
    [
        StructField("n_words", LongType()),
        StructField("n_base", LongType()),
        StructField("first_word", LongType()),
        StructField("last_word", LongType()),
        StructField("base_labels", StringType()),
        StructField("labels", StringType()),
        StructField("score", DoubleType()),
    ]
)


class Scanner:
    """Finds phrases and templates in the words of texts."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]]):
        self.phrases, self.templates = defaultdict(list), defaultdict(list)
        for phrase, label in phrases.items():
            words = item_words(phrase)
            self.phrases[tuple(words[:LEAD])].append((words, label))
        for label, texts in templates.items():
            for text in texts:
                automaton = Automaton(text)
                self.templates[automaton.lead].append((automaton, label))
        leads = sorted({*self.phrases, *self.templates})
        data = np.frombuffer(b" ".join(b" ".join(x) for x in leads), np.uint8)
        self.leads = np.unique(window_hashes(Words(data, np.array([0, len(data)]), ALNUM_WORDS).hash, LEAD)[::LEAD])
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[self.leads >> U64(48)] = True
        self.reach = max([len(w) for p in self.phrases.values() for w, _ in p] + [a.longest() for t in self.templates.values() for a, _ in t])

    def places(self, data: np.ndarray, words: Words):
        """(row, word in the row, length, label, whether it is a base phrase) of everything found."""
        every = window_hashes(words.hash, LEAD)
        at = np.flatnonzero(self.sieve[every >> U64(48)])
        near = np.minimum(np.searchsorted(self.leads, every[at]), len(self.leads) - 1)
        at = at[self.leads[near] == every[at]]
        rows = np.searchsorted(words.first, at, side="right") - 1
        for i, row in zip(at.tolist(), rows.tolist()):
            last = min(i + self.reach, int(words.first[row + 1]))
            if last - i < LEAD:
                continue
            text = bytes(data[words.start[i] : words.end[last - 1]]).translate(bytes(ALNUM_WORDS))
            near_words = [w for w in text.split(SEPARATOR_BYTE) if w]
            lead, place = tuple(near_words[:LEAD]), i - int(words.first[row])
            for phrase, label in self.phrases.get(lead, ()):
                if near_words[: len(phrase)] == phrase:
                    yield row, place, len(phrase), label, True
            for automaton, label in self.templates.get(lead, ()):
                if n := automaton.match(near_words):
                    yield row, place, n, label, False


def _text_function(phrases, templates):
    def make():
        scanner = Scanner(phrases, templates)

        def apply(column):
            data, offsets = text_bytes(column)
            out: list[list] = [[] for _ in RESULT]
            for a, b in slices(offsets):
                base = offsets[a]
                words = Words(data[base : offsets[b]], offsets[a : b + 1] - base, ALNUM_WORDS)
                found = defaultdict(list)
                for row, *place in scanner.places(data[base : offsets[b]], words):
                    found[row].append(place)
                for row, count in enumerate(words.counts().tolist()):
                    places = found.get(row, ())
                    starts = [p for p, _, _, is_base in places if is_base]
                    base_labels = {label for *_, label, is_base in places if is_base}
                    longest = max((n for _, n, *_ in places), default=0)
                    values = count, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted({label for *_, label, _ in places})), 1 - math.exp(-longest / 4) if longest else 0.0
                    for to, value in zip(out, values):
                        to.append(value)
            return [pa.array(x, t) for x, t in zip(out, [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()])]

        return apply

    return make


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """``keep`` and, for each row, its words, base places, labels and score (1 - exp(-words of the longest match / 4))."""
    return map_text(docs, text, _text_function(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates), RESULT, list(keep))
