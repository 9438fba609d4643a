"""Licences in texts, by the rare words of templates and where they stand.

Templates are indexed by word and position. A text is reduced once to the places
of template words in it; how many texts hold each word gives the words' weights.
For every template, the rarest of its words that a text holds are looked up: each
occurrence, less the word's position in the template, says where the template
would begin. Where enough of them agree, the template's key phrases must stand
word by word, and the share of the template's weight found there is its score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts as T
from .scratch import settled

LOOKUPS = 8  # rarest words of a template that are looked up in a text
SLACK = 6  # words that may be put in or left out between two places of a template


@dataclass(frozen=True)
class Template:
    """A text that stands for ``label``, and phrases of it without which it does not count.

    ``exact`` templates are one phrase, found wherever its words stand in a row.
    """

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    exact: bool = False


# The phrases every scan looks for.
BASE = (
    Template("gpl", "gnu general public license", exact=True),
    Template("apache", "apache license", exact=True),
    Template("cc-by", "cc by", exact=True),
    Template("mit", "mit license", exact=True),
)

# Notices in common use.
NOTICES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template(
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        ("except in compliance with the license", "as is basis"),
    ),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", ("general public license version 2",)),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", ("general public license version 3",)),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
        ("redistribute it and or modify it", "general public license as published"),
    ),
    Template("lgpl", "licensed under the GNU Lesser General Public License", ("lesser general public license",)),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies",
        ("with or without fee is hereby granted",),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "following conditions are met"),
    ),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        ("subject to the terms of the mozilla public license v 2 0",),
    ),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc-by-4.0", "licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international",)),
)

#: Bytes between words: ASCII but digits and letters.
_BETWEEN = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def words(text: str) -> list[str]:
    """The words of an ASCII text, lower-cased."""
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


class Index:
    """Templates as word numbers, and where each word stands in them."""

    def __init__(self, templates: tuple[Template, ...]):
        self.templates = templates
        self.words = sorted({w for t in templates for said in (t.text, *t.phrases) for w in words(said)})
        number = {w: i for i, w in enumerate(self.words)}
        self.numbers = [np.array([number[w] for w in words(t.text)]) for t in templates]
        self.phrases = [[np.array([number[w] for w in words(p)]) for p in t.phrases] for t in templates]
        said = " ".join(self.words).encode()
        hashes = T.word_hashes(np.frombuffer(said, np.uint8), np.array([0, len(said)]), _BETWEEN)[0]
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``hashes`` are template words, and their numbers."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        return hit, self.order[at[hit]]


def _pieces(data: np.ndarray, size: int):
    """A text in pieces of about ``size`` bytes that end between words."""
    start = 0
    while start < data.size:
        stop = min(start + size, data.size)
        while stop < data.size and not _BETWEEN[data[stop]]:
            ahead = np.flatnonzero(_BETWEEN[data[stop : stop + size]])
            stop = stop + int(ahead[0]) if ahead.size else min(stop + size, data.size)
        yield data[start:stop]
        start = stop


def _places(index: Index, column: pa.Array) -> tuple[np.ndarray, pa.ListArray, pa.ListArray]:
    """Numbers of words of all rows, and the places and numbers of template words."""
    data, offsets = T.raw(column)
    if len(offsets) == 2 and data.size > 2 * T.SLICE:
        total, at, which = 0, [], []
        for piece in _pieces(data, T.SLICE):
            hashes = T.word_hashes(piece, np.array([0, piece.size]), _BETWEEN)[0]
            hit, number = index.found(hashes)
            at.append((hit + total).astype(np.int32))
            which.append(number.astype(np.int16))
            total += hashes.size
        count, place, number = np.array([total]), np.concatenate(at), np.concatenate(which)
        ends = np.array([0, place.size])
    else:
        hashes, _, _, row = T.word_hashes(data, offsets, _BETWEEN)
        count = np.bincount(row, minlength=len(offsets) - 1)
        hit, number = index.found(hashes)
        first = np.concatenate([[0], np.cumsum(count)])
        place, ends = hit - first[row[hit]], np.concatenate([[0], np.cumsum(np.bincount(row[hit], minlength=len(offsets) - 1))])
    lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v)) for v in (place.astype(np.int32), number.astype(np.int16))]
    return count, *lists


def reduced(docs: DataFrame, index: Index, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_words`` and the places and numbers of template words of every row, written."""
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        for batch in batches:
            for part in T.slices(batch):
                count, place, number = _places(index, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count.astype(np.int64)), place, number], ["id", "n_words", "place", "word"])

    kind = rows.schema["id"].dataType.simpleString()
    return settled(rows.mapInArrow(run, f"id {kind}, n_words long, place array<int>, word array<short>"), "licence-words")


def weights(found: DataFrame, index: Index) -> np.ndarray:
    """The inverse document frequency of every template word over all rows.

    One number per template word reaches the driver, however many rows there are.
    """
    held = found.select(F.explode(F.array_distinct("word")).alias("word")).groupBy("word").count()
    rows = found.count()
    count = np.zeros(len(index.words))
    for r in held.collect():
        count[r["word"]] = r["count"]
    return np.log(1 + rows / np.maximum(count, 1))


class _Rows:
    """The template words of a batch of rows on one axis, rows a gap apart."""

    def __init__(self, place: pa.ListArray, word: pa.ListArray, gap: int):
        ends = place.offsets.to_numpy() - place.offsets[0].as_py()
        self.n = len(place)
        self.row = np.repeat(np.arange(self.n), np.diff(ends))
        at = place.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.word = word.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        last = np.zeros(self.n, np.int64)
        full = np.diff(ends) > 0
        last[full] = at[ends[1:][full] - 1]
        self.base = np.concatenate([[0], np.cumsum(last + gap)])
        self.at = at + self.base[self.row]
        order = np.argsort(self.word, kind="stable")
        self._order, self._sorted = order, self.word[order]
        self._held: dict[int, np.ndarray] = {}

    def of(self, word: int) -> np.ndarray:
        """Places of a word, ascending."""
        if word not in self._held:
            low, high = np.searchsorted(self._sorted, [word, word + 1])
            self._held[word] = self.at[self._order[low:high]]
        return self._held[word]

    def phrase(self, numbers: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Where the words ``numbers`` stand in a row, from the rarest word's places."""
        rare = int(np.argmax(weight[numbers]))
        start = self.of(numbers[rare]) - rare
        for k, number in enumerate(numbers):
            if k != rare and start.size:
                start = start[_among(start + k, self.of(number))]
        return start

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, at, "right") - 1


def _among(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    if not held.size:
        return np.zeros(values.size, bool)
    return held[np.minimum(np.searchsorted(held, values), held.size - 1)] == values


def _within(held: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether a value of the sorted ``held`` lies between ``low`` and ``high``, both included."""
    return np.searchsorted(held, high, "right") > np.searchsorted(held, low, "left")


def _notice(rows: _Rows, numbers: np.ndarray, phrases: list[np.ndarray], weight: np.ndarray, lookups: int, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold a template, and the best score of each."""
    able = np.arange(rows.n)  # rows that hold every word of the key phrases
    for w in sorted({int(w) for phrase in phrases for w in phrase}, key=lambda w: (-weight[w], w)):
        able = able[np.isin(able, rows.row_of(rows.of(w)))] if able.size else able
    if not able.size:
        return able, np.zeros(0)
    own = np.unique(numbers)
    own = own[np.argsort(-weight[own], kind="stable")]  # the rarest first, then by word
    places = {int(w): rows.of(w) for w in own}
    asked, starts, of = np.zeros(rows.n, np.int64), [], np.zeros(rows.n, np.int64)
    for w in own:
        holders = np.intersect1d(rows.row_of(places[int(w)]), able)
        holders = holders[asked[holders] < lookups]
        asked[holders] += 1
        posts = np.flatnonzero(numbers == w)
        of[holders] += posts.size
        mine = places[int(w)]
        mine = mine[np.isin(rows.row_of(mine), holders)]
        starts.append((mine[:, None] - posts[None, :]).ravel())
    begin = np.sort(np.concatenate(starts))
    # A place before the row's first word belongs to the row all the same: rows lie a wider gap apart.
    row = rows.row_of(begin + slack + len(numbers))
    votes = np.searchsorted(begin, begin + slack, "right") - np.searchsorted(begin, begin, "left")
    good = np.flatnonzero((2 * votes >= of[row]) & (of[row] > 0))
    begin = np.unique(begin[good])
    for phrase in phrases:
        begin = begin[_within(rows.phrase(phrase, weight), begin - slack, begin + len(numbers) + slack)] if begin.size else begin
    if not begin.size:
        return begin, np.zeros(0)
    low, high = begin - slack, begin + len(numbers) + slack
    score = sum(weight[w] * _within(places[int(w)], low, high) for w in own) / weight[own].sum()
    row = rows.row_of(begin + slack + len(numbers))
    out = np.zeros(rows.n)
    np.maximum.at(out, row, score)
    return np.unique(row), out


def _scanned(index: Index, weight: np.ndarray, place: pa.ListArray, word: pa.ListArray, lookups: int, slack: int) -> dict[str, pa.Array]:
    longest = max(map(len, index.numbers))
    rows = _Rows(place, word, 4 * (longest + slack) + 1)
    n = rows.n
    n_base = np.zeros(n, np.int64)
    first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    base, labels, best = [set() for _ in range(n)], [set() for _ in range(n)], np.zeros(n)
    for template, numbers, phrases in zip(index.templates, index.numbers, index.phrases):
        if template.exact:
            at = rows.phrase(numbers, weight)
            row = rows.row_of(at)
            n_base += np.bincount(row, minlength=n)
            np.minimum.at(first, row, at - rows.base[row])
            np.maximum.at(last, row, at - rows.base[row])
            best[row] = 1.0
            for r in np.unique(row):
                base[r].add(template.label)
        else:
            held, score = _notice(rows, numbers, phrases, weight, lookups, slack)
            for r in held:
                labels[r].add(template.label)
                best[r] = max(best[r], score[r])
    none = last < 0
    said = lambda sets: pa.array([",".join(sorted(s)) for s in sets], pa.string())
    return {
        "n_base": pa.array(n_base), "first_word": pa.array(np.where(none, 0, first), mask=none), "last_word": pa.array(last, mask=none),
        "base_labels": said(base), "labels": said([a | b for a, b in zip(base, labels)]), "score": pa.array(np.minimum(best, 1.0)),
    }


def scan(
    docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, id: str = "doc_id", text: str = "text", lookups: int = LOOKUPS, slack: int = SLACK
) -> DataFrame:
    """Every row's licences: ``id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts the places of all exact templates, ``first_word`` and
    ``last_word`` are the least and largest of their starts in words from 0 (null
    without one), and ``base_labels`` their labels. ``labels`` adds those of the
    other templates; both are distinct, sorted and joined by commas. ``score`` is
    the best template's share of weight found, 1 for an exact one, 0 for none.

    Null and empty texts, and texts without words, have no licence. Rows and ids
    that repeat are rows of their own, other columns are not read, an empty table
    gives an empty result. A text of any length is read in pieces of about 1 MB;
    of its words only the places of template words are kept.
    """
    index = Index(templates)
    found = reduced(docs, index, id, text)
    weight = weights(found, index)

    def run(batches):
        for batch in batches:
            out = _scanned(index, weight, batch.column(2), batch.column(3), lookups, slack)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out.values()], ["id", "n_words", *out])

    kind = found.schema["id"].dataType.simpleString()
    return found.mapInArrow(run, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
