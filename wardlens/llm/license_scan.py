"""Licence notices in documents by a positional index of rare words.

Templates are whole notices, naming sentences and single phrases. How many documents hold each template word is
counted over the whole table (its IDF). In each document the highest-IDF words that a template shares with it are looked
up; every occurrence, set against the word's positions in the template, votes for the place where the template would
begin. Places with enough votes are candidates, and one counts if the template's mandatory key phrases stand there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import own_name

#: Letters (A-Z lower-cased), digits and bytes beyond ASCII stay; every other byte separates words.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: So many words of a template, those rarest in the corpus of all that a document shares with it, are looked up there.
LOOKUPS = 8
#: Words that may be missing or added between two votes for one place, per word of the template.
DRIFT = 0.05

#: Phrases that are labels wherever they stand.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Public licence notices as (label, text, mandatory key phrases).
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
     "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
     "See the License for the specific language governing permissions and limitations under the License.",
     ["you may not use this file except in compliance with the license", "unless required by applicable law or agreed to in writing"]),
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
     "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
     "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
     "permission notice shall be included in all copies or substantial portions of the Software.",
     ["permission is hereby granted free of charge", "the above copyright notice and this permission notice shall be included"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
     "and this permission notice appear in all copies.", ["with or without fee is hereby granted"]),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
     "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
     "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
     "and/or other materials provided with the distribution.",
     ["redistribution and use in source and binary forms", "redistributions in binary form must reproduce the above copyright notice"]),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
     "without specific prior written permission.", ["may be used to endorse or promote products derived from this software"]),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
     "Foundation, either version 3 of the License, or (at your option) any later version.", ["under the terms of the gnu general public license"]),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free "
     "Software Foundation", ["gnu lesser general public license"]),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3", ["gnu affero general public license"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain "
     "one at http://mozilla.org/MPL/2.0/.", ["subject to the terms of the mozilla public license"]),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0 international license"]),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
     ["has waived all copyright and related or neighboring rights"]),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
     "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
     ["free and unencumbered software released into the public domain"]),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of "
     "this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
     ["in no event will the authors be held liable for any damages arising from the use of this software"]),
]


def split_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text; none for null."""
    return text.translate(BYTES).split() if text else []


@dataclass(frozen=True)
class Template:
    """A notice (or a phrase, which is its own key phrase): words, positions of each, key phrases."""

    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]
    phrase: bool = False
    places: dict[bytes, np.ndarray] = field(default_factory=dict, compare=False, hash=False)
    must: frozenset[bytes] = frozenset()

    @staticmethod
    def of(label: str, text: str, keys: list[str], phrase: bool = False) -> Template:
        w = tuple(split_words(text.encode()))
        k = tuple(tuple(split_words(x.encode())) for x in keys)
        if not w or not all(k) or not k:
            raise ValueError(f"template {label}: a text and key phrases with words are needed")
        places = {x: np.array([i for i, y in enumerate(w) if y == x]) for x in set(w)}
        return Template(label, w, k, phrase, places, frozenset(x for y in k for x in y))

    @property
    def drift(self) -> int:
        return 0 if self.phrase else int(len(self.words) * DRIFT)


def templates(notices: list[tuple[str, str, list[str]]] = NOTICES, phrases: dict[str, str] = PHRASES) -> list[Template]:
    return [Template.of(label, p, [p], True) for p, label in phrases.items()] + [Template.of(*n) for n in notices]


class Index:
    """Templates with the IDF of their words; ``scan`` finds them in one document."""

    def __init__(self, found: list[Template], idf: dict[bytes, float]):
        self.templates, self.idf = found, idf
        self.vocabulary = frozenset(w for t in found for w in t.words)
        #: Templates by one word that each of them needs, the one that fewest documents hold.
        self.by_word: dict[bytes, list[Template]] = {}
        for t in found:
            self.by_word.setdefault(min(t.must, key=lambda w: (-idf[w], w)), []).append(t)

    def scan(self, words: list[bytes]) -> list[tuple[Template, int, float]]:
        """(template, place of its first word, share of its looked-up words that agree), verified, in no order."""
        here = self.vocabulary.intersection(words)
        wanted = [t for w in here & self.by_word.keys() for t in self.by_word[w] if t.must <= here]
        if not wanted:
            return []
        at: dict[bytes, list[int]] = {}
        needed = frozenset().union(*(t.words for t in wanted)) & here
        for i, w in enumerate(words):
            if w in needed:
                at.setdefault(w, []).append(i)
        spots = {w: np.array(x) for w, x in at.items()}
        return [x for t in wanted for x in self._places(t, words, spots)]

    def _places(self, t: Template, words: list[bytes], spots: dict[bytes, np.ndarray]) -> Iterator[tuple[Template, int, float]]:
        shared = sorted((w for w in t.places if w in spots), key=lambda w: (-self.idf[w], w))[:1 if t.phrase else LOOKUPS]
        votes = [np.unique(np.subtract.outer(spots[w], t.places[w])) for w in shared]
        start = np.concatenate(votes)
        who = np.repeat(np.arange(len(shared)), [len(v) for v in votes])
        order = np.argsort(start, kind="stable")
        start, who = start[order], who[order]
        # Votes within the drift after a first one are for the same place; half of the looked-up words must agree.
        least = (len(shared) + 1) // 2
        end = np.searchsorted(start, start + t.drift, side="right")
        free = None
        for i in np.flatnonzero(end - np.arange(len(start)) >= least):
            first, last = int(start[i]), int(start[end[i] - 1])
            if free is not None and first < free:
                continue
            agree = len(np.unique(who[i:end[i]]))
            if agree < least or not (verified := self._verified(t, words, spots, first, last)):
                continue
            yield t, verified[0], 1.0 if t.phrase else agree / min(LOOKUPS, len(t.places))
            free = first + 1 if t.phrase else first + len(t.words)

    def _verified(self, t: Template, words: list[bytes], spots: dict[bytes, np.ndarray], first: int, last: int) -> tuple[int] | None:
        """The place of the notice, if all its key phrases stand there in order; a phrase must stand at its exact place."""
        if t.phrase:
            return (first,) if first >= 0 and tuple(words[first:first + len(t.words)]) == t.words else None
        low, high = first - t.drift, last + len(t.words) + t.drift
        begin = low
        for k in t.keys:
            rare = min(k, key=lambda w: (-self.idf[w], w))
            offset = k.index(rare)
            near = spots[rare][np.searchsorted(spots[rare], begin + offset):np.searchsorted(spots[rare], high)]
            begin = next((int(p) - offset + len(k) for p in near if p >= offset and tuple(words[p - offset:p - offset + len(k)]) == k), None)
            if begin is None or begin > high:
                return None
        return (max(first, 0),)


def document_counts(df: DataFrame, found: list[Template], text: str = "text") -> tuple[int, dict[bytes, int]]:
    """Rows of the table, and for each template word how many rows hold it: one sum over all, as long as the templates' vocabulary."""
    vocabulary = sorted({w for t in found for w in t.words})
    number = {w: i for i, w in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(vocabulary) + 1, np.int64)
        for b in batches:
            for x in b.column(0):
                n[-1] += 1
                n[[number[w] for w in number.keys() & split_words(x.as_py())]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(vocabulary)), pa.int32()), pa.array(np.roll(n, 1))], names=["word", "n"])

    counted = df.select(F.col(text).cast("binary").alias("t")).mapInArrow(run, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    n = {r["word"]: r["n"] for r in counted.collect()}  # one row per template word
    return n.get(-1, 0), {w: n.get(i, 0) for w, i in number.items()}


def build_index(df: DataFrame, found: list[Template] | None = None, text: str = "text") -> Index:
    """The index for ``df``: IDF is ln((1 + rows) / (1 + rows with the word)) over the whole table."""
    chosen = templates() if found is None else found
    rows, held = document_counts(df, chosen, text)
    return Index(chosen, {w: log((1 + rows) / (1 + n)) for w, n in held.items()})


OUT = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, " \
      "found array<struct<label:string,first:bigint,words:bigint,score:double>>"


def scan_row(index: Index, text: bytes | None) -> tuple:
    words = split_words(text)
    hits = index.scan(words)
    base = [place for t, place, _ in hits if t.phrase]
    name = lambda labels: ",".join(sorted(set(labels)))
    found = sorted(((t.label, place, len(t.words), s) for t, place, s in hits), key=lambda x: (x[1], x[0], x[2]))
    return (len(words), len(base), min(base, default=None), max(base, default=None), name(t.label for t, _, _ in hits if t.phrase),
            name(t.label for t, _, _ in hits), max((s for _, _, s in hits), default=0.0),
            [dict(zip(("label", "first", "words", "score"), x, strict=True)) for x in found])


def scan(df: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """``df`` with n_words, n_base, first_word, last_word, base_labels, labels, score and found of each whole text.

    Base columns are of the phrases (all their places); labels are theirs and the notices'. score is the best found one's:
    1 for a phrase, else the share of the looked-up words that agree on its place; 0 where nothing is found. found lists every
    notice and phrase with its first word. Null, empty and wordless texts have no words and no labels; repeated rows are scanned
    each; an empty table gives an empty result; existing columns of these names are replaced. One narrow pass, no shuffle.
    """
    made = [x.split()[0] for x in OUT.split(", ")]
    keep = [c for c in df.columns if c.lower() not in made]
    tmp = own_name(df, "_text")
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("binary").alias(tmp))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != tmp), OUT])
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct(
        [("label", pa.string()), ("first", pa.int64()), ("words", pa.int64()), ("score", pa.float64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan_row(index, x.as_py()) for x in b.column(tmp)]
            cols = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in range(len(keep))] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[*keep, *made])

    return src.mapInArrow(run, schema)
