"""License notices in texts, by a positional index of rare words.

Templates are license notices and, as the shortest of them, phrases. The index maps each word of a template to its
places there. Word rarity is inverse document frequency over all texts. A file's highest-IDF words
of each template are looked up; each meeting of a file place and a template place votes for their
difference, which is where the template would begin. Where enough rare words agree on a beginning (in ``DRIFT`` words, as
notices are edited), the mandatory key phrases of the template are looked for and the share of its
words that stand in place is the score. A phrase is its own key phrase and must stand exactly.

Scale. One pass counts the document frequencies of the templates' words (a few hundred counters a task, one row a word
and task in the shuffle); the second scans the texts and shuffles nothing. The index is of the size of the
templates, which the caller gives. Every place of every text is looked up; work is linear in the text.

Nulls and odd rows: a null text is empty: no words, no labels, score 0. Rows of one doc_id, or of none, are scanned each.
Extra columns are ignored. An empty table gives no rows. Templates without words, or whose key phrases do not occur in them, raise.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: How many of a template's rarest words in the file vote, how far apart their beginnings may lie, and how much must stand in place.
RARE, DRIFT, LEAST_SCORE = 8, 6, 0.8

# Phrases that name a license, and its label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# The words of license notices, by label, with the phrases that no copy of the notice may lack.
NOTICES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        ["permission is hereby granted", "to deal in the software without restriction"],
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        ["licensed under the apache license", "in compliance with the license"],
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ["gnu general public license", "free software foundation"],
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        ["gnu lesser general public license", "free software foundation"],
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        ["redistribution and use in source and binary forms", "must retain the above copyright notice"],
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
        ["with or without fee is hereby granted"],
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        ["mozilla public license"],
    ),
    "cc-by": ("licensed under CC BY 4.0", ["cc by 4 0"]),
    "cc-by-sa": ("licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    "cc-by-nc": ("licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
}
_SCHEMA = "doc_id string, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def words_of(text: str | None) -> list[bytes]:
    """Words of letters, digits and all that is not ASCII, A-Z in lower case, in UTF-8."""
    return WORD.findall((text or "").encode("utf-8", "replace").lower())


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]
    exact: bool

    @classmethod
    def of(cls, label: str, text: str, keys: list[str] | None = None) -> Template:
        """A notice with its key phrases; without any, a phrase that must stand exactly."""
        words = tuple(words_of(text))
        found = tuple(tuple(words_of(k)) for k in (keys or [text]))
        if not words or any(not k or places(words, k, 0, len(words)) == [] for k in found):
            raise ValueError(f"the template of {label} is empty or lacks one of its key phrases")
        return cls(label, words, found, keys is None)


def places(words: list[bytes] | tuple[bytes, ...], phrase: tuple[bytes, ...], start: int, stop: int) -> list[int]:
    """Where in ``words[start:stop]`` the phrase begins."""
    k = len(phrase)
    return [i for i in range(max(start, 0), min(stop, len(words)) - k + 1) if words[i] == phrase[0] and tuple(words[i : i + k]) == phrase]


class RareTokenIndex:
    """Templates by word: where each word stands in them, and how rare it is."""

    def __init__(self, templates: list[Template], idf: dict[bytes, float]):
        self.templates = templates
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, template in enumerate(templates):
            for q, w in enumerate(template.words):
                self.postings[w].append((t, q))
        self.order = {w: (-idf.get(w, 0.0), w) for w in self.postings}
        self.words = frozenset(self.postings)
        # Fewer places of its words than this in a file, and a template cannot reach the least score there.
        self.need = [len(t.words) if t.exact else math.ceil(LEAST_SCORE * len(t.words)) for t in templates]

    def scan(self, words: list[bytes]) -> Iterator[tuple[int, int, float]]:
        """(template, where it begins, score) of every verified occurrence."""
        met = self.words.intersection(words)
        there = Counter(t for w in met for t, _ in self.postings[w])
        able = [t for t, n in there.items() if n >= self.need[t]]
        if not able:
            return
        wanted = met & {w for t in able for w in self.templates[t].words}
        at: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in wanted:
                at[w].append(i)
        ranked = sorted(wanted, key=self.order.__getitem__)
        for t in able:
            own = set(self.templates[t].words)
            rare = [w for w in ranked if w in own][:RARE]
            yield from self._exact(t, rare, at, words) if self.templates[t].exact else self._near(t, rare, at, words)

    def _exact(self, t: int, rare: list[bytes], at: dict, words: list[bytes]) -> Iterator[tuple[int, int, float]]:
        template = self.templates[t]
        begins: set[int] | None = None
        for w in rare:  # the rarest first, so the set stays small
            own = [q for x, q in self.postings[w] if x == t]
            for q in own:
                here = {p - q for p in at[w]} if begins is None else {b for b in begins if 0 <= b + q < len(words) and words[b + q] == w}
                begins = here
        for b in sorted(begins or ()):
            if b >= 0 and tuple(words[b : b + len(template.words)]) == template.words:
                yield t, b, 1.0

    def _near(self, t: int, rare: list[bytes], at: dict, words: list[bytes]) -> Iterator[tuple[int, int, float]]:
        template = self.templates[t]
        need = math.ceil(len(rare) / 2)
        votes = sorted((p - q, w) for w in rare for x, q in self.postings[w] if x == t for p in at[w])
        low, inside = 0, Counter()
        clear = tried = -len(words) - len(template.words)
        for high, (begin, w) in enumerate(votes):
            inside[w] += 1
            while votes[low][0] < begin - DRIFT:
                inside[votes[low][1]] -= 1
                if not inside[votes[low][1]]:
                    del inside[votes[low][1]]
                low += 1
            following = votes[high + 1][0] if high + 1 < len(votes) else None
            if len(inside) < need or following == begin or begin <= clear:
                continue
            # The beginning most voted for in this window; later windows start behind it.
            best = max(Counter(v for v, _ in votes[low : high + 1]).items(), key=lambda x: (x[1], -x[0]))[0]
            if best == tried:
                continue
            tried, score = best, self._verify(template, best, words)
            if score >= LEAST_SCORE:
                clear = best + DRIFT
                yield t, best, score

    def _verify(self, template: Template, begin: int, words: list[bytes]) -> float:
        """Share of the template's words that stand within ``DRIFT`` of their place; 0 if a key phrase is missing."""
        start, stop = begin - DRIFT, begin + len(template.words) + DRIFT
        if any(not places(words, k, start, stop) for k in template.keys):
            return 0.0
        right = 0
        for q, w in enumerate(template.words):
            right += w in words[max(0, begin + q - DRIFT) : max(0, begin + q + DRIFT + 1)]
        return right / len(template.words)


def templates(phrases: dict[str, str], notices: dict[str, tuple[str, list[str]]]) -> list[Template]:
    return [Template.of(label, p) for p, label in phrases.items()] + [Template.of(label, *notice) for label, notice in notices.items()]


def rarity(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, float]:
    """IDF of the templates' words over all texts; its size is that of the templates' vocabulary."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = Counter(), 0
        for b in batches:
            n += len(b)
            for text in b["text"]:
                held.update(vocabulary.intersection(words_of(text)))
        yield pd.DataFrame({"word": [*held.keys(), b""], "n": [*held.values(), n]})

    sums = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r["word"]): r["n"] for r in sums}
    total = counts.pop(b"", 0)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, tuple[str, list[str]]] = NOTICES) -> DataFrame:
    """Per row: n_words, places of the phrases (n_base, first_word, last_word), their labels, all labels, and the best score."""
    known = templates(phrases, notices)
    idf = rarity(docs, {w for t in known for w in t.words})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = RareTokenIndex(known, idf)
        for b in slices(batches):
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                words = words_of(text)
                found = list(index.scan(words))
                base = [(known[t].label, p) for t, p, _ in found if known[t].exact]
                named = {label for label, _ in base}
                starts = [p for _, p in base]
                every = named | {known[t].label for t, _, _ in found}
                out.append((doc_id, len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(named)), ",".join(sorted(every)), max((s for *_, s in found), default=0.0)))
            if not out:
                continue
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in _SCHEMA.split(", ")])
            yield frame.astype({"first_word": "Int64", "last_word": "Int64", "n_words": "int64", "n_base": "int64", "score": "float64"})

    # Ids pass through Python as strings: whole numbers with nulls among them would become floats there.
    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, _SCHEMA)
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
