"""Licence scans: an exact set-similarity join of text blocks with licence templates.

A block is up to ``BLOCK`` words of a line, every ``BLOCK / 2`` words.  A block meets a template if it holds at
least ``CONTAINMENT`` percent of the template's different words.  Words are ordered by how many documents have
them, rarest first.  A block is compared with a template only if they share a word of their prefixes (a
template that is contained has one there), the block is long enough, and the words after the shared one can
still make up the threshold; then the overlap is counted.  Words that are in no template cannot match, so
blocks are sets of template words.

A notice may be broken over lines.  Across lines a template is met only by a run of words hardly longer than
itself, as a block of 50 words over several lines takes scattered words (German "mit" before an Apache notice)
for a notice.

A null or empty text has no words, no labels and score 0.  Rows are scanned one by one: repeated rows give
repeated results.
"""

from __future__ import annotations

import dataclasses
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import WORD, arrow_bounded, words_of

BLOCK = 50
CONTAINMENT = 90

# Phrases whose occurrences are counted, with their labels: fixed values.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Short forms of licence notices, at most BLOCK / 2 words each.
TEMPLATES = (
    ("mit-notice", "Released under the MIT License"),
    ("mit-notice", "Licensed under the MIT License"),
    ("mit-notice", "This project is licensed under the terms of the MIT license"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
     "software and associated documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "Licensed under the Creative Commons Attribution 4.0 International License"),
    ("cc0", "Released under CC0 1.0 Universal Public Domain Dedication"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are "
     "permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("epl-2.0", "made available under the terms of the Eclipse Public License 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "All rights reserved"),
)


@dataclasses.dataclass(frozen=True)
class Template:
    """A label and the template's different words in global order; ``needed`` of them make a match.

    Across lines these stand within ``run`` words.
    """

    label: str
    words: tuple[bytes, ...]
    needed: int
    run: int = 0

    @property
    def prefix(self) -> tuple[bytes, ...]:
        return self.words[: len(self.words) - self.needed + 1]


def needed_of(size: int, percent: int = CONTAINMENT) -> int:
    """The smallest number of words that is ``percent`` of ``size``."""
    return -(-size * percent // 100)


def document_frequency(documents: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many texts each word of the templates occurs."""
    arrow_bounded(documents.sparkSession)

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update(vocabulary.intersection(words_of(text.as_py())))
        yield pa.record_batch(
            [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
            ["word", "n"],
        )

    counted = (
        documents.select(F.col("text").cast("binary").alias("text"))
        .mapInArrow(count, "word binary, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )
    return {bytes(row.word): row.n for row in counted.collect()}


def ordered_templates(
    documents: DataFrame, templates=TEMPLATES, percent: int = CONTAINMENT
) -> tuple[list[Template], dict[bytes, int]]:
    """Templates with their words rarest first, and the place of each word in that order."""
    lists = [(label, words_of(text.encode())) for label, text in templates]
    vocabulary = frozenset().union(*[words for _, words in lists])
    counts = document_frequency(documents, vocabulary)
    order = {
        word: i for i, word in enumerate(sorted(vocabulary, key=lambda word: (counts.get(word, 0), word)))
    }
    found = [
        Template(
            label,
            tuple(sorted(set(words), key=order.get)),
            needed_of(len(set(words)), percent),
            -(-len(words) * 100 // percent),
        )
        for label, words in lists
        if words
    ]
    return found, order


def blocks_of(words: list[bytes]):
    """Blocks of a line's words."""
    for start in range(0, max(len(words) - BLOCK // 2, 1), BLOCK // 2):
        yield words[start : start + BLOCK]


class Matcher:
    """Finds the templates that a block contains."""

    def __init__(self, templates: list[Template], order: dict[bytes, int]):
        self.order = order
        self.templates = templates
        self.index: dict[bytes, list[tuple[int, int]]] = {}
        for number, template in enumerate(templates):
            for place, word in enumerate(template.prefix):
                self.index.setdefault(word, []).append((number, place))
        self.prefixes = frozenset(self.index)

    def match(self, block: list[bytes]) -> dict[int, float]:
        """Containment of each template met, by its number."""
        own = sorted({word for word in block if word in self.order}, key=self.order.get)
        tried: set[int] = set()
        found: dict[int, float] = {}
        for place, word in enumerate(own):
            for number, at in self.index.get(word, ()):
                template = self.templates[number]
                if number in tried or len(own) < template.needed or place > len(own) - template.needed:
                    continue
                # A word before this one is shared too only if it was looked up already.
                if 1 + min(len(own) - place - 1, len(template.words) - at - 1) < template.needed:
                    continue
                tried.add(number)
                shared = len(set(template.words).intersection(own))
                if shared >= template.needed:
                    found[number] = shared / len(template.words)
        return found


def wrapped(template: Template, words: list[bytes], distinct: set[bytes], lines: list[int]) -> float:
    """Greatest containment of a template in a run over a line end, 0 if none meets it.

    ``lines`` has the first word of each line.
    """
    asked = frozenset(template.words)
    if len(asked.intersection(distinct)) < template.needed:
        return 0.0
    places = [place for place, word in enumerate(words) if word in asked]
    held: Counter = Counter()
    left, best = 0, 0
    for place in places:
        held[words[place]] += 1
        while places[left] <= place - template.run:
            gone = words[places[left]]
            held[gone] -= 1
            if not held[gone]:
                del held[gone]
            left += 1
        if len(held) > best and bisect_right(lines, places[left]) != bisect_right(lines, place):
            best = len(held)
    return best / len(asked) if best >= template.needed else 0.0


def phrase_places(words: list[bytes], distinct: set[bytes], phrases: dict[tuple[bytes, ...], str]):
    """Start and label of every place where a phrase's words stand consecutively."""
    for phrase, label in phrases.items():
        if not distinct.issuperset(phrase):
            continue
        place = -1
        while True:
            try:
                place = words.index(phrase[0], place + 1)
            except ValueError:
                break
            if tuple(words[place : place + len(phrase)]) == phrase:
                yield place, label


_RESULT = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("n_blocks", pa.int64()),
    ]
)
_RESULT_TYPE = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, n_blocks long"
)


def scanned(text: Column | str, templates: list[Template], order: dict[bytes, int], phrases=PHRASES) -> Column:
    """What a text says about licences, as a struct.

    ``score`` is 1 if a phrase occurs, else the highest containment of a template that is met, else 0;
    ``n_blocks`` the number of blocks that meet a template, and of templates met across lines only.
    """
    asked = {tuple(words_of(phrase.encode())): label for phrase, label in phrases.items()}

    def scan(texts: pa.Array) -> pa.Array:
        matcher = Matcher(templates, order)
        rows = []
        for text in texts:
            raw = (text.as_py() or b"").lower()
            words = WORD.findall(raw)
            distinct = set(words)
            places = list(phrase_places(words, distinct, asked))
            base = {label for _, label in places}
            labels, best, blocks = set(base), 1.0 if places else 0.0, 0
            if not matcher.prefixes.isdisjoint(distinct):
                found: dict[int, float] = {}
                lines, size = [], 0
                for line in raw.split(b"\n"):
                    own = WORD.findall(line)
                    lines.append(size)
                    size += len(own)
                    for block in blocks_of(own):
                        met = matcher.match(block)
                        blocks += bool(met)
                        for number, share in met.items():
                            found[number] = max(share, found.get(number, 0.0))
                for number, template in enumerate(templates):
                    if found.get(number, 0.0) < 1 and len(lines) > 1:
                        share = wrapped(template, words, distinct, lines)
                        blocks += share > 0 and number not in found
                        if share > 0:
                            found[number] = max(share, found.get(number, 0.0))
                labels.update(templates[number].label for number in found)
                best = max(best, *found.values(), 0.0)
            starts = [place for place, _ in places]
            rows.append(
                {
                    "n_words": len(words),
                    "n_base": len(places),
                    "first_word": min(starts, default=None),
                    "last_word": max(starts, default=None),
                    "base_labels": ",".join(sorted(base)),
                    "labels": ",".join(sorted(labels)),
                    "score": best,
                    "n_blocks": blocks,
                }
            )
        return pa.array(rows, _RESULT)

    text = F.col(text) if isinstance(text, str) else text
    return F.arrow_udf(scan, _RESULT_TYPE)(text.cast("binary"))


def scan_licenses(documents: DataFrame, templates=TEMPLATES, percent: int = CONTAINMENT) -> DataFrame:
    """One row per document with its words, phrase places, labels and score."""
    found, order = ordered_templates(documents, templates, percent)
    return documents.select("doc_id", scanned("text", found, order).alias("scan")).select("doc_id", "scan.*")
