"""Matching requests inside texts: the index by text is read once for a block of requests.

A batch that asks for much of the index would move most postings to bring the words of a text together, while in
the index by text they stand together already.  So a block of requests, bounded in its words, goes to every text
instead, and nothing is shuffled: a text meets a request only through the request's rarest word (or, for a phrase,
through two words of it that follow each other), and is tried on the next rarer word only if it has the last.
"""

from __future__ import annotations

import dataclasses
import functools
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.hashing import DIGEST_BYTES
from wordloom.functions.ranking import SCORE_DIGITS
from wordloom.operators.grouping import ranges

# What runs in tasks travels by value, so that executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Matches that a task hands on at once, and matches it keeps to tell the best of.
_MATCHES = 1 << 17
_KEPT = 1 << 20
# A rounded score is that far from the score, for each word.
_ROUNDING = 0.5 * 10.0**-SCORE_DIGITS + 1e-9

_DIGEST = f"S{DIGEST_BYTES}"


def _digests(hashes: pa.ChunkedArray) -> np.ndarray:
    """Digests given as binary values, one after the other."""
    return np.frombuffer(b"".join(hashes.to_pylist()), _DIGEST)


@dataclasses.dataclass(frozen=True)
class Requests:
    """A block of requests by place: request ``i`` has ``words[begins[i]:begins[i + 1]]``, numbers of ``digests``.

    ``digests`` are sorted.  Words stand in the order of their rarity, or as the phrase has them.
    """

    digests: np.ndarray
    words: np.ndarray
    begins: np.ndarray

    @classmethod
    def of(cls, places: np.ndarray, order: np.ndarray, digests: np.ndarray, size: int) -> Requests:
        different, words = np.unique(digests, return_inverse=True)
        sorted_ = np.lexsort((order, places))
        begins = np.concatenate(([0], np.cumsum(np.bincount(places, minlength=size))))
        return cls(different, words[sorted_].astype(np.int32), begins)

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.begins)

    @functools.cached_property
    def _starts(self) -> np.ndarray:
        return _first_bytes(self.digests)

    def known(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which digests the requests ask for, and their numbers."""
        # Numbers are found several times faster than digests; the few that begin alike are looked up as digests.
        own = _first_bytes(digests)
        at = np.minimum(np.searchsorted(self._starts, own), len(self._starts) - 1)
        at = np.flatnonzero(self._starts[at] == own)
        numbers = np.minimum(np.searchsorted(self.digests, digests[at]), len(self.digests) - 1)
        same = self.digests[numbers] == digests[at]
        return at[same], numbers[same]


def _first_bytes(digests: np.ndarray) -> np.ndarray:
    """The first 8 bytes of each digest, as a number."""
    return digests.view(">u8")[::2].astype(np.uint64)


class _ByWord:
    """Requests by a word of theirs: the requests of some words, one after the other."""

    def __init__(self, words: np.ndarray, different: int):
        self._order = np.argsort(words, kind="stable")
        self._begins = np.concatenate(([0], np.cumsum(np.bincount(words, minlength=different))))

    def of(self, words: np.ndarray) -> np.ndarray:
        return self._order[ranges(self._begins[words], self._begins[words + 1])]


class _Grouped:
    """Requests by a key of theirs: the requests of some keys, one after the other."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        self.keys, begins = np.unique(keys[self.order], return_index=True)
        self.begins = np.concatenate((begins, [len(keys)]))

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys have requests, as often as they have, and those requests."""
        if not len(self.keys) or not len(keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        held = np.flatnonzero(self.keys[at] == keys)
        at = at[held]
        begins, ends = self.begins[at], self.begins[at + 1]
        return np.repeat(held, ends - begins), self.order[ranges(begins, ends)]


class WordsInTexts:
    """Finds the requests all of whose words a text has; words by rarity."""

    def __init__(self, requests: Requests):
        self.requests = requests
        self._by_rarest = _ByWord(requests.words[requests.begins[:-1]], len(requests.digests))
        self._sizes = requests.sizes
        self._has = np.zeros(len(requests.digests), bool)

    def match(self, numbers: np.ndarray) -> np.ndarray:
        """Requests matched by a text with the words of these numbers."""
        requests, has = self.requests, self._has
        left = self._by_rarest.of(numbers)
        has[numbers] = True
        done = []
        step = 1
        while len(left):
            over = self._sizes[left] == step
            done.append(left[over])
            left = left[~over]
            left = left[has[requests.words[requests.begins[left] + step]]]
            step += 1
        has[numbers] = False
        return np.concatenate(done) if done else left


class PhrasesInTexts:
    """Finds requests whose words stand next to each other in a text; words as the phrase has them, two at least."""

    def __init__(self, requests: Requests, frequency: np.ndarray):
        self.requests = requests
        self._sizes = sizes = requests.sizes
        begins = requests.begins[:-1]
        # The two neighbours that are rarest together name the places to try.
        own = frequency[requests.words]
        both = np.append(own[:-1] + own[1:], 0)
        # The last word of a request has no neighbour.
        both[requests.begins[1:] - 1] = np.iinfo(np.int64).max
        least = np.repeat(np.minimum.reduceat(both, begins), sizes)
        at = np.flatnonzero(both == least)
        place = np.repeat(np.arange(len(sizes)), sizes)[at]
        _, firsts = np.unique(place, return_index=True)
        self._anchor = at[firsts] - begins
        first = requests.words[begins + self._anchor]
        self._by_pair = _Grouped(self._pairs(first, requests.words[begins + self._anchor + 1]))

    def _pairs(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return one.astype(np.int64) * len(self.requests.digests) + two

    def match(self, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Requests with their numbers of occurrences; ``sequence`` has the word at each position, -1 for others."""
        requests = self.requests
        at = np.flatnonzero((sequence[:-1] >= 0) & (sequence[1:] >= 0))
        held, found = self._by_pair.of(self._pairs(sequence[at], sequence[at + 1]))
        start = at[held] - self._anchor[found]
        sizes = self._sizes[found]
        fits = (start >= 0) & (start + sizes <= len(sequence))
        found, start, sizes = found[fits], start[fits], sizes[fits]
        done, step = [], 0
        while len(found):
            same = sequence[start + step] == requests.words[requests.begins[found] + step]
            found, start, sizes = found[same], start[same], sizes[same]
            step += 1
            over = sizes == step
            done.append(found[over])
            found, start, sizes = found[~over], start[~over], sizes[~over]
        return np.unique(np.concatenate(done) if done else found, return_counts=True)


def _texts(batch: pa.RecordBatch, requests: Requests):
    """Number of each text with words asked for, which of its words these are, and their numbers."""
    raws = [raw or b"" for raw in batch.column("hashes").to_pylist()]
    ends = np.cumsum([len(raw) // DIGEST_BYTES for raw in raws], dtype=np.int64)
    if not len(ends) or not ends[-1]:
        return
    # The words of all texts are looked up at once.
    at, numbers = requests.known(np.frombuffer(b"".join(raws), _DIGEST))
    bounds = np.concatenate(([0], np.searchsorted(at, ends))).tolist()
    begin = 0
    for row, end in enumerate(ends.tolist()):
        own = slice(bounds[row], bounds[row + 1])
        if own.start < own.stop:
            yield row, at[own] - begin, numbers[own]
        begin = end


@dataclasses.dataclass(frozen=True)
class Ranking:
    """What the best ``k`` texts of each request are told by: a score that is not rounded yet.

    ``weights`` has the inverse document frequency of every word of ``Requests``; one that is not known makes all
    scores of its request equal.
    """

    k: int
    weights: np.ndarray
    k1: float
    b: float
    average: float

    @classmethod
    def of(cls, k: int, counts: np.ndarray, documents: int, average: float, k1: float, b: float) -> Ranking:
        with np.errstate(invalid="ignore", divide="ignore"):
            weights = np.log((documents - counts + 0.5) / (counts + 0.5))
        return cls(k, weights, k1, b, average)

    def scores(self, requests: Requests, places: np.ndarray, frequencies: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Score of each match: ``frequencies`` has those of all its words, ``lengths`` that of its text."""
        sizes = requests.sizes[places]
        tf = frequencies.astype(np.float64)
        norm = self.k1 * (1 - self.b + self.b * np.repeat(lengths, sizes) / self.average)
        words = self.weights[ranges(requests.begins[places], requests.begins[places + 1])]
        total = np.add.reduceat(words * tf * (self.k1 + 1) / (tf + norm), np.cumsum(sizes) - sizes)
        return np.nan_to_num(total, nan=0.0, posinf=0.0, neginf=0.0)


@dataclasses.dataclass
class _Matches:
    """Matches of some texts: place, id and length of the text, frequency of each word of the request, score."""

    places: np.ndarray
    text_ids: np.ndarray
    lengths: np.ndarray
    frequencies: np.ndarray
    scores: np.ndarray

    @classmethod
    def joined(cls, parts: list[_Matches]) -> _Matches:
        return cls(*[np.concatenate([getattr(part, name) for part in parts]) for name in cls.__dataclass_fields__])

    def some(self, requests: Requests, chosen: np.ndarray) -> _Matches:
        ends = np.cumsum(requests.sizes[self.places])
        begins = ends - requests.sizes[self.places]
        frequencies = self.frequencies[ranges(begins[chosen], ends[chosen])]
        kept = (self.places, self.text_ids, self.lengths)
        return _Matches(*[own[chosen] for own in kept], frequencies, self.scores[chosen])

    def batches(self, requests: Requests, query_ids: pa.Array, counts: np.ndarray):
        """The matches as Arrow batches, with the document frequency of each word of the request."""
        ends = np.concatenate(([0], np.cumsum(requests.sizes[self.places])))
        for begin in range(0, len(self.places), _MATCHES):
            own = slice(begin, begin + _MATCHES)
            bounds = ends[begin : begin + _MATCHES + 1]
            places = self.places[own]
            offsets = pa.array(bounds - bounds[0], pa.int32())
            words = ranges(requests.begins[places], requests.begins[places + 1])
            columns = [
                query_ids.take(pa.array(places, pa.int64())),
                pa.array(self.text_ids[own], pa.int64()),
                pa.array(self.lengths[own], pa.int32()),
                pa.ListArray.from_arrays(offsets, pa.array(self.frequencies[bounds[0] : bounds[-1]], pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(counts[words], pa.int64())),
            ]
            yield pa.record_batch(columns, ["query_id", "text_id", "words_total", "frequencies", "counts"])


class _Best:
    """The matches of a task that can be among the best ``k`` of their requests.

    A match is left out if ``k`` others of the task beat it by more than both scores can be rounded.  What has been
    handed on counts among the others, so that memory is bounded however many scores are equal.
    """

    def __init__(self, requests: Requests, ranking: Ranking):
        self._requests, self._ranking = requests, ranking
        self._room = 2 * _ROUNDING * (requests.sizes + 1)
        self._bars = np.full(len(requests.sizes), -np.inf)
        self._parts: list[_Matches] = []
        self._size = 0

    def add(self, part: _Matches):
        """Takes matches; yields what there is no room for."""
        reached = np.flatnonzero(part.scores >= self._bars[part.places])
        self._parts.append(part.some(self._requests, reached))
        self._size += len(reached)
        if self._size > _KEPT:
            kept = self._cut()
            if len(kept.places) > _KEPT // 2:
                yield kept
                self._parts, self._size = [], 0
            else:
                self._parts, self._size = [kept], len(kept.places)

    def rest(self):
        if self._parts:
            yield self._cut()

    def _cut(self) -> _Matches:
        found = _Matches.joined(self._parts)
        # Sorted as one number, which takes a fraction of the time of two; scores that are alike in half their digits
        # may come in any order, as the bar is the least of the best.
        falling = (-found.scores).astype(np.float32).view(np.int32).astype(np.int64)
        falling = np.where(falling < 0, falling ^ 0x7FFFFFFF, falling)
        order = np.argsort((found.places.astype(np.int64) << 32) + falling + 2**31)
        places = found.places[order]
        begins = np.flatnonzero(np.diff(places, prepend=-1))
        sizes = np.diff(np.append(begins, len(places)))
        k = self._ranking.k
        begins = begins[sizes >= k]
        if k and len(begins):
            least = found.scores[order[ranges(begins, begins + k)]].reshape(-1, k).min(axis=1)
            at = places[begins]
            self._bars[at] = np.maximum(self._bars[at], least - self._room[at])
        return found.some(self._requests, np.flatnonzero(found.scores >= self._bars[found.places]))


def texts_with_words(
    by_text: DataFrame, requests: Requests, query_ids: pa.Array, kind: str, counts: np.ndarray, ranking: Ranking
) -> DataFrame:
    """``query_id, text_id, words_total, frequencies, counts``: how often a matched text has each word of a request,
    by rarity, and in how many texts that is.

    Texts are left out that cannot be among the best of the request.
    """

    def match(batches):
        matcher = WordsInTexts(requests)
        best = _Best(requests, ranking)
        tf = np.zeros(len(requests.digests), np.int32)

        def part(batch: pa.RecordBatch, rows: list[int], places: list[np.ndarray], found: list[np.ndarray]) -> _Matches:
            rows_ = np.repeat(rows, [len(own) for own in places])
            text_ids = batch.column("text_id").to_numpy(zero_copy_only=False)[rows_]
            lengths = batch.column("words_total").to_numpy(zero_copy_only=False)[rows_]
            places_, frequencies = np.concatenate(places), np.concatenate(found)
            scores = ranking.scores(requests, places_, frequencies, lengths)
            return _Matches(places_, text_ids, lengths, frequencies, scores)

        def taken(matches: _Matches):
            for own in best.add(matches):
                yield from own.batches(requests, query_ids, counts)

        for batch in batches:
            # Of a text that no match needs, nothing but hashes is looked at.
            frequencies = batch.column("frequencies")
            offsets = frequencies.offsets.to_numpy()
            values = frequencies.values.to_numpy(zero_copy_only=False)
            rows, places, found, many = [], [], [], 0
            for row, at, numbers in _texts(batch, requests):
                own = matcher.match(numbers)
                if not len(own):
                    continue
                tf[numbers] = values[offsets[row] + at]
                rows.append(row)
                places.append(own)
                found.append(tf[requests.words[ranges(requests.begins[own], requests.begins[own + 1])]])
                many += len(found[-1])
                if many > _MATCHES:
                    yield from taken(part(batch, rows, places, found))
                    rows, places, found, many = [], [], [], 0
            if rows:
                yield from taken(part(batch, rows, places, found))
        for own in best.rest():
            yield from own.batches(requests, query_ids, counts)

    return by_text.select("text_id", "words_total", "hashes", "frequencies").mapInArrow(
        match, f"query_id {kind}, text_id long, words_total int, frequencies array<int>, counts array<bigint>"
    )


def texts_with_phrases(
    by_text: DataFrame, requests: Requests, query_ids: pa.Array, kind: str, frequency: np.ndarray, least: np.ndarray
) -> DataFrame:
    """``query_id, text_id, words_total, occurrences, minimum_count, phrase_length`` of texts with the words of a request
    next to each other; ``least`` is the document frequency of each request's rarest word."""

    def match(batches):
        matcher = PhrasesInTexts(requests, frequency)
        for batch in batches:
            lists = batch.column("positions")
            texts, words = lists.offsets.to_numpy(), lists.values.offsets.to_numpy()
            flat = lists.values.values.to_numpy(zero_copy_only=False)
            totals = batch.column("words_total").to_pylist()
            rows, places, found = [], [], []
            for row, at, numbers in _texts(batch, requests):
                begins, ends = words[texts[row] + at], words[texts[row] + at + 1]
                sequence = np.full(totals[row], -1, np.int64)
                sequence[flat[ranges(begins, ends)]] = np.repeat(numbers, ends - begins)
                own, occurrences = matcher.match(sequence)
                if len(own):
                    rows.append(np.full(len(own), row))
                    places.append(own)
                    found.append(occurrences)
            if rows:
                taken, at = pa.array(np.concatenate(rows), pa.int64()), np.concatenate(places)
                yield pa.record_batch(
                    [
                        query_ids.take(pa.array(at, pa.int64())),
                        batch.column("text_id").take(taken),
                        batch.column("words_total").take(taken),
                        pa.array(np.concatenate(found), pa.int32()),
                        pa.array(least[at], pa.int64()),
                        pa.array(requests.sizes[at], pa.int32()),
                    ],
                    ["query_id", "text_id", "words_total", "occurrences", "minimum_count", "phrase_length"],
                )

    return by_text.select("text_id", "words_total", "hashes", "positions").mapInArrow(
        match,
        f"query_id {kind}, text_id long, words_total int, occurrences int, minimum_count bigint, phrase_length int",
    )


@dataclasses.dataclass(frozen=True)
class Block:
    """Some requests on the driver: their ids by place, the words of each by rarity with their document frequency.

    Ids are of type ``kind``; they go to the tasks with the words, so the JVM of the driver never has the block.
    """

    query_ids: pa.Array
    kind: str
    places: np.ndarray
    rarity: np.ndarray
    digests: np.ndarray
    counts: np.ndarray

    @classmethod
    def collect(cls, words: DataFrame) -> Block:
        table = words.select("query_id", "rarity", F.unhex("hash").alias("digest"), "document_count").toArrow()
        ids = table.column("query_id").combine_chunks().dictionary_encode()
        return cls(
            ids.dictionary,
            words.schema["query_id"].dataType.simpleString(),
            ids.indices.to_numpy(zero_copy_only=False).astype(np.int32),
            table.column("rarity").to_numpy(),
            _digests(table.column("digest")),
            table.column("document_count").to_numpy(),
        )

    def any_position(
        self, by_text: DataFrame, k: int, documents: int, average: float, k1: float, b: float
    ) -> DataFrame:
        """``query_id, text_id, words_total, frequencies, counts``: both lists are in the same order of words.

        At least the texts that are among the best ``k`` of a request.
        """
        requests = Requests.of(self.places, self.rarity, self.digests, len(self.query_ids))
        counts = self.counts[np.lexsort((self.rarity, self.places))]
        ranking = Ranking.of(k, counts, documents, average, k1, b)
        return texts_with_words(by_text, requests, self.query_ids, self.kind, counts, ranking)

    def phrases(self, by_text: DataFrame, terms: DataFrame) -> DataFrame:
        """``query_id, text_id, words_total, occurrences, minimum_count, phrase_length``."""
        table = terms.select("query_id", "phrase_offset", F.unhex("hash").alias("digest")).toArrow()
        # Requests with a word that is not known are not among the words.
        named = pc.index_in(table.column("query_id"), self.query_ids)
        table = table.filter(named.is_valid())
        places = named.drop_null().to_numpy().astype(np.int32)
        requests = Requests.of(
            places, table.column("phrase_offset").to_numpy(), _digests(table.column("digest")), len(self.query_ids)
        )
        frequency = np.zeros(len(requests.digests), np.int64)
        frequency[np.searchsorted(requests.digests, self.digests)] = self.counts
        least = np.full(len(self.query_ids), np.iinfo(np.int64).max)
        np.minimum.at(least, self.places, self.counts)
        return texts_with_phrases(by_text, requests, self.query_ids, self.kind, frequency, least)
