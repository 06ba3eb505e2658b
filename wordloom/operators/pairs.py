"""Postings of two frequent words that follow each other, so that a phrase of them reads neither word's own."""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.hashing import DIGEST_BYTES, hash_bin
from wordloom.operators.grouping import ranges, sorted_runs
from wordloom.session import arrow_bounded

# A word is frequent if this share of all texts has it, and so many texts.  A text of n different words has n of them
# at most, so no more than n / PAIR_SHARE words of an average text are.
PAIR_SHARE = 0.1
PAIR_LEAST = 1_000
# Hashes of pairs that a task keeps at hand.
_KEPT = 1 << 18

# What runs in tasks travels by value, so that executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def pair_hash(one: str, two: str) -> str:
    """The hash of a pair: md5 over both digests."""
    return hashlib.md5(bytes.fromhex(one + two)).hexdigest()


def word_pairs(by_text: DataFrame, counted: DataFrame, least: int, bins: int) -> DataFrame:
    """Postings (like those of words) of all pairs of words that ``least`` texts have each; no shuffle.

    A posting's positions are those of the pair's first word.
    """
    rows = counted.filter(F.col("document_count") >= least).select("hash").collect()
    frequent = np.sort(np.frombuffer(bytes.fromhex("".join(row.hash for row in rows)), f"S{DIGEST_BYTES}"))

    starts = frequent.view(">u8")[::2].astype(np.uint64)

    def numbered(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which digests are frequent, and their numbers; what differs in its first 8 bytes is told apart as a number."""
        own = digests.view(">u8")[::2].astype(np.uint64)
        at = np.flatnonzero(starts[np.minimum(np.searchsorted(starts, own), len(starts) - 1)] == own)
        numbers = np.minimum(np.searchsorted(frequent, digests[at]), len(frequent) - 1)
        same = frequent[numbers] == digests[at]
        return at[same], numbers[same]

    def pairs(batches):
        memo: dict[int, str] = {}

        def hash_of(key: int) -> str:
            if key not in memo:
                if len(memo) >= _KEPT:
                    memo.clear()
                one, two = (bytes(frequent[n]).ljust(DIGEST_BYTES, b"\0").hex() for n in divmod(key, len(frequent)))
                memo[key] = pair_hash(one, two)
            return memo[key]

        for batch in batches:
            lists = batch.column("positions")
            texts, words = lists.offsets.to_numpy(), lists.values.offsets.to_numpy()
            flat = lists.values.values.to_numpy(zero_copy_only=False)
            totals = batch.column("words_total").to_numpy(zero_copy_only=False).astype(np.int64)
            digests = np.frombuffer(b"".join([raw or b"" for raw in batch.column("hashes").to_pylist()]), frequent.dtype)
            if not len(frequent) or not len(digests):
                continue
            # The words of all texts one after the other, as numbers of frequent words or -1.
            before = np.cumsum(totals) - totals
            at, numbers = numbered(digests)
            held = np.repeat(np.arange(len(totals)), np.diff(texts))[at]
            begins, ends = words[texts[0] + at].astype(np.int64), words[texts[0] + at + 1].astype(np.int64)
            sequence = np.full(totals.sum(), -1, np.int64)
            sequence[np.repeat(before[held], ends - begins) + flat[ranges(begins, ends)]] = np.repeat(numbers, ends - begins)
            text = np.repeat(np.arange(len(totals)), totals)
            first = np.flatnonzero((sequence[:-1] >= 0) & (sequence[1:] >= 0) & (text[:-1] == text[1:]))
            different = len(frequent) ** 2
            keys = text[first] * different + sequence[first] * len(frequent) + sequence[first + 1]
            order, keys = sorted_runs(keys, len(totals) * different)
            begins = np.flatnonzero(np.diff(keys, prepend=-1))
            rows, named = np.divmod(keys[begins], different)
            named, places = np.unique(named, return_inverse=True)
            hashes = pa.array([hash_of(key) for key in named.tolist()], pa.string())
            taken, ends = pa.array(rows, pa.int64()), np.append(begins, len(keys))
            positions = first[order] - before[text[first[order]]]
            yield pa.record_batch(
                [
                    hashes.take(pa.array(places, pa.int64())),
                    batch.column("text_id").take(taken),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(positions, pa.int32())),
                    pa.array(np.diff(ends), pa.int32()),
                    batch.column("words_total").take(taken),
                ],
                ["hash", "text_id", "positions", "term_frequency", "words_total"],
            )

    arrow_bounded(by_text.sparkSession)
    made = by_text.select("text_id", "words_total", "hashes", "positions").mapInArrow(
        pairs, "hash string, text_id long, positions array<int>, term_frequency int, words_total int"
    )
    return made.select(hash_bin("hash", bins).alias("bin"), *made.columns)
