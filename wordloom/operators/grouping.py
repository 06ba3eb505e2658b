"""Grouping the words of texts, a batch of texts at a time, for the index by text."""

from __future__ import annotations

import hashlib
import sys
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from wordloom.functions.hashing import DIGEST_BYTES, HASH_FUNCTIONS
from wordloom.session import arrow_bounded

# What runs in tasks travels by value, so that executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def sorted_runs(keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts ``keys``, all below ``limit``, equal ones as they come, and the sorted keys."""
    size = len(keys)
    if limit * max(size, 1) < 2**62:
        # Numbers are sorted several times faster than places of numbers.
        both = np.sort(keys * size + np.arange(size))
        return both % max(size, 1), both // max(size, 1)
    order = np.argsort(keys, kind="stable")
    return order, keys[order]


def ranges(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of some ranges, one range after the other."""
    sizes = ends - begins
    before = np.cumsum(sizes) - sizes
    return np.repeat(begins - before, sizes) + np.arange(sizes.sum())


def lists_of(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _grouped(batch: pa.RecordBatch, digest) -> pa.RecordBatch:
    """The words of each text in the order of their bytes, each once."""
    lists = batch.column("tokens")
    texts = lists.offsets.to_numpy().astype(np.int64)
    texts = texts - texts[0]
    sizes = np.diff(texts)
    encoded = lists.flatten().dictionary_encode()
    words = encoded.dictionary.cast(pa.binary())
    ordered = pc.sort_indices(words)
    rank = np.empty(len(words), np.int64)
    rank[ordered.to_numpy()] = np.arange(len(words))
    digests = b"".join([digest(word).digest() for word in words.take(ordered).to_pylist()])
    digests = np.frombuffer(digests, f"V{DIGEST_BYTES}")

    different = max(len(words), 1)
    keys = np.repeat(np.arange(len(sizes)), sizes) * different + rank[encoded.indices.to_numpy()]
    order, keys = sorted_runs(keys, len(sizes) * different)
    positions = np.arange(len(keys)) - np.repeat(texts[:-1], sizes)
    begins = np.flatnonzero(np.diff(keys, prepend=-1))
    rows, found = np.divmod(keys[begins], different)
    groups = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(sizes)))))
    ends = np.append(begins, len(keys))
    hashes = pa.Array.from_buffers(
        pa.binary(),
        len(sizes),
        [None, pa.py_buffer((groups * DIGEST_BYTES).astype(np.int32)), pa.py_buffer(digests[found].tobytes())],
    )
    return pa.record_batch(
        [
            batch.column("text_id"),
            pa.array(sizes, pa.int32()),
            hashes,
            lists_of(groups, pa.array(np.diff(ends), pa.int32())),
            lists_of(groups, lists_of(ends, pa.array(positions[order], pa.int32()))),
        ],
        ["text_id", "words_total", "hashes", "frequencies", "positions"],
    )


def grouped_words(rows: DataFrame, hash_function: str) -> DataFrame:
    """``text_id, words_total, hashes, frequencies, positions`` of rows of ``text_id, tokens``; no shuffle."""
    if hash_function not in HASH_FUNCTIONS:
        raise ValueError(f"unknown hash function {hash_function!r}, choose one of {HASH_FUNCTIONS}")
    digest = hashlib.md5 if hash_function == "md5" else partial(hashlib.blake2b, digest_size=DIGEST_BYTES)

    def grouped(batches):
        for batch in batches:
            yield _grouped(batch, digest)

    arrow_bounded(rows.sparkSession)
    kind = rows.schema["text_id"].dataType.simpleString()
    return rows.select("text_id", "tokens").mapInArrow(
        grouped,
        f"text_id {kind}, words_total int, hashes binary, frequencies array<int>, positions array<array<int>>",
    )
