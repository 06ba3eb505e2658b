"""Postings on their way to their bins: a bin of an Arrow batch of texts moves as one row."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from wordloom.functions.hashing import DIGEST_BYTES, DIGEST_DIGITS
from wordloom.operators.grouping import lists_of, ranges, sorted_runs
from wordloom.session import arrow_bounded

# What runs in tasks travels by value, so that executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# ``digests`` has each hash once and ``counts`` its postings; ``places`` says for each posting which of the row's texts
# it is of, ``frequencies`` how many of ``positions`` are its own.  These are numbers of as few bytes as they need, since
# the usual codec of a shuffle finds nothing to save in the zeros of a number.
_PACKED = (
    "bin int, text_ids array<long>, lengths array<int>, digests binary, counts binary, places binary, "
    "frequencies binary, positions binary"
)
_POSTINGS = "bin int, hash string, text_id long, positions array<int>, term_frequency int, words_total int"


def _bins_of(digests: np.ndarray, bins: int) -> np.ndarray:
    """``hash_bin`` of digests, rows of bytes."""
    remainder = np.zeros(len(digests), np.uint64)
    for group in digests.view(">u4").T:
        # Below 2^52, as there are at most a million bins.
        remainder = (remainder * np.uint64(2**32) + group.astype(np.uint64)) % np.uint64(bins)
    return remainder.astype(np.int64) + 1


def _flat(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def _binaries(offsets: np.ndarray, values: bytes) -> pa.Array:
    """Pieces of some bytes, after a first one without any, which is that of bin 0."""
    offsets = np.append(0, offsets).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _narrow(offsets: np.ndarray, numbers: np.ndarray) -> pa.Array:
    """Numbers from 0 on as bytes, 1, 2, 4 or 8 for each."""
    kind = np.min_scalar_type(numbers.max(initial=0)).newbyteorder("<")
    return _binaries(offsets * kind.itemsize, numbers.astype(kind).tobytes())


def _numbers(raw: bytes, size: int) -> np.ndarray:
    """So many numbers of ``_narrow``."""
    return np.frombuffer(raw, f"<u{len(raw) // size}").astype(np.int64) if size else np.empty(0, np.int64)


def _packed(batch: pa.RecordBatch, bins: int) -> pa.RecordBatch:
    """A row for each bin that the texts have words of, and one of bin 0 with the lengths of all of them."""
    ids = batch.column("text_id").to_numpy(zero_copy_only=False)
    lengths = batch.column("words_total").to_numpy(zero_copy_only=False)
    lists = batch.column("positions")
    texts = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.offsets.to_numpy().astype(np.int64)[texts[0] : texts[-1] + 1]
    flat = lists.values.values.to_numpy(zero_copy_only=False)
    of_text = np.repeat(np.arange(len(ids)), np.diff(texts))

    joined = b"".join([raw or b"" for raw in batch.column("hashes").to_pylist()])
    digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(DIGEST_BYTES), len(of_text), [None, pa.py_buffer(joined)])
    encoded = digests.dictionary_encode()
    different = np.frombuffer(b"".join(encoded.dictionary.to_pylist()), np.uint8).reshape(-1, DIGEST_BYTES)
    bin_of = _bins_of(different, bins)
    ordered = np.argsort(bin_of, kind="stable")
    rank = np.empty(len(ordered), np.int64)
    rank[ordered] = np.arange(len(ordered))
    different, bin_of = different[ordered], bin_of[ordered]

    # Postings by bin and hash, each hash's in the order of the texts.
    order, keys = sorted_runs(rank[encoded.indices.to_numpy()], max(len(ordered), 1))
    counts = np.bincount(keys, minlength=len(ordered))
    found, first = np.unique(bin_of, return_index=True)
    of_words = np.append(first, len(ordered))
    of_postings = np.concatenate(([0], np.cumsum(counts)))[of_words]
    begins, ends = words[:-1][order], words[1:][order]
    frequencies = ends - begins
    of_positions = np.concatenate(([0], np.cumsum(frequencies)))[of_postings]

    # The texts of each row, each once.
    row = np.repeat(np.arange(len(found)), np.diff(of_postings))
    own, places = np.unique(row * len(ids) + of_text[order], return_inverse=True)
    rows, own = np.divmod(own, max(len(ids), 1))
    of_texts = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(found)))))
    places = places - of_texts[row]

    taken = np.concatenate((np.arange(len(ids)), own))
    of_taken = np.append(0, of_texts + len(ids))
    return pa.record_batch(
        [
            pa.array(np.append(0, found), pa.int32()),
            lists_of(of_taken, pa.array(ids[taken], pa.int64())),
            lists_of(of_taken, pa.array(lengths[taken], pa.int32())),
            _binaries(of_words * DIGEST_BYTES, different.tobytes()),
            _narrow(of_words, counts),
            _narrow(of_postings, places),
            _narrow(of_postings, frequencies),
            _narrow(of_positions, flat[ranges(begins, ends)]),
        ],
        ["bin", "text_ids", "lengths", "digests", "counts", "places", "frequencies", "positions"],
    )


def _hexadecimal(digests: bytes) -> pa.Array:
    size = len(digests) // DIGEST_BYTES
    offsets = (np.arange(size + 1) * DIGEST_DIGITS).astype(np.int32)
    return pa.Array.from_buffers(
        pa.string(), size, [None, pa.py_buffer(offsets), pa.py_buffer(digests.hex().encode())]
    )


def _unpacked(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
    """The postings of all rows, and the lengths of those of bin 0."""
    bins = batch.column("bin").to_numpy()
    sizes = np.diff(batch.column("text_ids").offsets.to_numpy())
    ids, lengths = _flat(batch.column("text_ids")), _flat(batch.column("lengths"))
    plain = np.repeat(bins == 0, sizes)
    missing = int(plain.sum())
    of_bin_0 = [
        pa.array(np.zeros(missing), pa.int32()),
        pa.nulls(missing, pa.string()),
        pa.array(ids[plain], pa.int64()),
        pa.nulls(missing, pa.list_(pa.int32())),
        pa.nulls(missing, pa.int32()),
        pa.array(lengths[plain], pa.int32()),
    ]

    columns = [batch.column(name).to_pylist() for name in ("digests", "counts", "places", "frequencies", "positions")]
    counts, places, frequencies, positions = [], [], [], []
    for digests, *packed in zip(*columns, strict=True):
        counts.append(_numbers(packed[0], len(digests) // DIGEST_BYTES))
        places.append(_numbers(packed[1], counts[-1].sum()))
        frequencies.append(_numbers(packed[2], len(places[-1])))
        positions.append(_numbers(packed[3], frequencies[-1].sum()))
    row = np.repeat(np.arange(len(bins)), [len(own) for own in places])
    text = (np.cumsum(sizes) - sizes)[row] + np.concatenate(places)
    counts, frequencies = np.concatenate(counts), np.concatenate(frequencies)
    hashes = _hexadecimal(b"".join(columns[0]))
    of_words = [
        pa.array(bins[row], pa.int32()),
        hashes.take(pa.array(np.repeat(np.arange(len(counts)), counts), pa.int64())),
        pa.array(ids[text], pa.int64()),
        lists_of(np.append(0, np.cumsum(frequencies)), pa.array(np.concatenate(positions), pa.int32())),
        pa.array(frequencies, pa.int32()),
        pa.array(lengths[text], pa.int32()),
    ]
    names = ["bin", "hash", "text_id", "positions", "term_frequency", "words_total"]
    return [pa.record_batch(columns, names) for columns in (of_bin_0, of_words) if len(columns[0])]


def packed_postings(by_text: DataFrame, bins: int) -> DataFrame:
    """The postings and lengths of an index by text, a bin of an Arrow batch of texts in a row; no shuffle.

    A word's hash is in a row once and so are a text's id and length, which makes it a fraction of its postings.
    """

    def packed(batches):
        for batch in batches:
            if batch.num_rows:
                yield _packed(batch, bins)

    arrow_bounded(by_text.sparkSession)
    return by_text.select("text_id", "words_total", "hashes", "positions").mapInArrow(packed, _PACKED)


def unpacked_postings(rows: DataFrame) -> DataFrame:
    """Postings, and in bin 0 one row per text that holds its length; no shuffle."""

    def unpacked(batches):
        for batch in batches:
            if batch.num_rows:
                yield from _unpacked(batch)

    return rows.mapInArrow(unpacked, _POSTINGS)
