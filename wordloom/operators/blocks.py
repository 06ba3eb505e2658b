"""What the postings of frequent words can score at best, block by block of text ids."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.hashing import hash_bin
from wordloom.session import BROADCAST_ROWS, arrow_bounded

# What runs in tasks travels by value, so that executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Text ids of a block.
BLOCK_TEXTS = 1024


def block_of(text_id: Column | str, block_texts: int) -> Column:
    text_id = F.col(text_id) if isinstance(text_id, str) else text_id
    return F.floor(text_id / F.lit(block_texts)).cast("long")


def score_blocks(posting_rows: DataFrame, counted: DataFrame, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """``bin, hash, block, texts, profile`` of the words with at least a block's number of postings.

    ``profile`` lists the term frequencies in the block with the shortest and longest text of each: that bounds
    a score for any tuning, average length and document frequency.  A word's score rises with its frequency and
    falls with the length, or the other way around for words in more than half of all texts.
    """
    rows, _ = _frequent_rows(posting_rows, counted, block_texts)
    return _merged_rows(rows.withColumn("block", block_of("text_id", block_texts)))


def _frequent_rows(posting_rows: DataFrame, counted: DataFrame, block_texts: int) -> tuple[DataFrame, bool]:
    """Postings of the words with a block's number of them, and whether they stand in the order they came in."""
    # A block's number of postings in each word, so these words are that much fewer than postings.
    frequent = counted.filter(F.col("document_count") >= block_texts).select("bin", "hash")
    few = frequent.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return posting_rows.join(F.broadcast(frequent) if few else frequent, ["bin", "hash"], "left_semi"), few


def _merged_rows(rows: DataFrame) -> DataFrame:
    # A hot word's postings are counted on the map side, and meet block by block.
    steps = rows.groupBy("bin", "hash", "block", "term_frequency").agg(
        F.count(F.lit(1)).alias("texts"), F.min("words_total").alias("shortest"), F.max("words_total").alias("longest")
    )
    return _with_profiles(steps)


def _with_profiles(steps: DataFrame) -> DataFrame:
    return steps.groupBy("bin", "hash", "block").agg(
        F.sum("texts").alias("texts"),
        F.sort_array(F.collect_list(F.struct("term_frequency", "shortest", "longest"))).alias("profile"),
    )


_STEP = pa.struct([("term_frequency", pa.int32()), ("shortest", pa.int32()), ("longest", pa.int32())])


def _group_begins(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Where another block of a word begins, and where another segment does."""
    segments = np.diff(rows.column("segment").to_numpy(), prepend=np.int64(0)) != 0
    codes = rows.column("hash").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    changed = segments | (np.diff(codes, prepend=-1) != 0) | (np.diff(rows.column("block").to_numpy(), prepend=0) != 0)
    changed[0] = True
    return np.flatnonzero(changed), np.flatnonzero(segments)


def _in_order(groups: np.ndarray, frequencies: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and lengths sorted within each group; groups are in order."""
    high, long = int(frequencies.max()) + 1, int(lengths.max()) + 1
    if (int(groups[-1]) + 1) * high * long < 2**62:
        # Numbers are sorted several times faster than places of numbers.
        keys = np.sort((groups * high + frequencies) * long + lengths)
        return keys // long % high, keys % long
    order = np.lexsort((lengths, frequencies, groups))
    return frequencies[order], lengths[order]


def _block_rows(rows: pa.Table, begins: np.ndarray, at_edge: np.ndarray) -> pa.RecordBatch:
    """One row for each group of ``rows``, in bin 0 if its segment may not have all of it."""
    sizes = np.diff(np.append(begins, rows.num_rows))
    groups = np.repeat(np.arange(len(begins)), sizes)
    frequencies = rows.column("term_frequency").to_numpy()
    lengths = rows.column("words_total").to_numpy()
    frequencies, lengths = _in_order(groups, frequencies.astype(np.int64), lengths.astype(np.int64))
    different = (np.diff(groups, prepend=-1) != 0) | (np.diff(frequencies, prepend=0) != 0)
    steps = np.flatnonzero(different)
    last = np.append(steps[1:], len(groups)) - 1
    profile = pa.StructArray.from_arrays(
        [pa.array(own, pa.int32()) for own in (frequencies[steps], lengths[steps], lengths[last])], fields=list(_STEP)
    )
    offsets = np.concatenate(([0], np.cumsum(np.bincount(groups[steps], minlength=len(begins)))))
    first = rows.take(pa.array(begins, pa.int64()))
    bins = np.where(at_edge, 0, first.column("bin").to_numpy())
    return pa.record_batch(
        [
            pa.array(bins, pa.int32()),
            first.column("hash").combine_chunks(),
            pa.array(first.column("block").to_numpy(), pa.int64()),
            pa.array(sizes, pa.int64()),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), profile),
        ],
        ["bin", "hash", "block", "texts", "profile"],
    )


def sorted_score_blocks(posting_rows: DataFrame, counted: DataFrame, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """The same of postings sorted by bin, hash and text id within each ``segment``, without a shuffle.

    The rows of a segment come one after the other.  Its first and last block may go on in another segment: they
    have bin 0, and ``merged_edges`` makes blocks of them.
    """
    columns = ["segment", "bin", "hash", "block", "term_frequency", "words_total"]
    rows = posting_rows.withColumn("block", block_of("text_id", block_texts)).select(*columns)
    rows, ordered = _frequent_rows(rows, counted, block_texts)
    if not ordered:
        return _merged_rows(rows)

    def blocks(batches):
        kept, is_first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if kept is not None:
                rows = pa.concat_tables([kept, rows])
            rows = rows.combine_chunks()
            begins, segments = _group_begins(rows)
            # The last group may go on in the next batch.
            done = rows.slice(0, begins[-1])
            segments = segments[segments > 0]
            at_edge = np.isin(begins, segments) | np.isin(np.append(begins[1:], -1), segments)
            at_edge[0] |= is_first
            if done.num_rows:
                yield _block_rows(done, begins[:-1], at_edge[:-1])
                is_first = bool(at_edge[-1])
            kept = rows.slice(begins[-1])
        if kept is not None:
            yield _block_rows(kept.combine_chunks(), np.zeros(1, np.int64), np.ones(1, bool))

    arrow_bounded(posting_rows.sparkSession)
    return rows.select(*columns).mapInArrow(
        blocks,
        "bin int, hash string, block long, texts long, "
        "profile array<struct<term_frequency: int, shortest: int, longest: int>>",
    )


def merged_edges(rows: DataFrame, bins: int) -> DataFrame:
    """Blocks whose postings were in several segments, from their rows in bin 0; these are two a segment at most."""
    rows = rows.filter("bin = 0").select(hash_bin("hash", bins).alias("bin"), "hash", "block", "texts", "profile")
    steps = rows.select("bin", "hash", "block", F.inline("profile"))
    steps = steps.groupBy("bin", "hash", "block", "term_frequency").agg(
        F.min("shortest").alias("shortest"), F.max("longest").alias("longest")
    )
    profiles = _with_profiles(steps.withColumn("texts", F.lit(0).cast("long"))).drop("texts")
    texts = rows.groupBy("bin", "hash", "block").agg(F.sum("texts").alias("texts"))
    return texts.join(profiles, ["bin", "hash", "block"]).select("bin", "hash", "block", "texts", "profile")
