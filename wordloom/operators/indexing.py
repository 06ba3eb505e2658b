"""From texts to a positional index: lengths, postings, document frequency, statistics."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.hashing import JVM_HASHES, digest_at, hash_bin, word_hash
from wordloom.functions.postings import run_starts, runs, words_with_positions
from wordloom.functions.text import with_tokens
from wordloom.operators.grouping import grouped_words
from wordloom.session import BROADCAST_ROWS, written

DEFAULT_BINS = 16


@dataclasses.dataclass(frozen=True)
class Index:
    """The tables that search reads, in memory or stored.

    postings        bin, hash, text_id, positions, term_frequency, words_total
    word_counts     text_id, words_total
    hash_metadata   bin, hash, document_count
    stats           total_documents, average_document_length (one row)
    text_words      text_id, words_total, hashes, frequencies, positions: the same by text
    blocks          bin, hash, block, texts, profile: what frequent words can score in a block of text ids
    pairs           like postings, of two frequent words that follow each other (``pair_hash``)
    pair_frequency  like hash_metadata, of pairs

    A sorted index has the last three.

    A posting repeats the length of its text, so ranking needs no join with ``word_counts``, and its term
    frequency, so only phrase search has to read positions.  A stored index knows its statistics without a
    job, and how many texts document frequency may not count yet.
    """

    postings: DataFrame
    word_counts: DataFrame
    hash_metadata: DataFrame
    stats: DataFrame
    text_words: DataFrame
    bins: int
    hash_function: str
    known_stats: tuple[int, float | None] | None = None
    uncounted_texts: int = 0
    known_postings: int | None = None
    blocks: DataFrame | None = None
    block_texts: int | None = None
    pairs: DataFrame | None = None
    pair_frequency: DataFrame | None = None
    pair_least: int | None = None

    def statistics(self) -> tuple[int, float | None]:
        """Number of texts and their average length."""
        return self.known_stats or tuple(self.stats.first())


def word_counts(texts: DataFrame) -> DataFrame:
    """Length of every text in words; texts without words count 0."""
    return with_tokens(texts).select("text_id", F.size("tokens").alias("words_total"))


def _grouped_words(texts: DataFrame) -> DataFrame:
    return (
        with_tokens(texts)
        .select(
            "text_id",
            F.size("tokens").alias("words_total"),
            words_with_positions("tokens").alias("ordered"),
        )
        .withColumn("starts", run_starts("ordered"))
    )


def text_words(texts: DataFrame) -> DataFrame:
    """One row per distinct word of a text with its positions.  No shuffle."""
    # The generator takes the expression itself: given a column name, Catalyst would infer a filter on
    # it and push a copy of the whole expression down to the scan.
    return _grouped_words(texts).select("text_id", "words_total", F.inline(runs("ordered", "starts")))


def _with_hashes(words: DataFrame, hash_function: str) -> DataFrame:
    if hash_function in JVM_HASHES:
        return words.withColumn("hash", word_hash("word", hash_function))
    # Each different word is hashed once.  The table of words is broadcast if it is small; the words of a
    # hot bin are spread by Spark's skew handling if it is not.
    kept = written(words, "words")
    vocabulary = written(
        kept.filter(F.col("word").isNotNull())
        .select("word")
        .distinct()
        .withColumn("hash", word_hash("word", hash_function))
        .withColumnRenamed("word", "known_word"),
        "vocabulary",
    )
    small = vocabulary.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return kept.join(
        F.broadcast(vocabulary) if small else vocabulary, F.col("word") == F.col("known_word"), "left"
    ).drop("known_word")


def _as_postings(words: DataFrame, bins: int, hash_function: str) -> DataFrame:
    return _with_hashes(words, hash_function).select(
        hash_bin("hash", bins).alias("bin"),
        "hash",
        "text_id",
        "positions",
        F.size("positions").alias("term_frequency"),
        "words_total",
    )


def postings(texts: DataFrame, bins: int = DEFAULT_BINS, hash_function: str = "md5") -> DataFrame:
    """One row per distinct word of a text: bin, hash, text, positions."""
    return _as_postings(text_words(texts), bins, hash_function)


def words_by_text(texts: DataFrame, hash_function: str = "md5") -> DataFrame:
    """The index by text: one row per text with its distinct words.  No shuffle.

    ``hashes`` holds the digests of its words one after the other, ``frequencies`` how often each occurs and
    ``positions`` where, in the same order.
    """
    return grouped_words(with_tokens(texts).select("text_id", "tokens"), hash_function)


def postings_of_texts(by_text: DataFrame, bins: int) -> DataFrame:
    """Postings of an index by text, and in bin 0 one row per text that holds its length."""
    # Place -1 stands for the length.  What a posting holds is looked up after the rows are made: inside the array
    # Spark would work on each of its entries without generated code.
    frequencies = F.concat(F.array(F.lit(None).cast("int")), "frequencies")
    rows = by_text.select(
        "text_id", "words_total", "hashes", "positions", F.posexplode(frequencies).alias("place", "term_frequency")
    )
    place = F.col("place") - 1
    rows = rows.select(
        "text_id",
        "words_total",
        F.when(place >= 0, digest_at(F.col("hashes"), place)).alias("hash"),
        F.when(place >= 0, F.get("positions", place)).alias("positions"),
        "term_frequency",
    )
    return rows.select(
        F.coalesce(hash_bin("hash", bins), F.lit(0)).alias("bin"),
        "hash",
        "text_id",
        "positions",
        "term_frequency",
        "words_total",
    )


def postings_and_lengths(
    texts: DataFrame, bins: int = DEFAULT_BINS, hash_function: str = "md5"
) -> DataFrame:
    """Postings, and in bin 0 one row per text that holds its length, from a single pass over the texts."""
    return postings_of_texts(words_by_text(texts, hash_function), bins)


def posting_positions(posting_rows: DataFrame) -> DataFrame:
    """Postings flattened to one row per word of a text."""
    return posting_rows.select("hash", "text_id", F.explode("positions").alias("position"))


def document_frequency(posting_rows: DataFrame) -> DataFrame:
    """In how many texts each hash occurs; counted on the map side first."""
    return posting_rows.groupBy("bin", "hash").agg(F.count("text_id").alias("document_count"))


def corpus_stats(counts: DataFrame) -> DataFrame:
    """Number of texts and their average length."""
    return counts.agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.avg("words_total").alias("average_document_length"),
    )


def index_totals(counts: DataFrame) -> DataFrame:
    """Number of texts and of words."""
    return counts.agg(
        F.count("text_id").alias("texts_total"),
        F.coalesce(F.sum("words_total"), F.lit(0)).alias("words_total"),
    )


def index_bin_report(posting_rows: DataFrame) -> DataFrame:
    """Postings and distinct hashes per bin.

    Counts hashes first: they are few next to postings, and no bin's postings meet in one task.
    """
    return (
        document_frequency(posting_rows)
        .groupBy("bin")
        .agg(F.sum("document_count").alias("postings"), F.count("hash").alias("hashes"))
    )


def build_index(texts: DataFrame, bins: int = DEFAULT_BINS, hash_function: str = "md5") -> Index:
    """An index that lives only as a plan; store it (``sources.index``) to search it more than once."""
    counts = word_counts(texts)
    posting_rows = postings(texts, bins, hash_function)
    return Index(
        postings=posting_rows,
        word_counts=counts,
        hash_metadata=document_frequency(posting_rows),
        stats=corpus_stats(counts),
        text_words=words_by_text(texts, hash_function),
        bins=bins,
        hash_function=hash_function,
    )
