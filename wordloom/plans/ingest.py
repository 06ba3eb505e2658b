"""From a corpus to texts, and from texts to an index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from wordloom.operators.indexing import DEFAULT_BINS, Index
from wordloom.sources.corpus import (
    append_texts,
    assign_text_ids,
    create_texts,
    filter_corpus,
    next_text_id,
    read_texts,
)
from wordloom.sources.index import append_index, create_index, read_index, refresh_document_frequency


def ingest_corpus(
    corpus: DataFrame,
    path: str,
    text_bins: int,
    order_by: Sequence[str],
    languages: Sequence[str],
    minimum_score: float,
    max_texts: int | None = None,
    existing: bool = False,
    batch: str | None = None,
) -> int:
    """Filter a corpus, number its texts and add them to the text store; returns how many.

    ``corpus`` has ``language``, ``language_score`` and the columns to store.  A new store gets
    ``text_bins`` bins; with ``existing`` the numbers continue after the highest one in the store.
    """
    spark = corpus.sparkSession
    if not existing:
        create_texts(spark, path, text_bins)
    start = next_text_id(read_texts(spark, path).texts) if existing else 1
    wanted = filter_corpus(corpus, languages, minimum_score).drop("language", "language_score")
    return append_texts(assign_text_ids(wanted, order_by, start, max_texts), path, batch)


def index_texts(
    spark: SparkSession,
    texts_path: str,
    index_path: str,
    bins: int = DEFAULT_BINS,
    hash_function: str = "md5",
) -> Index:
    """Index a whole text store in one job and make it ready to search."""
    create_index(spark, index_path, bins, hash_function)
    append_index(read_texts(spark, texts_path).texts.select("text_id", "text"), index_path)
    refresh_document_frequency(spark, index_path)
    return read_index(spark, index_path)
