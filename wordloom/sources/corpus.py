"""Corpus ingest: scan, filter, numbering, and the binned text store."""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions.hashing import text_bin
from wordloom.operators.numbering import numbered
from wordloom.session import no_rows, one_row


def read_corpus(
    spark: SparkSession, path: str, columns: Sequence[str] | dict[str, str] | None = None
) -> DataFrame:
    """Parquet corpus with only the wanted columns; a dict renames, ``{"plain_text": "text"}``."""
    return select_columns(spark.read.parquet(path), columns)


def read_corpus_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    columns: Sequence[str] | dict[str, str] | None = None,
    files_per_batch: int | None = None,
    **options,
) -> DataFrame:
    """New corpus files as a stream, a bounded number of files per batch."""
    reader = spark.readStream.schema(schema).options(**options)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return select_columns(reader.parquet(path), columns)


def select_columns(frame: DataFrame, columns: Sequence[str] | dict[str, str] | None) -> DataFrame:
    if columns is None:
        return frame
    if isinstance(columns, dict):
        return frame.select([F.col(name).alias(alias) for name, alias in columns.items()])
    return frame.select(list(columns))


def filter_corpus(
    corpus: DataFrame,
    languages: Sequence[str],
    minimum_score: float,
    language: str = "language",
    score: str = "language_score",
) -> DataFrame:
    """Texts in one of the languages, recognized with at least the given score."""
    return corpus.filter(F.col(language).isin(list(languages)) & (F.col(score) >= minimum_score))


def assign_text_ids(
    corpus: DataFrame, order_by: Sequence[str], start: int = 1, max_texts: int | None = None
) -> DataFrame:
    """Consecutive ids in the order of ``order_by``, NULLs first; a rerun numbers alike.

    Any rows can be numbered: those that share a key follow each other by a hash of their other columns, and exact
    copies have an id each.  ``max_texts`` keeps the first so many of the whole corpus.
    """
    ids = numbered(corpus, order_by, "text_id", start)
    if max_texts is not None:
        ids = ids.filter(F.col("text_id") < start + max_texts)
    return ids.select("text_id", *corpus.columns)


def next_text_id(texts: DataFrame) -> int:
    """The id after the highest one in use; 1 for no texts."""
    return (texts.agg(F.max("text_id")).first()[0] or 0) + 1


def with_text_bins(texts: DataFrame, bins: int) -> DataFrame:
    return texts.withColumn("text_bin", text_bin("text_id", bins))


# The text store: settings/ (number of bins), texts/batch=<name>/text_bin=<n>/, commits/entry=<name>/.

_SETTINGS = "text_bins int"
_COMMITS = "entry string, texts long"


@dataclasses.dataclass(frozen=True)
class TextStore:
    """Texts with their ``text_bin``, and the number of bins they were written with."""

    texts: DataFrame
    bins: int


def _text_batches(spark: SparkSession, path: str) -> dict[str, int]:
    rows = spark.read.schema(_COMMITS).parquet(f"{path}/commits").collect()
    # A batch without texts has no file.
    return {row.entry: row.texts for row in rows if row.texts}


def create_texts(spark: SparkSession, path: str, bins: int) -> None:
    """An empty text store; fails if there is one already."""
    text_bin(F.lit(0), bins)
    one_row(spark, _SETTINGS, text_bins=bins).write.mode("error").json(f"{path}/settings")
    _commit_texts(spark, path, "created", None)


def _commit_texts(spark: SparkSession, path: str, entry: str, texts: int | None) -> None:
    row = one_row(spark, _COMMITS, texts=texts).drop("entry")
    row.write.mode("overwrite").parquet(f"{path}/commits/entry={entry}")


def append_texts(texts: DataFrame, path: str, batch: str | None = None) -> int:
    """Adds texts with ids of their own to a store; returns how many.

    Each task writes few bins, and big bins are spread over several files, sorted by id.  Readers see the
    batch when it is complete; a batch that is named again replaces its first attempt.
    """
    spark = texts.sparkSession
    bins = text_bins_of(spark, path)
    batch = batch or uuid.uuid4().hex
    folder = f"{path}/texts/batch={batch}"
    (
        with_text_bins(texts, bins)
        .hint("rebalance", "text_bin")
        .sortWithinPartitions("text_bin", "text_id")
        .write.mode("overwrite")
        .option("compression", "zstd")
        .partitionBy("text_bin")
        .parquet(folder)
    )
    added = spark.read.schema("text_id long").parquet(folder)
    ids = added.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("text_id").alias("filled"),
        F.min("text_id").alias("lowest"),
        F.max("text_id").alias("highest"),
    ).first()
    repeated = added.groupBy("text_id").count().filter("count > 1").limit(1).count()
    if ids.filled != ids.rows or repeated:
        raise ValueError("texts to store must have a text_id each, and no two the same")
    others = [name for name in _text_batches(spark, path) if name != batch]
    if others and ids.rows:
        known = _read_batches(spark, path, others).select("text_id")
        known = known.filter(F.col("text_id").between(ids.lowest, ids.highest))
        if not known.join(added, "text_id", "left_semi").isEmpty():
            raise ValueError("texts are in the store already")
    _commit_texts(spark, path, batch, ids.rows)
    return ids.rows


def text_bins_of(spark: SparkSession, path: str) -> int:
    return spark.read.schema(_SETTINGS).json(f"{path}/settings").first()[0]


def _read_batches(spark: SparkSession, path: str, batches: Sequence[str]) -> DataFrame:
    # Only folders of finished batches are listed.
    folders = [f"{path}/texts/batch={name}" for name in sorted(batches)]
    return spark.read.option("basePath", f"{path}/texts").parquet(*folders).drop("batch")


def write_texts(texts: DataFrame, path: str, bins: int) -> TextStore:
    """A new text store with these texts."""
    create_texts(texts.sparkSession, path, bins)
    append_texts(texts, path)
    return read_texts(texts.sparkSession, path)


def read_texts(spark: SparkSession, path: str) -> TextStore:
    """The store as it is now."""
    batches = list(_text_batches(spark, path))
    if not batches:
        return TextStore(no_rows(spark, "text_id long, text string, text_bin int"), text_bins_of(spark, path))
    return TextStore(_read_batches(spark, path, batches), text_bins_of(spark, path))
