"""The stored index: Parquet folders partitioned by batch and bin.

    settings/                                bins and hash function
    texts/batch=<name>/                      the index by text, in the order the texts came in
    postings/batch=<name>/bin=<n>/           postings; bin 0 holds the lengths of the batch's texts
    batch_frequency/batch=<name>/bin=<n>/    document frequency within the batch
    blocks/batch=<name>/bin=<n>/             of a sorted batch: what the postings of frequent words can score, by block;
                                             bin 0 holds parts of blocks, which are whole in their own bins
    pairs/batch=<name>/bin=<n>/              of a sorted batch: postings of two frequent words that follow each other
    pair_frequency/batch=<name>/bin=<n>/     and in how many texts they do
    hash_metadata/version=<n>/bin=<n>/       document frequency, replaced as a whole
    commits/entry=<...>/                     one row per finished batch or document frequency
    incoming/                                the texts of a stream's micro-batch while they are indexed

Texts are cut into words once, when the index by text is written; postings are made from it, and the batch's
document frequency from its postings.  A new document frequency is the last one and that of the batches since
then, added up: no posting of an earlier batch is read again.

Writers add their row to ``commits`` last and readers see only what is listed there, so a failed or
running append is invisible.  An entry written again replaces the first attempt.  A batch that rewrites
others, as a whole or some of their bins, says so in its row: readers then leave the rewritten parts out.
"""

from __future__ import annotations

import dataclasses
import math
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators.blocks import BLOCK_TEXTS, merged_edges, sorted_score_blocks
from wordloom.operators.indexing import (
    DEFAULT_BINS,
    Index,
    document_frequency,
    postings_of_texts,
    words_by_text,
)
from wordloom.operators.packing import packed_postings, unpacked_postings
from wordloom.operators.pairs import PAIR_LEAST, PAIR_SHARE, word_pairs
from wordloom.functions.hashing import HASH_FUNCTIONS, hash_bin
from wordloom.session import BROADCAST_ROWS, no_rows, one_row, smaller_partitions, spread

_SETTINGS = "bins int, hash_function string"
# Each attempt at a batch has a name of its own; a document frequency says which attempts it counts.
_COMMITS = (
    "entry string, batch string, attempt string, texts long, words long, postings long, version long, "
    "counted array<string>, replaces array<string>, replaced_bins array<int>, block_texts int, pair_least long"
)
_POSTINGS = (
    "hash string, text_id long, positions array<int>, term_frequency int, words_total int, "
    "batch string, bin int"
)
_METADATA = "hash string, document_count long, version long, bin int"
_FREQUENCY = "hash string, document_count long, batch string, bin int"
_BLOCKS = (
    "hash string, block long, texts long, profile array<struct<term_frequency: int, shortest: int, longest: int>>, "
    "batch string, bin int"
)
_TEXTS = (
    "text_id long, words_total int, hashes binary, frequencies array<int>, positions array<array<int>>, "
    "batch string"
)


def create_index(
    spark: SparkSession, path: str, bins: int = DEFAULT_BINS, hash_function: str = "md5"
) -> None:
    """An empty index; fails if there is one already."""
    hash_bin(F.lit(""), bins)
    if hash_function not in HASH_FUNCTIONS:
        raise ValueError(f"unknown hash function {hash_function!r}, choose one of {HASH_FUNCTIONS}")
    settings = one_row(spark, _SETTINGS, bins=bins, hash_function=hash_function)
    settings.write.mode("error").json(f"{path}/settings")
    # An entry with nothing in it, so that the folder exists.
    _commit(spark, path, "created")


def index_settings(spark: SparkSession, path: str) -> tuple[int, str]:
    return tuple(spark.read.schema(_SETTINGS).json(f"{path}/settings").first())


def commits(spark: SparkSession, path: str) -> DataFrame:
    """Finished batches with their totals, and finished document frequencies."""
    return spark.read.schema(_COMMITS).parquet(f"{path}/commits")


def _commit(spark: SparkSession, path: str, entry: str, **values: int | str) -> None:
    row = one_row(spark, _COMMITS, **values).drop("entry")
    row.write.mode("overwrite").parquet(f"{path}/commits/entry={entry}")


@dataclasses.dataclass(frozen=True)
class _Snapshot:
    """What is finished.

    ``parts`` are the batches to read postings of, with the bins to leave out (None: nothing is left out);
    ``attempts`` the batches that brought texts, ``counted`` the attempts that the last document frequency knows
    and ``uncounted`` how many texts it may not know.
    """

    parts: dict[str, set[int] | None]
    attempts: dict[str, str]
    version: int | None
    counted: set[str]
    texts: int
    words: int
    postings: int
    uncounted: int
    block_texts: int | None
    pair_least: int | None


def _finished(spark: SparkSession, path: str) -> _Snapshot:
    """Commits are a few bytes per batch; ``compact_index`` keeps batches few."""
    rows = commits(spark, path).collect()
    last = max((row for row in rows if row.version is not None), key=lambda row: row.version, default=None)
    counted = set(last.counted) if last else set()
    batches = {row.batch: row for row in rows if row.batch is not None}
    parts: dict[str, set[int] | None] = dict.fromkeys(batches)
    for row in batches.values():
        for name in row.replaces or ():
            if name not in parts:
                continue
            if row.replaced_bins is None:
                del parts[name]
            else:
                parts[name] = (parts[name] or set()) | set(row.replaced_bins)
    own = [row for row in batches.values() if not row.replaces]
    return _Snapshot(
        parts=parts,
        attempts={row.batch: row.attempt for row in own},
        version=last.version if last else None,
        counted=counted,
        texts=sum(row.texts for row in own),
        words=sum(row.words for row in own),
        postings=sum(row.postings for row in own),
        uncounted=sum(row.texts for row in own if row.attempt not in counted),
        # Blocks and pairs are of use only if all texts are in them.
        block_texts=_agreed([row.block_texts for row in own]),
        pair_least=_agreed([row.pair_least for row in own]),
    )


def _agreed(values: list) -> int | None:
    """The value that all rows have."""
    return values[0] if len(set(values)) == 1 else None


def _stored_rows(spark: SparkSession, path: str, parts: dict[str, set[int] | None]) -> DataFrame:
    """Postings and lengths of the given batches; no other folder is looked at."""
    rows = _of_batches(spark, f"{path}/postings", list(parts), _POSTINGS)
    for name, bins in sorted(parts.items()):
        if bins:
            rows = rows.filter((F.col("batch") != name) | ~F.col("bin").isin(sorted(bins)))
    return rows


def text_batches(spark: SparkSession, path: str) -> list[str]:
    """Finished batches that brought texts."""
    return sorted(_finished(spark, path).attempts)


def _of_batches(spark: SparkSession, folder: str, batches: Sequence[str], schema: str) -> DataFrame:
    """Rows of the given batches; no other folder is looked at."""
    if not batches:
        return no_rows(spark, schema)
    reader = spark.read.schema(schema).option("basePath", folder)
    return reader.parquet(*[f"{folder}/batch={name}" for name in sorted(batches)])


def _postings(rows: DataFrame) -> DataFrame:
    return rows.filter("bin > 0").select(
        "bin", "hash", "text_id", "positions", "term_frequency", "words_total"
    )


def _lengths(rows: DataFrame) -> DataFrame:
    return rows.filter("bin = 0").select("text_id", "words_total")


def read_index(spark: SparkSession, path: str) -> Index:
    """The index as it is now.  Later appends do not show; read it again for them."""
    bins, hash_function = index_settings(spark, path)
    found = _finished(spark, path)
    rows = _stored_rows(spark, path, found.parts)
    if found.version is None:
        metadata = no_rows(spark, _METADATA)
    else:
        metadata = spark.read.schema(_METADATA).parquet(_version_folder(path, found.version))
    names = list(found.attempts)
    blocks = pairs = pair_frequency = None
    if found.block_texts is not None:
        blocks = _of_batches(spark, f"{path}/blocks", names, _BLOCKS).filter("bin > 0").drop("batch")
    if found.pair_least is not None:
        pairs = _postings(_of_batches(spark, f"{path}/pairs", names, _POSTINGS))
        pair_frequency = _of_batches(spark, f"{path}/pair_frequency", names, _FREQUENCY).drop("batch")
    return Index(
        postings=_postings(rows),
        word_counts=_lengths(rows),
        hash_metadata=metadata.select("bin", "hash", "document_count"),
        stats=spark.createDataFrame(
            pa.table(
                {
                    "total_documents": pa.array([found.texts], pa.int64()),
                    "average_document_length": pa.array(
                        [found.words / found.texts if found.texts else None], pa.float64()
                    ),
                }
            )
        ),
        text_words=_of_batches(spark, f"{path}/texts", names, _TEXTS).drop("batch"),
        bins=bins,
        hash_function=hash_function,
        known_stats=(found.texts, found.words / found.texts if found.texts else None),
        uncounted_texts=found.uncounted,
        known_postings=found.postings,
        blocks=blocks,
        block_texts=found.block_texts,
        pairs=pairs,
        pair_frequency=pair_frequency,
        pair_least=found.pair_least,
    )


def _version_folder(path: str, version: int) -> str:
    return f"{path}/hash_metadata/version={version}"


def _in_bins(rows: DataFrame) -> DataFrame:
    """Rows of a bin brought together and sorted; a bin too big for a task is split by Spark."""
    order = [name for name in _ORDER if name in rows.columns]
    return rows.hint("rebalance", "bin").sortWithinPartitions(*order)


# How Parquet stores an index: numbers and hashes as differences from the last one (positions of a word and text ids
# rise), and a Bloom filter of hashes for each row group, so that a batch is skipped that has a word's bin but not the word.
# Zstandard finds the hashes that texts share within a page, others look back too little.
_STORED = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary#positions.list.element": "false",
    "parquet.enable.dictionary#positions.list.element.list.element": "false",
    "parquet.enable.dictionary#text_id": "false",
    "parquet.enable.dictionary#hash": "false",
    "parquet.bloom.filter.enabled#hash": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
}
# How postings are sorted in a file.
_ORDER = ("bin", "hash", "text_id")
# How many times smaller postings are while they are packed, about.
_PACKED_TIMES = 4
# Rows of a page of a sorted index: what a scan for some blocks of texts can skip.
_PAGE_ROWS = 4096


def _store(rows: DataFrame, folder: str, by_bin: bool = True, mode: str = "overwrite", **options) -> None:
    writer = rows.write.mode(mode).options(**_STORED, **options)
    (writer.partitionBy("bin") if by_bin else writer).parquet(folder)


def _write_batch(
    spark: SparkSession, path: str, by_text: DataFrame, batch: str, **values: int
) -> tuple[int, int]:
    """Write a batch from its index by text: that itself, postings, document frequency and totals.

    With ``block_texts`` postings are sorted, and blocks of so many ids and, from ``pair_least`` texts on, pairs
    of words are written too.
    """
    bins, _ = index_settings(spark, path)
    _store(by_text, f"{path}/texts/batch={batch}", by_bin=False)
    by_text = _of_batches(spark, f"{path}/texts", [batch], _TEXTS).drop("batch")
    if "block_texts" in values:
        paged = {"parquet.page.row.count.limit": str(_PAGE_ROWS)}
        _store(_sorted_rows(postings_of_texts(by_text, bins)), f"{path}/postings/batch={batch}", **paged)
    else:
        # Postings are sorted after they are unpacked, so what a task gets is bounded by what that makes of it.
        rows = unpacked_postings(packed_postings(by_text, bins).hint("rebalance", "bin"))
        with smaller_partitions(spark, _PACKED_TIMES):
            _store(rows.sortWithinPartitions(*_ORDER), f"{path}/postings/batch={batch}")
    written = _postings(_of_batches(spark, f"{path}/postings", [batch], _POSTINGS))
    _store(_in_bins(document_frequency(written)), f"{path}/batch_frequency/batch={batch}")
    counted = _of_batches(spark, f"{path}/batch_frequency", [batch], _FREQUENCY).drop("batch")
    none = F.lit(0).cast("long")
    totals = by_text.agg(
        F.count("text_id").alias("texts"), F.coalesce(F.sum("words_total"), none).alias("words")
    ).first()
    postings = counted.agg(F.coalesce(F.sum("document_count"), none)).first()[0]
    if "block_texts" in values:
        folder = f"{path}/blocks/batch={batch}"
        # A piece of a file that a task reads is sorted.
        stored = _of_batches(spark, f"{path}/postings", [batch], _POSTINGS)
        piece = F.xxhash64("_metadata.file_path", "_metadata.file_block_start")
        stored = stored.withColumn("segment", piece).filter("bin > 0")
        _store(sorted_score_blocks(stored, counted, values["block_texts"]), folder)
        edges = merged_edges(_of_batches(spark, f"{path}/blocks", [batch], _BLOCKS), bins)
        _store(edges, folder, mode="append")
        values["pair_least"] = max(values["pair_least"], math.ceil(totals.texts * PAIR_SHARE))
        pairs = word_pairs(by_text, counted, values["pair_least"], bins)
        _store(_sorted_rows(pairs), f"{path}/pairs/batch={batch}")
        pairs = _postings(_of_batches(spark, f"{path}/pairs", [batch], _POSTINGS))
        _store(_in_bins(document_frequency(pairs)), f"{path}/pair_frequency/batch={batch}")
    values |= {"texts": totals.texts, "words": totals.words, "postings": postings}
    _commit(spark, path, f"batch-{batch}", batch=batch, attempt=uuid.uuid4().hex, **values)
    return totals.texts, totals.words


def duplicate_ids(texts: DataFrame, known: DataFrame, few: bool) -> DataFrame:
    """Ids of ``texts`` that ``known`` has too; ``few`` texts are broadcast."""
    ids, known = texts.select("text_id"), known.select("text_id")
    if few:
        return known.join(F.broadcast(ids), "text_id", "left_semi")
    return ids.join(known, "text_id", "left_semi")


def append_index(
    texts: DataFrame,
    path: str,
    batch: str | None = None,
    on_duplicate: str = "error",
    among: Sequence[str] | None = None,
) -> tuple[int, int]:
    """Index texts (``text_id``, ``text``) as one batch; returns the numbers of texts and words added.

    Texts that are in the index already, or twice in the batch, are an error; with ``on_duplicate="skip"``
    they are left out, and of several texts with one id in a batch the smallest is taken.  A batch that is
    named again replaces its first attempt; without a name it is a new one.  Document frequency stays as it
    is until it is refreshed.  ``among`` names the batches that may have the texts already, if the caller knows;
    no other batch is looked at then, nor the list of them.
    """
    if on_duplicate not in ("error", "skip"):
        raise ValueError(f"on_duplicate must be 'error' or 'skip', not {on_duplicate!r}")
    spark = texts.sparkSession
    _, hash_function = index_settings(spark, path)
    batch = batch or uuid.uuid4().hex
    texts = spread(texts.select("text_id", "text"), "text_id")

    ids = texts.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("text_id").alias("filled"),
        F.count_distinct("text_id").alias("different"),
        F.min("text_id").alias("lowest"),
        F.max("text_id").alias("highest"),
    ).first()
    if ids.filled != ids.rows or (ids.rows != ids.different and on_duplicate == "error"):
        raise ValueError("texts to append must have a text_id each, and no two the same")
    if ids.rows != ids.different:
        texts = texts.groupBy("text_id").agg(F.min("text").alias("text"))
    others = list(_finished(spark, path).attempts) if among is None else among
    others = [name for name in others if name != batch]
    if others and ids.rows:
        # Lengths are sorted by text id in their files: new numbers skip nearly all of them.
        known = _of_batches(spark, f"{path}/postings", others, _POSTINGS)
        known = _lengths(known).filter(
            F.col("text_id").between(ids.lowest, ids.highest)
        )
        known = duplicate_ids(texts, known, ids.rows <= BROADCAST_ROWS)
        repeated = known.count()
        if repeated and on_duplicate == "error":
            raise ValueError(f"{repeated} texts are in the index already")
        if repeated:
            texts = texts.join(known, "text_id", "left_anti")

    return _write_batch(spark, path, words_by_text(texts, hash_function), batch)


def refresh_document_frequency(spark: SparkSession, path: str) -> int:
    """Document frequency over all finished batches; returns the number of hashes.

    The last one and that of the batches since then are added up, batch by batch counts without reading any
    posting.  Only if a batch that the last one counts was replaced since, all batches' counts are.  The count
    before the last one is removed: readers of an index opened since then do not need it.
    """
    found = _finished(spark, path)
    version = 0 if found.version is None else found.version + 1
    merges = found.version is not None and found.counted <= set(found.attempts.values())
    since = [name for name, attempt in found.attempts.items() if not merges or attempt not in found.counted]
    columns = ["bin", "hash", "document_count"]
    counted = _of_batches(spark, f"{path}/batch_frequency", since, _FREQUENCY).select(*columns)
    if merges:
        last = spark.read.schema(_METADATA).parquet(_version_folder(path, found.version))
        counted = last.select(*columns).unionByName(counted)
    if merges or len(since) != 1:
        counted = _in_bins(counted.groupBy("bin", "hash").agg(F.sum("document_count").alias("document_count")))
    else:
        # The counts of one batch have each hash once and are in bins.
        counted = counted.sortWithinPartitions("bin", "hash")
    folder = _version_folder(path, version)
    _store(counted, folder)
    attempts = F.array(*[F.lit(attempt) for attempt in sorted(found.attempts.values())]).cast("array<string>")
    row = one_row(spark, _COMMITS, version=version).withColumn("counted", attempts).drop("entry")
    row.write.mode("overwrite").parquet(f"{path}/commits/entry=version-{version}")
    if version >= 2:
        remove(spark, _version_folder(path, version - 2))
    return spark.read.schema(_METADATA).parquet(folder).count()


def remove(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """Partitions are ranges of (bin, hash, text_id): a word in a third of all texts is cut into many.

    Hashes move as bytes: no codec finds much to save in the digits of one, and bytes are in the same order.
    """
    moved = rows.withColumn("hash", F.unhex("hash")).repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    return moved.withColumn("hash", F.lower(F.hex("hash")))


def optimize_index(
    spark: SparkSession, path: str, target: str, block_texts: int = BLOCK_TEXTS, pair_least: int = PAIR_LEAST
) -> tuple[int, int]:
    """Rewrite all batches as one, sorted by bin, hash and text id, into a new folder.

    Every file covers a narrow span of hashes that its statistics show to the scan.  Blocks of ``block_texts``
    text ids tell what a frequent word can score in them; words that stand in ``pair_least`` texts, and in a
    share of ``PAIR_SHARE`` of all, have postings of their pairs.  Returns the numbers of texts and words in it.
    """
    bins, hash_function = index_settings(spark, path)
    by_text = _of_batches(spark, f"{path}/texts", list(_finished(spark, path).attempts), _TEXTS).drop("batch")
    create_index(spark, target, bins, hash_function)
    totals = _write_batch(spark, target, by_text, "all", block_texts=block_texts, pair_least=pair_least)
    refresh_document_frequency(spark, target)
    return totals


def compact_index(
    spark: SparkSession,
    path: str,
    batches: Sequence[str] | None = None,
    bins: Sequence[int] | None = None,
) -> str:
    """Rewrite some batches as one, or only some of their bins, sorted; returns the new batch's name.

    Nothing changes for readers but the number of folders; the rewritten ones are left for readers of an
    index that was opened before.
    """
    found = _finished(spark, path)
    chosen = sorted(found.parts if batches is None else batches)
    unknown = [name for name in chosen if name not in found.parts]
    if unknown:
        raise ValueError(f"no such batches: {unknown}")
    rows = _stored_rows(spark, path, {name: found.parts[name] for name in chosen})
    if bins is not None:
        rows = rows.filter(F.col("bin").isin([int(number) for number in bins]))
    name = uuid.uuid4().hex
    _store(_sorted_rows(rows.drop("batch")), f"{path}/postings/batch={name}")
    # Batches that only stand in for these are replaced with them, so that what they replaced stays out.
    values = F.array(*[F.lit(batch) for batch in chosen])
    row = one_row(spark, _COMMITS, batch=name, texts=0, words=0, postings=0).withColumn("replaces", values)
    if bins is not None:
        row = row.withColumn("replaced_bins", F.array(*[F.lit(int(number)) for number in bins]))
    row.drop("entry").write.mode("overwrite").parquet(f"{path}/commits/entry=batch-{name}")
    return name


def write_index(
    texts: DataFrame, path: str, bins: int = DEFAULT_BINS, hash_function: str = "md5"
) -> Index:
    """A new stored index over texts, ready to search."""
    spark = texts.sparkSession
    create_index(spark, path, bins, hash_function)
    append_index(texts, path)
    refresh_document_frequency(spark, path)
    return read_index(spark, path)
