"""Queries over the test tables, each with the SQL that must give the same rows.

Search queries run against a stored index over all ``documents``.  It is built from the table once per
session and folder, in the shared folder of the session.
"""

from __future__ import annotations

import pathlib
import sys
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from wordloom import (  # noqa: E402
    append_index,
    build_index,
    compact_index,
    create_index,
    index_texts,
    ingest_corpus,
    match_all,
    optimize_index,
    read_index,
    refresh_document_frequency,
    search,
    search_any_position,
    search_phrase,
    search_word,
    stream_index,
    write_index,
)
from wordloom.functions.hashing import digest_at
from wordloom.functions.text import with_tokens
from wordloom.operators import indexing
from wordloom.operators.pairs import PAIR_SHARE
from wordloom.operators.requests import request_terms
from wordloom.plans.matching import match_all_by_intersection, request_plan
from wordloom.session import new_shared_path
from wordloom.sources import corpus
from wordloom.sources.index import commits

try:
    import corpus_pipeline
    from wordloom.llm import queries as llm
except ModuleNotFoundError as missing:
    # Both are taken away together; anything else that is missing is an error.
    if missing.name not in ("corpus_pipeline", "wordloom.llm"):
        raise
    corpus_pipeline = llm = None

TEXT_BINS = 7
MANY_BINS = 100

WORDS = ["in", "the", "of", "elle", "être", "oire"]
PHRASES = ["of the", "the and", "in the", "que le", "la de", "elle", "The, THE", "the zzzunknown"]
MIXED = ["of the", "the and", "elle être", "the the", "oire", "la zzzunknown", "zzzunknown", "?!", ""]

FREQUENT = ["the", "of the", "la de", "und die", "elle la"]

_indexes: dict[tuple[str, str, str], object] = {}


# Inputs


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("doc_id").alias("text_id"), "text")


def titled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.read_corpus(
        spark,
        f"{sf_dir}/documents.parquet",
        {"doc_id": "text_id", "source": "title", "text": "text"},
    )


def benchmark_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a request."""
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("request")
    )


def _numbered_requests(texts_of_requests: DataFrame) -> DataFrame:
    """Different texts as requests, numbered in their order."""
    return corpus.assign_text_ids(texts_of_requests.distinct(), ["request"]).select(
        F.col("text_id").alias("query_id"), "request"
    )


def word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of words that follow each other in conversations."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = with_tokens(turns.select("text"), "text", "tokens").filter(F.size("tokens") > 1)
    places = F.sequence(F.lit(1), F.size("tokens") - 1)
    pairs = F.transform(places, lambda place: F.array_join(F.slice("tokens", place, 2), " "))
    return _once(
        spark, sf_dir, "pairs", lambda: _numbered_requests(found.select(F.explode(pairs).alias("request")))
    )


def word_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of conversations, and every three words that follow each other in them."""
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter(F.col("text").isNotNull())
    found = with_tokens(said.select("text"), "text", "tokens")
    places = F.sequence(F.lit(1), F.size("tokens") - 2)
    triples = F.transform(places, lambda place: F.array_join(F.slice("tokens", place, 3), " "))
    asked = F.when(F.size("tokens") > 2, F.concat(F.array("text"), triples)).otherwise(F.array("text"))
    return _once(
        spark, sf_dir, "triples", lambda: _numbered_requests(found.select(F.explode(asked).alias("request")))
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of conversations as requests."""
    found = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter(F.col("text").isNotNull())
    return _once(
        spark, sf_dir, "turns", lambda: _numbered_requests(found.select(F.col("text").alias("request")))
    )


def requests(spark: SparkSession, texts_of_requests: list[str]) -> DataFrame:
    asked = F.array(*[F.lit(text) for text in texts_of_requests])
    return spark.range(0, 1, 1, 1).select(F.posexplode(asked).alias("query_id", "request")).select(
        F.col("query_id").cast("long"), "request"
    )


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _indexes:
        _indexes[key] = make()
    return _indexes[key]


def stored_index(spark: SparkSession, sf_dir: str):
    def make():
        return write_index(texts(spark, sf_dir), new_shared_path(spark, "index"))

    return _once(spark, sf_dir, "index", make)


def stored_texts(spark: SparkSession, sf_dir: str) -> corpus.TextStore:
    def make():
        return corpus.write_texts(titled_texts(spark, sf_dir), new_shared_path(spark, "texts"), TEXT_BINS)

    return _once(spark, sf_dir, "texts", make)


def appended_index(spark: SparkSession, sf_dir: str):
    """An index whose document frequency does not know half of its texts."""

    def make():
        path = new_shared_path(spark, "stale")
        create_index(spark, path)
        rows = titled_texts(spark, sf_dir)
        append_index(rows.filter("title < 'src5'"), path)
        refresh_document_frequency(spark, path)
        append_index(rows.filter("title >= 'src5' OR title IS NULL"), path)
        return read_index(spark, path)

    return _once(spark, sf_dir, "stale", make)


def blake2b_index(spark: SparkSession, sf_dir: str):
    def make():
        path = new_shared_path(spark, "blake2b")
        return write_index(texts(spark, sf_dir), path, MANY_BINS, "blake2b")

    return _once(spark, sf_dir, "blake2b", make)


BLOCK_TEXTS = 32
PAIR_LEAST = 20


def sorted_index(spark: SparkSession, sf_dir: str):
    """An index rewritten in order, with blocks and pairs."""

    def make():
        path, target = new_shared_path(spark, "unsorted"), new_shared_path(spark, "sorted")
        write_index(texts(spark, sf_dir), path)
        optimize_index(spark, path, target, BLOCK_TEXTS, PAIR_LEAST)
        return read_index(spark, target)

    return _once(spark, sf_dir, "sorted", make)


# Corpus


def wanted_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = corpus.read_corpus(
        spark,
        f"{sf_dir}/documents.parquet",
        {
            "doc_id": "doc_id",
            "source": "title",
            "text": "text",
            "lang": "language",
            "n_chars": "language_score",
        },
    )
    return corpus.filter_corpus(source, ["fr", "en"], 500).drop("language", "language_score")


def corpus_text_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.assign_text_ids(wanted_corpus(spark, sf_dir), ["doc_id"])


def corpus_max_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.assign_text_ids(
        wanted_corpus(spark, sf_dir), ["doc_id"], start=1001, max_texts=250
    ).select("text_id", "doc_id")


def conversation_text_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    return corpus.assign_text_ids(turns, ["conv_id", "turn"])


def corpus_text_ids_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key is not theirs alone, exact copies among them."""
    rows = documents(spark, sf_dir).select("source", "text")
    return corpus.assign_text_ids(rows, ["source", "text"])


def corpus_text_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_texts(spark, sf_dir).texts.select(F.col("text_bin").cast("long"), "text_id", "title", "text")


# Index


def _joined(column: str):
    return F.array_join(F.col(column).cast("array<string>"), ",")


def _long(*columns: str):
    return [F.col(column).cast("long").alias(column) for column in columns]


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_tokens(texts(spark, sf_dir))
    return found.select("text_id", F.array_join("tokens", " ").alias("tokens"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.word_counts(texts(spark, sf_dir)).select("text_id", *_long("words_total"))


def _postings_view(rows: DataFrame) -> DataFrame:
    return rows.select(
        "hash",
        "text_id",
        _joined("positions").alias("positions"),
        *_long("term_frequency", "words_total"),
    )


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings_view(indexing.postings(texts(spark, sf_dir)))


def posting_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indexing.postings(texts(spark, sf_dir))
    return indexing.posting_positions(rows).select("hash", "text_id", *_long("position"))


def postings_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indexing.postings(texts(spark, sf_dir), MANY_BINS)
    return rows.select(*_long("bin"), "hash", "text_id")


def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indexing.postings(texts(spark, sf_dir))
    return indexing.document_frequency(rows).select("hash", "document_count")


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = indexing.corpus_stats(indexing.word_counts(texts(spark, sf_dir)))
    return stats.withColumn("average_document_length", F.round("average_document_length", 6))


def index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.index_totals(indexing.word_counts(texts(spark, sf_dir)))


def index_bin_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indexing.postings(texts(spark, sf_dir), MANY_BINS)
    return indexing.index_bin_report(rows).select(*_long("bin", "postings", "hashes"))


def stored_index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings_view(stored_index(spark, sf_dir).postings)


def stored_index_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_index(spark, sf_dir).word_counts.select("text_id", *_long("words_total"))


def stored_index_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_index(spark, sf_dir).hash_metadata.select("hash", "document_count")


def optimized_index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends rewritten as one sorted index."""
    path, target = new_shared_path(spark, "appends"), new_shared_path(spark, "optimized")
    create_index(spark, path)
    rows = titled_texts(spark, sf_dir)
    append_index(rows.filter("title < 'src5'"), path)
    append_index(rows.filter("title >= 'src5' OR title IS NULL"), path)
    optimize_index(spark, path, target)
    return _postings_view(read_index(spark, target).postings)


def posting_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings joined with the lengths of their texts."""
    index = stored_index(spark, sf_dir)
    return (
        index.postings.select("hash", "text_id", "term_frequency")
        .join(index.word_counts, "text_id", "left")
        .select("hash", "text_id", *_long("term_frequency", "words_total"))
    )


def index_batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of several appends added."""
    path = new_shared_path(spark, "batches")
    create_index(spark, path)
    rows = titled_texts(spark, sf_dir)
    append_index(rows.filter("title < 'src2'"), path, "first")
    append_index(rows.filter("title >= 'src2' OR title IS NULL"), path, "second")
    found = commits(spark, path).filter("batch IS NOT NULL")
    return found.select("batch", F.col("texts").alias("texts_added"), F.col("words").alias("words_added"))


def words_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index by text, its hashes one by one."""
    rows = stored_index(spark, sf_dir).text_words
    found = rows.select("text_id", *_long("words_total"), F.posexplode("frequencies").alias("place", "term_frequency"), "hashes", "positions")
    return found.select(
        "text_id",
        "words_total",
        digest_at(F.col("hashes"), F.col("place")).alias("hash"),
        *_long("term_frequency"),
        F.array_join(F.get("positions", F.col("place")).cast("array<string>"), ",").alias("positions"),
    )


def index_score_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What frequent words can score, block by block."""
    steps = F.transform(
        "profile", lambda step: F.concat_ws(":", step.term_frequency, step.shortest, step.longest)
    )
    return sorted_index(spark, sf_dir).blocks.select("hash", "block", "texts", F.array_join(steps, ",").alias("profile"))


def index_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of pairs of frequent words."""
    return _postings_view(sorted_index(spark, sf_dir).pairs)


def index_pair_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorted_index(spark, sf_dir).pair_frequency.select("hash", "document_count")


def compacted_index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three appends; two of them rewritten as one, then some bins of all."""
    path = new_shared_path(spark, "compacted")
    create_index(spark, path)
    rows = titled_texts(spark, sf_dir)
    for batch, wanted in (("a", "title < 'src2'"), ("b", "title BETWEEN 'src2' AND 'src5'"), ("c", "title > 'src5' OR title IS NULL")):
        append_index(rows.filter(wanted), path, batch)
    compact_index(spark, path, ["a", "b"])
    compact_index(spark, path, bins=[2, 5])
    return _postings_view(read_index(spark, path).postings)


# Bytes of different texts in a file of the stream, about.
STREAM_FILE_BYTES = 128 << 20


def _streamed_index(spark: SparkSession, sf_dir: str):
    """An index from a stream of files, with texts that come again in the same micro-batch and in later ones."""

    def make():
        path, checkpoint = new_shared_path(spark, "streamed"), new_shared_path(spark, "progress")
        files = new_shared_path(spark, "files")
        rows = documents(spark, sf_dir).select("doc_id", "text")
        number = F.coalesce("doc_id", F.lit(0))
        # The stream takes files by number, so these have a size, however many files the table comes in.
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        many = max(4, size // (4 * STREAM_FILE_BYTES))
        for part in range(4):
            own = rows.filter(number % 4 == part)
            again = rows.filter((number % 4 == (part - 1) % 4) & (number % 8 < 4))
            twice = own.filter(number % 3 == 0)
            own.unionByName(again).unionByName(twice).coalesce(many).write.mode("append").parquet(files)
        create_index(spark, path)
        source = corpus.read_corpus_stream(
            spark, files, rows.schema, {"doc_id": "text_id", "text": "text"}, files_per_batch=4
        )
        stream_index(source, path, checkpoint).awaitTermination()
        refresh_document_frequency(spark, path)
        return read_index(spark, path)

    return _once(spark, sf_dir, "streamed", make)


def streamed_index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings_view(_streamed_index(spark, sf_dir).postings)


def streamed_index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _streamed_index(spark, sf_dir)
    totals = indexing.index_totals(index.word_counts)
    hashes = index.hash_metadata.agg(
        F.count("hash").alias("hashes"), F.sum("document_count").alias("postings")
    )
    both = totals.unionByName(hashes, allowMissingColumns=True)
    return both.agg(*[F.max(column).alias(column) for column in both.columns])


# Requests and search


def request_terms_of_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_terms(benchmark_requests(spark, sf_dir)).select(
        "query_id", *_long("phrase_offset"), "term", "hash", *_long("slots", "distinct_words")
    )


def request_plan_of_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_plan(stored_index(spark, sf_dir), benchmark_requests(spark, sf_dir)).select(
        "query_id", *_long("rarity"), "term", "hash", "document_count"
    )


def match_all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match_all(stored_index(spark, sf_dir), requests(spark, MIXED))
    return found.select("query_id", "text_id", "hash", _joined("positions").alias("positions"))


def match_all_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = stored_index(spark, sf_dir)
    return match_all_by_intersection(index, requests(spark, ["in the of"]), 0)


def _search(find, asked, index, spark: SparkSession, sf_dir: str) -> DataFrame:
    if not callable(asked):
        asked = partial(lambda texts_of_requests, spark, _: requests(spark, texts_of_requests), asked)
    found = find(index(spark, sf_dir), asked(spark, sf_dir))
    return found.select(
        "query_id", *_long("result_number"), "text_id", "bm25_score", "matching_words"
    )


def _with_texts(found: DataFrame) -> DataFrame:
    return found.withColumn("result_number", F.col("result_number").cast("long"))


def search_with_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, store = stored_index(spark, sf_dir), stored_texts(spark, sf_dir)
    return _with_texts(search(index, requests(spark, PHRASES), k=5, texts=store))


def search_with_many_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """So many results that their texts are not looked up one by one."""
    index, store = stored_index(spark, sf_dir), stored_texts(spark, sf_dir)
    return _with_texts(search(index, requests(spark, MIXED), k=250, method="any_position", texts=store))


def ingest_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: source, filter, ids, text store, index of the store, sorted index, search, texts."""
    store, index, target = (new_shared_path(spark, name) for name in ("store", "flow", "flow-sorted"))
    source = corpus.read_corpus(
        spark,
        f"{sf_dir}/documents.parquet",
        {"doc_id": "document", "source": "title", "text": "text", "lang": "language", "n_chars": "language_score"},
    )
    ingest_corpus(source, store, TEXT_BINS, ["document"], ["fr", "en"], 500)
    index_texts(spark, store, index, MANY_BINS)
    optimize_index(spark, index, target)
    found = search(
        read_index(spark, target), requests(spark, PHRASES), k=5, texts=corpus.read_texts(spark, store)
    )
    return _with_texts(found)


def entry(spark: SparkSession) -> DataFrame:
    """Ten best documents for a request of two words, from documents to ranking in one plan."""
    index = build_index(texts(spark, "/root/testdata/sf0.001"))
    return search_any_position(index, requests(spark, ["of the"]))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every operator of the engine; each callable takes (spark, sf_dir)."""
    return search_queries() | (llm.queries() | {"pipeline": corpus_pipeline.run} if llm else {})


def search_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:

    def found(find, asked, index=stored_index, **options):
        return partial(_search, partial(find, **options), asked, index)

    return {
        "corpus_filter": wanted_corpus,
        "corpus_text_ids": corpus_text_ids,
        "corpus_max_texts": corpus_max_texts,
        "conversation_text_ids": conversation_text_ids,
        "corpus_text_ids_with_copies": corpus_text_ids_with_copies,
        "corpus_text_bins": corpus_text_bins,
        "tokens": tokens,
        "word_counts": word_counts,
        "postings": postings,
        "posting_positions": posting_positions,
        "postings_bins": postings_bins,
        "posting_lengths": posting_lengths,
        "document_frequency": document_frequency,
        "corpus_stats": corpus_stats,
        "index_totals": index_totals,
        "index_bin_report": index_bin_report,
        "stored_index_postings": stored_index_postings,
        "stored_index_word_counts": stored_index_word_counts,
        "stored_index_document_frequency": stored_index_document_frequency,
        "optimized_index_postings": optimized_index_postings,
        "compacted_index_postings": compacted_index_postings,
        "words_by_text": words_by_text,
        "index_score_blocks": index_score_blocks,
        "index_pairs": index_pairs,
        "index_pair_frequency": index_pair_frequency,
        "index_batch_totals": index_batch_totals,
        "streamed_index_counts": streamed_index_counts,
        "streamed_index_postings": streamed_index_postings,
        "request_terms": request_terms_of_benchmark,
        "request_plan": request_plan_of_benchmark,
        "match_all": match_all_words,
        "match_all_intersect": match_all_intersect,
        "search_word": found(search_word, WORDS),
        "search_any_position": found(search_any_position, MIXED),
        "search_phrase": found(search_phrase, PHRASES),
        "search_phrase_repeated_word": found(search_phrase, ["the the", "la la la"], k=100),
        "search_unknown_word_drop": found(search_any_position, ["the zzzunknown"], k=50),
        "search_unknown_word_require": found(
            search_any_position, ["the zzzunknown", "of the"], k=50, unknown_terms="require"
        ),
        "search_custom_k1_b": found(search_any_position, MIXED, k1=1.2, b=0.4),
        "search_phrase_custom_k1_b": found(search_phrase, PHRASES, k1=0.9, b=1.0),
        "search_all_results": found(search_any_position, MIXED, k=100_000),
        "search_batch_topk": found(search_any_position, benchmark_requests, k=20),
        "search_batch_phrase_topk": found(search_phrase, benchmark_requests, k=20),
        "search_dispatch_one_word": found(search, WORDS, method="any_position"),
        "search_dispatch_phrase": found(search, MIXED),
        "search_after_append": found(search_any_position, MIXED, appended_index, k=50),
        "search_blake2b": found(search_any_position, MIXED, blake2b_index),
        "search_word_pairs": found(search_any_position, word_pairs, k=5),
        "search_word_pairs_phrase": found(search_phrase, word_pairs, k=5),
        "search_turns": found(search_any_position, turns, k=5),
        "search_turns_phrase": found(search_phrase, word_triples, k=5),
        "search_phrase_pairs": found(search_phrase, PHRASES, sorted_index),
        "search_early_stop": found(search_any_position, FREQUENT, sorted_index, k=3, early_postings=100),
        "search_early_stop_k1_b": found(
            search_any_position, FREQUENT, sorted_index, k=1, k1=0.6, b=0.9, early_postings=100
        ),
        "search_sorted_index": found(search_any_position, MIXED, sorted_index, k=100),
        "search_with_texts": search_with_texts,
        "search_with_many_texts": search_with_many_texts,
        "ingest_index_search": ingest_index_search,
    }


# The same in SQL

_WORD = r"\p{Nd}+|[\p{L}\p{M}]+|[^\s\p{L}\p{M}\p{N}\p{P}$+<=>^`|~]+"


def _tokens_sql(column: str) -> str:
    return f"regexp_extract_all(lower(strip_accents({column})), '{_WORD}')"


def _index_sql(source: str = "SELECT doc_id AS text_id, text FROM documents", counted: str = "true") -> str:
    """The tables of an index over ``source``; document frequency counts the texts that are ``counted``."""
    return f"""
    source AS ({source}),
    tokens AS (SELECT text_id, {_tokens_sql("text")} AS tokens FROM source),
    word_counts AS (SELECT text_id, CAST(len(tokens) AS BIGINT) AS words_total FROM tokens),
    flat AS (
        SELECT text_id, unnest(tokens) AS word, unnest(range(len(tokens))) AS position FROM tokens
    ),
    words AS (
        SELECT word, text_id, list(position ORDER BY position) AS positions,
            count(*) AS term_frequency
        FROM flat GROUP BY word, text_id
    ),
    postings AS (
        SELECT md5(word) AS hash, text_id, positions, term_frequency, words_total
        FROM words JOIN word_counts USING (text_id)
    ),
    metadata AS (
        SELECT hash, count(*) AS document_count FROM postings
        WHERE text_id IN (SELECT text_id FROM source WHERE {counted}) GROUP BY hash
    ),
    stats AS (
        SELECT count(*) AS total_documents, avg(words_total) AS average_document_length
        FROM word_counts
    )"""


_INDEX = _index_sql()

_POSTINGS = f"""WITH {_INDEX}
    SELECT hash, text_id, array_to_string(positions, ',') AS positions, term_frequency, words_total
    FROM postings"""

_CHUNKS = [f"CAST('0x' || substr(hash, {start}, 8) AS BIGINT)" for start in (1, 9, 17, 25)]
_BIN = "0"
for _chunk in _CHUNKS:
    _BIN = f"(({_BIN}) * 4294967296 + {_chunk}) % {MANY_BINS}"
_BIN = f"CAST({_BIN} + 1 AS BIGINT)"

_BENCHMARK = "requests AS (SELECT item_id AS query_id, text AS request FROM benchmark)"

_PAIRS = f"""
    spoken AS (SELECT {_tokens_sql("text")} AS tokens FROM conversations),
    asked_texts AS (
        SELECT DISTINCT array_to_string(list_slice(tokens, place, place + 1), ' ') AS request
        FROM (SELECT tokens, unnest(range(1, len(tokens))) AS place FROM spoken)
    ),
    requests AS (SELECT row_number() OVER (ORDER BY request) AS query_id, request FROM asked_texts)"""

_TRIPLES = f"""
    spoken AS (SELECT text, {_tokens_sql("text")} AS tokens FROM conversations WHERE text IS NOT NULL),
    requests AS (
        SELECT row_number() OVER (ORDER BY request) AS query_id, request FROM (
            SELECT text AS request FROM spoken UNION
            SELECT array_to_string(list_slice(tokens, place, place + 2), ' ')
            FROM (SELECT tokens, unnest(range(1, len(tokens) - 1)) AS place FROM spoken WHERE len(tokens) > 2)
        )
    )"""

# Words that stand in enough texts, and two of them that follow each other.
_PAIR_POSTINGS = f"""
    frequent AS (
        SELECT hash FROM metadata, stats
        WHERE document_count >= greatest({PAIR_LEAST}, ceil(total_documents * {PAIR_SHARE}))
    ),
    places AS (SELECT text_id, position, md5(word) AS hash FROM flat),
    neighbours AS (
        SELECT one.text_id, one.position, md5(unhex(one.hash || two.hash)) AS hash
        FROM places one JOIN places two ON one.text_id = two.text_id AND one.position + 1 = two.position
        WHERE one.hash IN (SELECT hash FROM frequent) AND two.hash IN (SELECT hash FROM frequent)
    ),
    pairs AS (
        SELECT hash, text_id, list(position ORDER BY position) AS positions, count(*) AS term_frequency
        FROM neighbours GROUP BY hash, text_id
    )"""

_TURNS = """
    requests AS (
        SELECT row_number() OVER (ORDER BY request) AS query_id, request
        FROM (SELECT DISTINCT text AS request FROM conversations WHERE text IS NOT NULL)
    )"""


def _requests_sql(texts_of_requests: list[str]) -> str:
    rows = ", ".join(f"(CAST({n} AS BIGINT), '{text}')" for n, text in enumerate(texts_of_requests))
    return f"requests(query_id, request) AS (VALUES {rows})"


_TERMS = f"""
    asked AS (SELECT query_id, {_tokens_sql("request")} AS tokens FROM requests),
    slots AS (
        SELECT query_id, unnest(tokens) AS term, unnest(range(len(tokens))) AS phrase_offset,
            md5(term) AS hash, CAST(len(tokens) AS BIGINT) AS slots,
            CAST(len(list_distinct(tokens)) AS BIGINT) AS distinct_words
        FROM asked
    ),
    known AS (
        SELECT query_id, term, hash, slots, distinct_words, document_count,
            count(*) OVER (PARTITION BY query_id) AS required
        FROM (SELECT DISTINCT query_id, term, hash, slots, distinct_words FROM slots)
        JOIN metadata USING (hash)
    ),
    hits AS (SELECT * FROM known JOIN postings USING (hash)),
    matches AS (
        SELECT query_id, text_id, min(document_count) AS minimum_count FROM hits
        GROUP BY query_id, text_id HAVING count(*) = min(required)
    )"""


def _bm25_sql(frequency: str, count: str, k1: float, b: float) -> str:
    return (
        f"round(ln((total_documents - {count} + 0.5) / ({count} + 0.5)) * ({frequency} * ({k1} + 1))"
        f" / ({frequency} + {k1} * (1 - {b} + {b} * words_total / average_document_length)), 3)"
    )


def _top_sql(with_requests: str, scored: str, k: int, index: str = _INDEX) -> str:
    return f"""WITH {index}, {with_requests}, {_TERMS}, scored AS ({scored}), ranked AS (
            SELECT *, row_number() OVER (
                PARTITION BY query_id ORDER BY bm25_score DESC NULLS LAST, text_id
            ) AS result_number
            FROM scored
        )
        SELECT query_id, result_number, text_id, bm25_score, matching_words
        FROM ranked WHERE result_number <= {k}"""


def _word_sql(with_requests: str, k: int = 10, k1: float = 1.5, b: float = 0.75) -> str:
    scored = f"""SELECT query_id, text_id, {_bm25_sql("term_frequency", "document_count", k1, b)}
            AS bm25_score, term_frequency AS matching_words
        FROM hits CROSS JOIN stats WHERE slots = 1"""
    return _top_sql(with_requests, scored, k)


def _any_sql(
    with_requests: str,
    k: int = 10,
    k1: float = 1.5,
    b: float = 0.75,
    extra: str = "true",
    index: str = _INDEX,
) -> str:
    scored = f"""SELECT query_id, text_id,
            round(sum({_bm25_sql("term_frequency", "document_count", k1, b)}), 3) AS bm25_score,
            count(DISTINCT hash) AS matching_words
        FROM hits JOIN matches USING (query_id, text_id) CROSS JOIN stats
        WHERE {extra} GROUP BY query_id, text_id"""
    return _top_sql(with_requests, scored, k, index)


def _phrase_sql(
    with_requests: str, k: int = 10, k1: float = 1.5, b: float = 0.75, index: str = _INDEX
) -> str:
    """Places where the request's first two words stand, compared with the request word by word."""
    followed = """SELECT text_id, position, word, lead(word) OVER (
            PARTITION BY text_id ORDER BY position) AS next_word FROM flat"""
    starts = f"""SELECT query_id, text_id, len(asked.tokens) AS slots
        FROM ({followed}) f JOIN asked ON word = asked.tokens[1] AND next_word = asked.tokens[2]
            JOIN tokens USING (text_id)
        WHERE len(asked.tokens) = 2
            OR list_slice(tokens.tokens, position + 1, position + len(asked.tokens)) = asked.tokens
        UNION ALL SELECT query_id, text_id, 1 FROM flat JOIN asked ON word = asked.tokens[1]
        WHERE len(asked.tokens) = 1"""
    phrases = f"""SELECT query_id, text_id, slots, count(*) AS occurrences
        FROM ({starts}) GROUP BY query_id, text_id, slots"""
    least = """SELECT query_id, min(document_count) AS minimum_count FROM known GROUP BY query_id"""
    scored = f"""SELECT query_id, text_id,
            {_bm25_sql("occurrences", "minimum_count", k1, b)} AS bm25_score,
            occurrences * slots AS matching_words
        FROM ({phrases}) JOIN ({least}) USING (query_id) JOIN word_counts USING (text_id) CROSS JOIN stats"""
    return _top_sql(with_requests, scored, k, index)


def oracle_sql() -> dict[str, str]:
    """The SQL of each query that SQL can express, over the same tables."""
    return search_sql() | (llm.oracle_sql() if llm else {})


def search_sql() -> dict[str, str]:
    filtered = "SELECT doc_id, source AS title, text FROM documents WHERE lang IN ('fr', 'en') AND n_chars >= 500"
    numbers = f"""SELECT row_number() OVER (ORDER BY document) AS text_id, * FROM (
        SELECT doc_id AS document, source AS title, text FROM documents
        WHERE lang IN ('fr', 'en') AND n_chars >= 500)"""
    mixed, words, phrases = (_requests_sql(asked) for asked in (MIXED, WORDS, PHRASES))
    return {
        "corpus_filter": filtered,
        "corpus_text_ids": f"SELECT row_number() OVER (ORDER BY doc_id) AS text_id, * FROM ({filtered})",
        "corpus_max_texts": f"""SELECT * FROM (
            SELECT row_number() OVER (ORDER BY doc_id) + 1000 AS text_id, doc_id FROM ({filtered})
        ) WHERE text_id <= 1250""",
        "conversation_text_ids": """SELECT row_number() OVER (ORDER BY conv_id, turn) AS text_id,
            conv_id, turn, text FROM conversations""",
        "corpus_text_ids_with_copies": """SELECT row_number() OVER (
            ORDER BY source NULLS FIRST, text NULLS FIRST) AS text_id, source, text FROM documents""",
        "corpus_text_bins": f"""SELECT doc_id % {TEXT_BINS} + 1 AS text_bin, doc_id AS text_id,
            source AS title, text FROM documents""",
        "tokens": f"WITH {_INDEX} SELECT text_id, array_to_string(tokens, ' ') AS tokens FROM tokens",
        "word_counts": f"WITH {_INDEX} SELECT * FROM word_counts",
        "postings": _POSTINGS,
        "posting_positions": f"WITH {_INDEX} SELECT md5(word) AS hash, text_id, position FROM flat",
        "postings_bins": f"WITH {_INDEX} SELECT {_BIN} AS bin, hash, text_id FROM postings",
        "posting_lengths": f"""WITH {_INDEX}
            SELECT hash, text_id, term_frequency, words_total FROM postings""",
        "document_frequency": f"WITH {_INDEX} SELECT hash, document_count FROM metadata",
        "corpus_stats": f"""WITH {_INDEX} SELECT total_documents,
            round(average_document_length, 6) AS average_document_length FROM stats""",
        "index_totals": f"""WITH {_INDEX} SELECT count(*) AS texts_total,
            CAST(sum(words_total) AS BIGINT) AS words_total FROM word_counts""",
        "index_bin_report": f"""WITH {_INDEX} SELECT {_BIN} AS bin, count(*) AS postings,
            count(DISTINCT hash) AS hashes FROM postings GROUP BY 1""",
        "stored_index_postings": _POSTINGS,
        "stored_index_word_counts": f"WITH {_INDEX} SELECT * FROM word_counts",
        "stored_index_document_frequency": f"WITH {_INDEX} SELECT hash, document_count FROM metadata",
        "optimized_index_postings": _POSTINGS,
        "compacted_index_postings": _POSTINGS,
        "words_by_text": f"""WITH {_INDEX} SELECT text_id, words_total, hash, term_frequency,
            array_to_string(positions, ',') AS positions FROM postings""",
        "index_score_blocks": f"""WITH {_INDEX}, steps AS (
                SELECT hash, text_id // {BLOCK_TEXTS} AS block, term_frequency, count(*) AS texts,
                    min(words_total) AS shortest, max(words_total) AS longest
                FROM postings JOIN metadata USING (hash) WHERE document_count >= {BLOCK_TEXTS} GROUP BY ALL
            )
            SELECT hash, block, CAST(sum(texts) AS BIGINT) AS texts, string_agg(
                term_frequency || ':' || shortest || ':' || longest, ',' ORDER BY term_frequency) AS profile
            FROM steps GROUP BY hash, block""",
        "index_pairs": f"""WITH {_INDEX}, {_PAIR_POSTINGS}
            SELECT hash, text_id, array_to_string(positions, ',') AS positions, term_frequency, words_total
            FROM pairs JOIN word_counts USING (text_id)""",
        "index_pair_frequency": f"""WITH {_INDEX}, {_PAIR_POSTINGS}
            SELECT hash, count(*) AS document_count FROM pairs GROUP BY hash""",
        "streamed_index_postings": _POSTINGS,
        "index_batch_totals": f"""WITH {_INDEX}
            SELECT CASE WHEN source < 'src2' THEN 'first' ELSE 'second' END AS batch,
                count(*) AS texts_added, CAST(sum(words_total) AS BIGINT) AS words_added
            FROM word_counts JOIN documents ON doc_id = text_id GROUP BY 1""",
        "streamed_index_counts": f"""WITH {_INDEX} SELECT
            (SELECT count(*) FROM word_counts) AS texts_total,
            (SELECT CAST(sum(words_total) AS BIGINT) FROM word_counts) AS words_total,
            (SELECT count(*) FROM metadata) AS hashes,
            (SELECT CAST(sum(document_count) AS BIGINT) FROM metadata) AS postings""",
        "request_terms": f"""WITH {_INDEX}, {_BENCHMARK}, {_TERMS}
            SELECT query_id, phrase_offset, term, hash, slots, distinct_words FROM slots""",
        "request_plan": f"""WITH {_INDEX}, {_BENCHMARK}, {_TERMS}
            SELECT query_id, term, hash, document_count, row_number() OVER (
                PARTITION BY query_id ORDER BY document_count, term) AS rarity FROM known""",
        "match_all": f"""WITH {_INDEX}, {mixed}, {_TERMS}
            SELECT query_id, text_id, hash, array_to_string(positions, ',') AS positions
            FROM hits JOIN matches USING (query_id, text_id)""",
        "match_all_intersect": f"""WITH {_INDEX}
            SELECT text_id FROM postings WHERE hash = md5('in') INTERSECT
            SELECT text_id FROM postings WHERE hash = md5('the') INTERSECT
            SELECT text_id FROM postings WHERE hash = md5('of')""",
        "search_word": _word_sql(words),
        "search_any_position": _any_sql(mixed),
        "search_phrase": _phrase_sql(phrases),
        "search_phrase_repeated_word": _phrase_sql(_requests_sql(["the the", "la la la"]), k=100),
        "search_unknown_word_drop": _any_sql(_requests_sql(["the zzzunknown"]), k=50),
        "search_unknown_word_require": _any_sql(
            _requests_sql(["the zzzunknown", "of the"]), k=50, extra="required = distinct_words"
        ),
        "search_custom_k1_b": _any_sql(mixed, k1=1.2, b=0.4),
        "search_phrase_custom_k1_b": _phrase_sql(phrases, k1=0.9, b=1.0),
        "search_all_results": _any_sql(mixed, k=100_000),
        "search_batch_topk": _any_sql(_BENCHMARK, k=20),
        "search_batch_phrase_topk": _phrase_sql(_BENCHMARK, k=20),
        "search_dispatch_one_word": _any_sql(words),
        "search_dispatch_phrase": _phrase_sql(mixed),
        "search_after_append": _any_sql(
            mixed,
            k=50,
            index=_index_sql("SELECT doc_id AS text_id, text, source FROM documents", "source < 'src5'"),
        ),
        "search_blake2b": _any_sql(mixed),
        "search_word_pairs": _any_sql(_PAIRS, k=5),
        "search_word_pairs_phrase": _phrase_sql(_PAIRS, k=5),
        "search_turns": _any_sql(_TURNS, k=5),
        "search_turns_phrase": _phrase_sql(_TRIPLES, k=5),
        "search_phrase_pairs": _phrase_sql(phrases),
        "search_early_stop": _any_sql(_requests_sql(FREQUENT), k=3),
        "search_early_stop_k1_b": _any_sql(_requests_sql(FREQUENT), k=1, k1=0.6, b=0.9),
        "search_sorted_index": _any_sql(mixed, k=100),
        "search_with_many_texts": f"""SELECT query_id, result_number, bm25_score, matching_words,
            doc_id AS text_id, source AS title, text
            FROM ({_any_sql(mixed, k=250)}) JOIN documents ON doc_id = text_id""",
        "ingest_index_search": f"""SELECT found.query_id, result_number, bm25_score, matching_words,
            numbers.text_id, document, title, text
            FROM ({_phrase_sql(phrases, k=5, index=_index_sql(f"SELECT text_id, text FROM ({numbers})"))}) found
            JOIN ({numbers}) numbers ON numbers.text_id = found.text_id""",
        "search_with_texts": f"""SELECT query_id, result_number, bm25_score, matching_words,
            doc_id AS text_id, source AS title, text
            FROM ({_phrase_sql(phrases, k=5)}) JOIN documents ON doc_id = text_id""",
    }
