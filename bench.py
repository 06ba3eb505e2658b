"""Benchmark over ``documents``: build, optimize, and request batches in every search mode.

Reads ``$BENCH_SF_DIR`` with ``$BENCH_CPUS`` cores and prints one JSON line; ``value`` is the sum of the
seconds of all queries.  Every step is run once before it is timed, so that the JVM is warm.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wordloom import (
    append_index,
    create_index,
    optimize_index,
    read_index,
    refresh_document_frequency,
    search,
    search_any_position,
    search_phrase,
    search_word,
)
from wordloom.functions.text import with_tokens
from wordloom.operators import indexing
from wordloom.session import new_shared_path, spread
from wordloom.sources import corpus

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# Requests of one to four words, frequent and rare.
REQUESTS = {
    "one_word": ["the"],
    "frequent_words": ["of the"],
    "mixed_words": ["the elle être"],
}


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("wordloom-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    spark = session()
    # The table has a single row group; without the spread one core would do all the work.
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = spread(documents.select(F.col("doc_id").alias("text_id"), "text"), "text_id")
    # Whole passages; and every pair of words that follow each other in conversations.
    batch = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("request")
    )
    tokens = with_tokens(spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("text"), "text", "tokens")
    places = F.sequence(F.lit(1), F.size("tokens") - 1)
    pairs = (
        tokens.filter(F.size("tokens") > 1)
        .select(
            F.explode(
                F.transform(places, lambda place: F.array_join(F.slice("tokens", place, 2), " "))
            ).alias("request")
        )
        .distinct()
    )
    pairs = corpus.assign_text_ids(pairs, ["request"]).withColumnRenamed("text_id", "query_id")
    seconds: dict[str, float] = {}

    def timed(name, job, warm=1):
        for _ in range(warm):
            job()
        start = time.perf_counter()
        result = job()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name:28} {seconds[name]:8.3f}", file=sys.stderr, flush=True)
        return result

    def noop(frame):
        frame.write.format("noop").mode("overwrite").save()

    def build():
        path = new_shared_path(spark, "index")
        create_index(spark, path)
        return path, append_index(texts, path)

    timed("word_counts", lambda: noop(indexing.word_counts(texts)))
    timed("postings", lambda: noop(indexing.postings(texts)))
    path, (text_total, word_total) = timed("index_append", build)
    timed("document_frequency", lambda: refresh_document_frequency(spark, path))

    def optimize():
        target = new_shared_path(spark, "sorted")
        optimize_index(spark, path, target)
        return target

    index = read_index(spark, timed("optimize", optimize))

    def asked(requests):
        listed = F.array(*[F.lit(request) for request in requests])
        return spark.range(0, 1, 1, 1).select(F.posexplode(listed).alias("query_id", "request"))

    timed("search_word", lambda: search_word(index, asked(REQUESTS["one_word"])).collect())
    for name in ("frequent_words", "mixed_words"):
        one = asked(REQUESTS[name])
        timed(f"any_position_{name}", lambda: search_any_position(index, one).collect())
        timed(f"phrase_{name}", lambda: search_phrase(index, one).collect())
    timed("any_position_batch", lambda: search_any_position(index, batch).collect())
    timed("phrase_batch", lambda: search_phrase(index, batch).collect())
    timed("any_position_word_pairs", lambda: noop(search_any_position(index, pairs, k=5)))
    timed("phrase_word_pairs", lambda: noop(search_phrase(index, pairs, k=5)))
    store = corpus.write_texts(texts, new_shared_path(spark, "texts"), 16)
    timed("search_with_texts", lambda: search(index, asked(["of the"]), texts=store).collect())

    requests = batch.count()
    pair_requests = pairs.count()
    print(
        json.dumps(
            {
                "metric": "seconds for building, optimizing and searching the index, in all",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
                "texts": text_total,
                "words": word_total,
                "index_words_per_sec": round(word_total / seconds["index_append"]),
                "optimize_words_per_sec": round(
                    word_total / (seconds["document_frequency"] + seconds["optimize"])
                ),
                "any_position_requests_per_sec": round(requests / seconds["any_position_batch"], 1),
                "phrase_requests_per_sec": round(requests / seconds["phrase_batch"], 1),
                "word_pairs": pair_requests,
                "any_position_pairs_per_sec": round(pair_requests / seconds["any_position_word_pairs"]),
                "phrase_pairs_per_sec": round(pair_requests / seconds["phrase_word_pairs"]),
            }
        ),
        flush=True,
    )


if __name__ == "__main__":
    main()
