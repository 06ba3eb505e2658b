"""Requests as tables of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.hashing import word_hash
from wordloom.functions.text import with_tokens


def request_terms(
    requests: DataFrame, hash_function: str = "md5", keep_empty: bool = False
) -> DataFrame:
    """The words of requests (``query_id``, ``request``) in order, repeats kept.

    Made with the column functions of indexing.  ``slots`` is the number of words, ``distinct_words`` of
    different ones; a request without words has no rows, or with ``keep_empty`` one without a word.
    """
    return terms_of(asked_words(requests), hash_function, keep_empty)


def asked_words(requests: DataFrame) -> DataFrame:
    """``query_id, tokens``: the words of each request in order, one row per request."""
    return with_tokens(requests.select("query_id", "request"), "request", "tokens").select("query_id", "tokens")


def terms_of(asked: DataFrame, hash_function: str = "md5", keep_empty: bool = False) -> DataFrame:
    """The words of ``asked_words`` one by one, like ``request_terms``.  No shuffle."""
    listed = F.posexplode_outer if keep_empty else F.posexplode
    return (
        asked.select(
            "query_id",
            F.size("tokens").alias("slots"),
            F.size(F.array_distinct("tokens")).alias("distinct_words"),
            listed("tokens").alias("phrase_offset", "term"),
        )
        .select(
            "query_id",
            "phrase_offset",
            "term",
            word_hash("term", hash_function).alias("hash"),
            "slots",
            "distinct_words",
        )
    )
