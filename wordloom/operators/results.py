"""Results joined with the texts they point to."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.hashing import text_bin
from wordloom.session import BROADCAST_ROWS, LITERALS, is_one_of, settled_rows, union_all
from wordloom.sources.corpus import TextStore


def _wanted(store: TextStore, results: DataFrame) -> tuple[DataFrame, bool]:
    """The texts of results, cut down during the scan, and whether they are few.

    A few ids are named one by one: only their bins are read, and of these only the row groups that can hold
    them.  More are broadcast, bins in groups of at most ``BROADCAST_ROWS`` ids, so that every bin is read
    once and no text that is not shown is moved.
    """
    ids = results.select("text_id").distinct()
    few = [row.text_id for row in ids.limit(LITERALS + 1).collect()]
    if len(few) <= LITERALS:
        bins = sorted({text_id % store.bins + 1 for text_id in few})
        texts = store.texts.filter(is_one_of("text_bin", map(str, bins)))
        return texts.filter(is_one_of("text_id", map(str, sorted(few)))), True
    ids = ids.withColumn("text_bin", text_bin("text_id", store.bins))
    bounds = ids.agg(F.count(F.lit(1)), F.min("text_id"), F.max("text_id")).first()
    groups = min(math.ceil(bounds[0] / BROADCAST_ROWS), store.bins)
    texts = store.texts.filter(F.col("text_id").between(bounds[1], bounds[2]))
    parts = []
    for group in range(groups):
        own = ids.filter(F.col("text_bin") % groups == group)
        small = groups == 1 or own.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        parts.append(
            texts.filter(F.col("text_bin") % groups == group).join(
                F.broadcast(own) if small else own, ["text_bin", "text_id"], "left_semi"
            )
        )
    return union_all(parts), False


def attach_texts(results: DataFrame, store: TextStore) -> DataFrame:
    """Results with the columns of their texts, the text itself last, in the order of the results.

    A result without a text keeps its row.  The results are computed once.
    """
    results, few_rows = settled_rows(results)
    columns = [name for name in store.texts.columns if name not in ("text_id", "text", "text_bin")]
    head = [name for name in ("query_id", "result_number") if name in results.columns]
    order = head or [F.col("bm25_score").desc_nulls_last(), F.col("text_id")]
    texts, few = _wanted(store, results)
    shown = results.join(texts.drop("text_bin"), "text_id", "left").select(
        *head, "bm25_score", "matching_words", "text_id", *columns, "text"
    )
    # A few texts for a few rows, though many requests may share them, need no sample to be put in order.
    return shown.coalesce(1).sortWithinPartitions(*order) if few and few_rows else shown.orderBy(*order)
