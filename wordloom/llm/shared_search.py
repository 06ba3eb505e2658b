"""Ranked lexical search for many items at once, sharing what they have in common.

Each item is a bag of terms.  Term sets that several items share are mined first: again and again the pairs of parts
that most items have become a part of their own, so that items and parts form a graph that grows from terms.  In a
batch of documents every part of the graph is one accumulator, a vector of partial scores, which is made once from
its two parts however many items use it; an item's score is the sum of the parts that are left to it.  Documents are
read once; what stays of them is how often they hold the items' terms.  Each task keeps the best documents of each
item, and only these are shuffled.

A term's weight is ``floor(1000 * ln((2N + 2) / (2df + 1)))`` in doubles; all else is 64-bit integers.  Null and empty
texts have no terms: such an item has no rows, such a document is in none and does not count in N.  Repeated rows of
an item are one item, different texts under one id are ranked apart.  Repeated rows of a document count and rank one by one;
equal scores are in order of id, null ids last.  Without documents or items there are no rows.

Items are searched in blocks of about ``BLOCK_TERMS`` terms, chosen by a hash, each of which is one more pass over
the documents: what the driver and a task hold of the items is a block, however many items there are.
"""

from __future__ import annotations

import dataclasses
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.llm.common import arrow_bounded
from wordloom.session import no_rows, union_all, written

RESULTS = 20
# Terms of the items of a block.
BLOCK_TERMS = 50_000
# Each part of an item is paired with so many parts that follow it; others are shared less, but scored all the same.
PARTNERS = 48
# Numbers in the accumulators of a batch of documents.
_NUMBERS = 1 << 22

_RESULT = "item_id {0}, rank int, doc_id long, score long"

# Letters A-Z in lower case; all that is neither a digit, a letter nor beyond ASCII is space.
_TERM_BYTES = bytes(
    byte if byte >= 128 or chr(byte).isalnum() else 32 for byte in bytes(range(256)).lower()
)


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a text given as UTF-8, in order."""
    return text.translate(_TERM_BYTES).split() if text else []


# Sharing


@dataclasses.dataclass(frozen=True)
class SharingGraph:
    """Parts by number: the first ``terms`` are terms, each other is the sum of two earlier ones (``joined``).

    An item is the sum of its ``parts``, and of the terms that it repeats, as often as it repeats them (``more``).
    """

    terms: int
    joined: list[tuple[int, int]]
    parts: list[list[int]]
    more: list[list[tuple[int, int]]]


def share_terms(items: list[dict[int, int]], terms: int) -> SharingGraph:
    """The graph of some items, each a table of how often it has which term.

    In each round pairs of parts that two or more items have are joined, those of most items first; pairs are counted
    anew for the next round.
    """
    parts = [set(item) for item in items]
    joined: list[tuple[int, int]] = []
    while True:
        holders = Counter(part for own in parts for part in own)
        found: dict[tuple[int, int], list[int]] = defaultdict(list)
        for number, own in enumerate(parts):
            # Parts of one item only are in no shared pair; the most shared ones stand together.
            ordered = sorted((part for part in own if holders[part] > 1), key=lambda part: (-holders[part], part))
            for i, one in enumerate(ordered):
                for two in ordered[i + 1 : i + 1 + PARTNERS]:
                    found[one, two].append(number)
        shared = sorted((pair for pair, own in found.items() if len(own) > 1), key=lambda pair: (-len(found[pair]), pair))
        before = len(joined)
        for one, two in shared:
            # An earlier pair of this round may have taken a part of it.
            own = [number for number in found[one, two] if one in parts[number] and two in parts[number]]
            if len(own) > 1 and 2 * len(own) >= len(found[one, two]):
                part = terms + len(joined)
                joined.append((one, two))
                for number in own:
                    parts[number] -= {one, two}
                    parts[number].add(part)
        if len(joined) == before:
            break
    more = [[(term, times - 1) for term, times in sorted(item.items()) if times > 1] for item in items]
    return SharingGraph(terms, joined, [sorted(own) for own in parts], more)


def item_scores(graph: SharingGraph, values: np.ndarray) -> np.ndarray:
    """Scores, a row per item, of documents whose terms are worth ``values`` (a row per term)."""
    made = np.empty((graph.terms + len(graph.joined), values.shape[1]), np.int64)
    made[: graph.terms] = values
    for place, (one, two) in enumerate(graph.joined, graph.terms):
        np.add(made[one], made[two], out=made[place])
    scores = np.zeros((len(graph.parts), values.shape[1]), np.int64)
    for score, parts, more in zip(scores, graph.parts, graph.more, strict=True):
        for part in parts:
            score += made[part]
        for term, times in more:
            score += times * made[term]
    return scores


# Documents


def _item_terms(items: DataFrame) -> DataFrame:
    """``item, item_id, term, times`` of every different item, as a table; ``item`` names an id with its text."""

    def count(batches):
        for batch in batches:
            rows, terms, times = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                found = Counter(terms_of(text))
                rows += [row] * len(found)
                terms += found.keys()
                times += found.values()
            taken = pa.array(rows, pa.int64())
            yield pa.record_batch(
                [
                    batch.column("item").take(taken),
                    batch.column("item_id").take(taken),
                    pa.array(terms, pa.binary()),
                    pa.array(times, pa.int64()),
                ],
                ["item", "item_id", "term", "times"],
            )

    kind = items.schema["item_id"].dataType.simpleString()
    text = F.col("text")
    named = F.sha2(F.to_json(F.struct("item_id", F.sha2(text.cast("binary"), 256))), 256)
    rows = items.select(named.alias("item"), "item_id", text.cast("binary").alias("text")).distinct()
    return written(rows.mapInArrow(count, f"item string, item_id {kind}, term binary, times long"), "items")


def _document_terms(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, times`` of every document with a term, as a table; only terms of the vocabulary are listed."""

    def count(batches):
        number = vocabulary.get
        for batch in batches:
            kept, sizes, begins, terms, times = [], [], [0], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                own = terms_of(text)
                if not own:
                    continue
                found = Counter(map(number, own))
                found.pop(None, None)
                kept.append(row)
                sizes.append(len(own))
                terms += found.keys()
                times += found.values()
                begins.append(len(terms))
            begins = pa.array(begins, pa.int32())
            yield pa.record_batch(
                [
                    batch.column("doc_id").take(pa.array(kept, pa.int64())),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(begins, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(begins, pa.array(times, pa.int64())),
                ],
                ["doc_id", "n", "terms", "times"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return written(rows.mapInArrow(count, "doc_id long, n long, terms array<int>, times array<long>"), "document-terms")


def _weights(found: DataFrame, documents: int, terms: int) -> np.ndarray:
    """Weight of every term of the vocabulary."""
    weights = np.zeros(terms, np.int64)
    counted = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    for row in counted.collect():
        weights[row.term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * row.df + 1)))
    return weights


def _best(place: np.ndarray, score: np.ndarray, doc_id: np.ndarray, no_id: np.ndarray, k: int):
    """The ``k`` best rows of each item: highest score, then smallest id, rows without id last."""
    order = np.lexsort((doc_id, no_id, -score, place))
    place = place[order]
    first = np.searchsorted(place, place)
    kept = order[np.arange(len(order)) - first < k]
    return kept


def _ranked(found: DataFrame, graph: SharingGraph, weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """``place, doc_id, score``: of each item of a block the best documents of every task."""
    width = max(_NUMBERS // max(graph.terms + len(graph.joined) + len(graph.parts), 1), 16)

    def score(batches):
        best = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]
        reach = np.ones(len(graph.parts), np.int64)
        for batch in batches:
            ids = batch.column("doc_id")
            no_id = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            size = batch.column("n").to_numpy(zero_copy_only=False)
            m = 100 - 25 + (25 * size * documents) // length
            counts = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(counts)
            terms = batch.column("terms").flatten().to_numpy(zero_copy_only=False)
            times = batch.column("times").flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(counts)), counts)
            worth = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 12 * m[owner]))
            for begin in range(0, len(counts), width):
                end = min(begin + width, len(counts))
                own = slice(ends[begin] - counts[begin], ends[end - 1])
                values = np.zeros((graph.terms, end - begin), np.int64)
                values[terms[own], owner[own] - begin] = worth[own]
                scores = item_scores(graph, values)
                # Equal to the last of the best so far is enough, as its id may be smaller.
                place, row = np.nonzero(scores >= reach[:, None])
                rows = begin + row
                joined = [
                    np.concatenate(pair)
                    for pair in zip(best, (place, scores[place, row], ids[rows], no_id[rows]), strict=True)
                ]
                kept = _best(*joined, k)
                best = [values[kept] for values in joined]
                full = np.flatnonzero(np.bincount(best[0], minlength=len(reach)) == k)
                reach[full] = best[1][np.searchsorted(best[0], full, side="right") - 1]
        yield pa.record_batch(
            [
                pa.array(best[0].astype(np.int32)),
                pa.array(best[2], mask=best[3]),
                pa.array(best[1]),
            ],
            ["place", "doc_id", "score"],
        )

    return found.mapInArrow(score, "place int, doc_id long, score long")


def _search_block(terms: DataFrame, documents: DataFrame, k: int) -> DataFrame | None:
    """``item_id, rank, doc_id, score`` for the items of a block, as a table; None if there is nothing to rank."""
    spark = documents.sparkSession
    rows = terms.orderBy("item", "term").collect()
    if not rows:
        return None
    numbers = {term: number for number, term in enumerate(sorted({bytes(row.term) for row in rows}))}
    places: dict[str, int] = {}
    items: list[dict[int, int]] = []
    for row in rows:
        if row.item not in places:
            places[row.item] = len(items)
            items.append({})
        items[places[row.item]][numbers[bytes(row.term)]] = row.times
    found = _document_terms(documents, numbers)
    sums = found.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
    if not sums.documents:
        return None
    weights = _weights(found, sums.documents, len(numbers))
    graph = share_terms(items, len(numbers))
    best = _ranked(found, graph, weights, sums.documents, sums.length, k)
    order = Window.partitionBy("place").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    # One row per item of the block.
    named = spark.createDataFrame(list(places.items()), "item string, place int")
    ids = terms.select("item", "item_id").distinct().join(F.broadcast(named), "item")
    ranked = best.join(F.broadcast(ids), "place").select("item_id", "rank", "doc_id", "score")
    return written(ranked, "ranked")


def search_items(documents: DataFrame, items: DataFrame, k: int = RESULTS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents (``doc_id, text``) of each item (``item_id, text``)."""
    spark = documents.sparkSession
    arrow_bounded(spark)
    terms = _item_terms(items)
    blocks = -(-terms.count() // block_terms)
    found = []
    for block in range(blocks):
        own = terms.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        ranked = _search_block(own, documents, k)
        if ranked is not None:
            found.append(ranked)
    kind = items.schema["item_id"].dataType.simpleString()
    return union_all(found) if found else no_rows(spark, _RESULT.format(kind))
