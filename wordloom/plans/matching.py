"""Conjunctive matching: the postings of all words of a request in the texts that have all of them.

A batch of requests is planned from the document frequency of its words, which bounds every intermediate
result before a posting is read; texts that were appended since it was counted are added to each bound.  A
small batch of words with few postings is answered ``directly``: its words are literals of one scan.  Otherwise
each request takes one of three routes:

single  one distinct word: its postings are the matches, nothing is shuffled.
narrow  the rarest word has few postings: these name the candidate texts, a small table that is
        broadcast, and the postings of the frequent words are cut down to them during the scan.
text    the batch asks for a good part of all postings: the index by text is read once for each block of
        requests, and nothing is shuffled (``plans/by_text.py``).
wide    all others: the texts of the rarest word are candidates, rows of two ids, which meet the next rarer
        words only if they have met the last, and what is left meets all words for their values.
"""

from __future__ import annotations

import dataclasses
import math
from collections import defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.functions.hashing import hash_bin, word_hash
from wordloom.functions.postings import run_starts, runs, words_with_positions
from wordloom.operators.indexing import Index
from wordloom.operators.pairs import pair_hash
from wordloom.operators.ranking import top_k
from wordloom.operators.requests import asked_words, request_terms, terms_of
from wordloom.plans.by_text import Block
from wordloom.session import (
    BROADCAST_ROWS,
    LITERALS,
    LOCAL_ROWS,
    durable,
    is_one_of,
    new_shared_path,
    no_rows,
    settled,
    union_all,
    written,
)

UNKNOWN_TERMS = ("drop", "require")

# A key with more rows than this is spread over copies of the other side, one per so many rows.
ROWS_PER_SALT = 1_000_000

# The index by text is read if the words of a batch have at least this part of all postings: it holds a posting in
# about the space that moving one takes, but all of them.
TEXT_SHARE = 1 / 8

# Times ``BROADCAST_ROWS`` words of a block of requests that goes to every text.  A task keeps about 60 bytes of each,
# and every block is one more look at all texts.
TEXT_BLOCK = 2
# Parts that the words of a block are planned in.
PARTS = 8

# Words by rarity that candidates meet step by step; what has met all of these meets the others at once.
STEPS = ((2, 2), (3, 4))

# Postings that a small batch may read without being pruned any further.
DIRECT_POSTINGS = 2_000_000


@dataclasses.dataclass(frozen=True)
class Pruning:
    """Bins, hashes and texts a scan may be limited to; None means all.  Spans of text ids have both ends."""

    bins: list[int] | None = None
    hashes: list[str] | None = None
    text_ids: list[int] | None = None
    spans: list[tuple[int, int]] | None = None

    def apply(self, frame: DataFrame) -> DataFrame:
        # Written as text, which saves a call to the JVM per literal; all are made of digits.
        if self.bins is not None:
            listed = ", ".join(map(str, self.bins))
            frame = frame.filter(f"bin IN ({listed})" if listed else "false")
        if self.hashes is not None:
            frame = frame.filter(is_one_of("hash", map(repr, self.hashes)))
        if self.text_ids is not None:
            frame = frame.filter(is_one_of("text_id", map(str, self.text_ids)))
        if self.spans is not None:
            spans = [f"text_id BETWEEN {first} AND {last}" for first, last in self.spans]
            frame = frame.filter(" OR ".join(spans) or "false")
        return frame


@dataclasses.dataclass(frozen=True)
class Word:
    """A word of a request of a small batch."""

    query: int
    term: str
    hash: str
    bin: int
    document_count: int
    rarity: int
    required: int
    minimum_count: int
    route: str


@dataclasses.dataclass(frozen=True)
class Route:
    """What the scans of a route need: all its words, the rarest word of each request, and a bound of the
    postings of the rarest words."""

    words: Pruning
    rarest: Pruning
    rarest_postings: int


@dataclasses.dataclass(frozen=True)
class RequestPlan:
    """A batch of requests, ready to be matched.

    terms   query_id, phrase_offset, term, hash, bin, slots, distinct_words
    words   query_id, term, hash, bin, document_count, rarity, required, minimum_count, route; in a big batch ``block``
            too, a number below ``blocks`` that all words of a request share, and ``places``, the word's offsets

    In a folded batch both hold one request of those with the same words in the same order.  A small batch
    is listed on the driver too: ``queries`` are its ids, ``slots`` the hashes of each, ``listed`` the words.
    In a ``paired`` batch of phrases a slot may be a pair of words, and the slot after it is empty.  Texts that
    matter may be limited to ``spans`` of ids.
    """

    terms: DataFrame
    words: DataFrame
    broadcastable: bool
    routes: dict[str, Route]
    total_documents: int
    average_document_length: float | None
    folded: Folded | None = None
    queries: list | None = None
    slots: list[list[str]] | None = None
    listed: list[Word] | None = None
    direct: bool = False
    most_words: int = 0
    spans: list[tuple[int, int]] | None = None
    paired: bool = False
    blocks: int = 1


def join_words(rows: DataFrame, words: DataFrame, key: str, spread: str, small: bool) -> DataFrame:
    """Rows with the word table on a key whose values may be very frequent.

    A small word table is broadcast.  Otherwise the rows of each key are counted; a key with more than
    ``ROWS_PER_SALT`` is spread over as many copies of its words as that takes, all others have one.
    """
    if small:
        return rows.join(F.broadcast(words), key)
    # Keys above the limit are few: no more than all rows over the limit.
    hot = (
        rows.groupBy(key)
        .agg(F.count(F.lit(1)).alias("__rows"))
        .filter(F.col("__rows") > ROWS_PER_SALT)
        .select(key, F.ceil(F.col("__rows") / ROWS_PER_SALT).cast("int").alias("__salts"))
    )
    hot = durable(hot)
    if hot.isEmpty():
        return rows.join(words, key)
    if hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    salts = F.coalesce("__salts", F.lit(1))
    salted_words = words.join(hot, key, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), salts - 1))
    )
    salted_rows = rows.join(hot, key, "left").withColumn(
        "__salt", F.pmod(F.xxhash64(spread), salts).cast("int")
    )
    joined = salted_rows.drop("__salts").join(salted_words.drop("__salts"), [key, "__salt"])
    return joined.drop("__salt")


def _bin_pruning(found, bins: int) -> Pruning:
    return Pruning(sorted(found) if len(found) < bins else None)


def _pruning_of(rows, bins: int) -> Pruning:
    hashes = sorted({row.hash for row in rows})
    found = _bin_pruning({row.bin for row in rows}, bins)
    return dataclasses.replace(found, hashes=hashes if len(hashes) <= LITERALS else None)


def word_pruning(words: DataFrame, bins: int) -> Pruning:
    """What a scan for these words needs.

    Up to ``LITERALS`` words are named one by one; for more, only their bins are.
    """
    rows = words.select("bin", "hash").limit(LOCAL_ROWS + 1).collect()
    if len(rows) <= LOCAL_ROWS:
        return _pruning_of(rows, bins)
    return _bin_pruning(words.agg(F.collect_set("bin")).first()[0], bins)


def lookup(key: Column, values: dict, kind: str) -> Column:
    """The value of a key out of a few: ``values`` holds SQL expressions of type ``kind`` by SQL literal."""
    listed = ", ".join(f"{name}, {value}" for name, value in values.items())
    return F.try_element_at(F.expr(f"map({listed})"), key) if values else F.lit(None).cast(kind)


@dataclasses.dataclass(frozen=True)
class Folded:
    """Who answers for whom: ``asked`` has query_id and answered_by, ``different`` counts the latter."""

    asked: DataFrame
    different: int

    def spread_answers(self, results: DataFrame, k: int) -> DataFrame:
        """Every request with the answer to its words, at most ``k`` rows each."""
        answers = results.withColumnRenamed("query_id", "answered_by")
        small = self.different * k <= BROADCAST_ROWS
        return join_words(self.asked, answers, "answered_by", "query_id", small)


def fold_requests(requests: DataFrame) -> tuple[DataFrame, Folded]:
    """One request out of those with the same ``words``, and who shares its answer.

    ``requests`` has ``query_id, words``, and so has the first result.  A request that makes up much of the batch is
    counted on the map side first, and its copies are spread.
    """
    answered = written(requests.groupBy("words").agg(F.min("query_id").alias("answered_by")), "answered")
    different = answered.count()
    asked = join_words(requests, answered, "words", "query_id", different <= BROADCAST_ROWS)
    asked = written(asked.select("query_id", "answered_by"), "folded")
    return answered.select(F.col("answered_by").alias("query_id"), "words"), Folded(asked, different)


def fold_words(asked: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame, Folded]:
    """The same for requests of the same known words in any order; requests without any answer for themselves.

    Returns what is left of ``asked`` and ``words``.
    """
    requests = words.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list("hash")), "").alias("words"))
    requests = requests.select("query_id", F.unhex("words").alias("words"))
    answered = written(requests.groupBy("words").agg(F.min("query_id").alias("answered_by")), "answered")
    known = words.filter("rarity = 1").select("query_id")
    unknown = written(asked.select("query_id").join(known, "query_id", "left_anti"), "unknown")
    different, others = answered.count(), unknown.count()
    folded = join_words(requests, answered, "words", "query_id", different <= BROADCAST_ROWS)
    folded = folded.select("query_id", "answered_by").unionByName(unknown.withColumn("answered_by", F.col("query_id")))
    folded = written(folded, "folded")
    leaders = folded.filter("query_id = answered_by").select("query_id")
    return (
        asked.join(leaders, "query_id", "left_semi"),
        words.join(leaders, "query_id", "left_semi"),
        Folded(folded, different + others),
    )


def asked_terms(index: Index, requests: DataFrame) -> tuple[DataFrame, pa.Table | None, DataFrame | None]:
    """The words of requests with their bins.  Few are given as a table too; of many, the requests are kept as one
    (``asked_words``), so that a request is a row until its words are needed one by one.

    Requests need an id each, and no two the same: a request has one first word, or one row without any.
    """
    found = _with_bins(index, request_terms(requests, index.hash_function, keep_empty=True))
    table = found.limit(LOCAL_ROWS + 1).toArrow()
    if table.num_rows > LOCAL_ROWS:
        asked = written(asked_words(requests), "asked")
        counted = asked.agg(
            F.count(F.lit(1)).alias("rows"), F.count_distinct("query_id").alias("different")
        ).first()
        if counted.rows != counted.different:
            raise ValueError("requests must have a query_id each, and no two the same")
        asked = asked.filter(F.size("tokens") > 0)
        return _with_bins(index, terms_of(asked, index.hash_function)), None, asked
    offsets = table.column("phrase_offset").to_pylist()
    ids = [query_id for query_id, place in zip(table.column("query_id").to_pylist(), offsets, strict=True) if not place]
    if None in ids or len(set(ids)) != len(ids):
        raise ValueError("requests must have a query_id each, and no two the same")
    table = table.filter(table.column("hash").is_valid())
    return requests.sparkSession.createDataFrame(table, found.schema), table, None


def _with_bins(index: Index, words: DataFrame) -> DataFrame:
    return words.withColumn("bin", hash_bin("hash", index.bins))


def compile_requests(
    index: Index,
    requests: DataFrame,
    unknown_terms: str = "drop",
    fold: bool = False,
    by_text: bool = False,
    pairs: bool = False,
    any_order: bool = False,
) -> RequestPlan:
    """Look up the words of requests (``query_id``, ``request``) and choose a route for each request.

    A word the index does not know is left out, so the request asks for its other words, or with
    ``unknown_terms="require"`` makes the request match nothing.  With ``fold`` a big batch is planned
    without repeated requests, with ``by_text`` the index by text may be used, with ``pairs`` the postings of pairs
    for the phrases of a small one.  In ``any_order`` requests with the same known words are repeated ones.
    """
    if unknown_terms not in UNKNOWN_TERMS:
        raise ValueError(f"unknown_terms must be one of {UNKNOWN_TERMS}, not {unknown_terms!r}")
    terms, table, asked = asked_terms(index, requests)
    if table is not None:
        return _small_plan(index, terms, table, unknown_terms, by_text, pairs and index.pairs is not None)
    return _big_plan(index, asked, unknown_terms, fold, by_text, any_order)


def _worth_all_texts(index: Index, postings: int, different: int) -> bool:
    """Whether words with so many postings are worth a look at every text."""
    known = index.known_postings
    return known is not None and postings + different * index.uncounted_texts >= TEXT_SHARE * known


def _with_pairs(index: Index, requests: list[list], counts: dict[str, int]) -> tuple[list[list], dict[str, int]]:
    """Slots of requests with frequent neighbours as one, each slot as (term, hash, bin), and the pairs' counts.

    Neighbours are joined two by two; the last of an odd number is joined with the one before it too, so that no
    frequent word is left alone beside another.  A request with a pair that no text has is left out.
    """
    joined = []
    for own in requests:
        slots = [(row.term, row.hash, row.bin) for row in own]
        frequent = [counts[row.hash] >= index.pair_least for row in own]
        place = 0
        while place < len(own):
            if place + 1 < len(own) and frequent[place] and frequent[place + 1]:
                first, step = place, 2
            elif place and frequent[place - 1] and frequent[place]:
                first, step = place - 1, 1
            else:
                place += 1
                continue
            one, two = own[first], own[first + 1]
            name = pair_hash(one.hash, two.hash)
            slots[first] = (f"{one.term} {two.term}", name, int(name, 16) % index.bins + 1)
            slots[first + 1] = ("", "", 0)
            place += step
        joined.append(slots)
    wanted = sorted({slot for slots in joined for slot in slots if " " in slot[0]})
    listed = [Row(term=term, hash=name, bin=bin_) for term, name, bin_ in wanted]
    found = _pruning_of(listed, index.bins).apply(index.pair_frequency).select("hash", "document_count")
    names = {row.hash for row in listed}
    known = {row.hash: row.document_count for row in found.collect() if row.hash in names} if listed else {}
    return joined, known


def _listed_words(
    index: Index, queries: list, slots: list[list], counts: dict[str, int], least: list[int]
) -> list[Word]:
    """The different words of each request from rarest to most frequent, with the route that their numbers allow."""
    words = []
    for place, own in enumerate(slots):
        different = {name: (term, bin_) for term, name, bin_ in own if name}
        ordered = sorted(different, key=lambda name: (counts[name], different[name][0]))
        bound = (counts[ordered[0]] + index.uncounted_texts) * len(ordered) * len(queries)
        route = "single" if len(ordered) == 1 else "narrow" if bound <= BROADCAST_ROWS else "wide"
        for rarity, name in enumerate(ordered, 1):
            term, bin_ = different[name]
            words.append(Word(place, term, name, bin_, counts[name], rarity, len(ordered), least[place], route))
    return words


def _is_direct(index: Index, words: list[Word]) -> bool:
    postings = {word.hash: word.document_count + index.uncounted_texts for word in words}
    return len(words) <= LITERALS and sum(postings.values()) <= DIRECT_POSTINGS


def _small_plan(
    index: Index, terms: DataFrame, table: pa.Table, unknown_terms: str, by_text: bool, pairs: bool
) -> RequestPlan:
    """The plan of a batch whose words the driver can hold: one look at document frequency, no other job."""
    spark = terms.sparkSession
    rows = [Row(**row) for row in table.to_pylist()]
    pruning = _pruning_of(rows, index.bins)
    metadata = pruning.apply(index.hash_metadata).select("hash", "document_count")
    if rows and pruning.hashes is None:
        vocabulary = terms.select("hash").distinct()
        metadata = metadata.join(F.broadcast(vocabulary), "hash", "left_semi")
    counts = {row.hash: row.document_count for row in metadata.collect()} if rows else {}

    by_query: dict = defaultdict(list)
    for row in rows:
        by_query[row.query_id].append(row)
    queries, requests = [], []
    for query_id, own in by_query.items():
        known = {row.hash for row in own if row.hash in counts}
        if known and (unknown_terms != "require" or len(known) == own[0].distinct_words):
            queries.append(query_id)
            requests.append(sorted(own, key=lambda row: row.phrase_offset))
    least = [min(counts[row.hash] for row in own if row.hash in counts) for own in requests]
    slots = [[(row.term, row.hash, row.bin) for row in own] for own in requests]
    known = [[slot for slot in own if slot[1] in counts] for own in slots]
    words = _listed_words(index, queries, known, counts, least)
    direct, paired = _is_direct(index, words), False
    several = {word.hash: word.document_count for word in words if word.required > 1}
    worth = by_text and several and _worth_all_texts(index, sum(several.values()), len(several))
    if pairs and any(count >= index.pair_least for count in several.values()):
        joined, found = _with_pairs(index, requests, counts)
        kept = [n for n, own in enumerate(joined) if all(slot[1] in found for slot in own if " " in slot[0])]
        picked = [joined[n] for n in kept], [queries[n] for n in kept], [least[n] for n in kept]
        their = _listed_words(index, picked[1], picked[0], counts | found, picked[2])
        if found and (_is_direct(index, their) or not worth):
            (slots, queries, least), words, paired = picked, their, True
            requests, direct = [requests[n] for n in kept], _is_direct(index, their)
    if worth and not direct and not paired:
        words = [word if word.required == 1 else dataclasses.replace(word, route="text") for word in words]
    if paired:
        of_slots = [
            (own.query_id, own.phrase_offset, term, name, own.slots, own.distinct_words, bin_)
            for request, places in zip(requests, slots, strict=True)
            for own, (term, name, bin_) in zip(request, places, strict=True)
        ]
        terms = spark.createDataFrame(of_slots, terms.schema)
    slots = [[name for _, name, _ in own] for own in slots]

    routes = {}
    for name in sorted({word.route for word in words}):
        taken = [word for word in words if word.route == name]
        rarest = [word for word in taken if word.rarity == 1]
        bound = sum(word.document_count + index.uncounted_texts for word in rarest)
        routes[name] = Route(_pruning_of(taken, index.bins), _pruning_of(rarest, index.bins), bound)
    columns = {
        "query_id": pa.array([queries[word.query] for word in words], type=table.schema.field("query_id").type),
        **{
            name: pa.array([getattr(word, name) for word in words], type=kind)
            for name, kind in (
                ("term", pa.string()),
                ("hash", pa.string()),
                ("bin", pa.int32()),
                ("document_count", pa.int64()),
                ("rarity", pa.int32()),
                ("required", pa.int64()),
                ("minimum_count", pa.int64()),
                ("route", pa.string()),
            )
        },
    }
    total, average = index.statistics()
    return RequestPlan(
        terms=terms,
        words=spark.createDataFrame(pa.table(columns)),
        broadcastable=True,
        routes=routes,
        total_documents=total,
        average_document_length=average,
        queries=queries,
        slots=slots,
        listed=words,
        direct=direct,
        most_words=max((word.required for word in words), default=0),
        paired=paired,
    )


def _big_plan(
    index: Index, asked: DataFrame, unknown_terms: str, fold: bool, by_text: bool, any_order: bool
) -> RequestPlan:
    folded = None
    if fold and not any_order:
        # No word has a space in it, so the words of a request make one key, and that is the request again.
        requests, folded = fold_requests(asked.select("query_id", F.array_join("tokens", " ").alias("words")))
        asked = requests.select("query_id", F.split("words", " ").alias("tokens"))
    size = asked.agg(F.sum(F.size("tokens")).alias("terms"), F.count(F.lit(1)).alias("queries")).first()
    terms_asked = size.terms or 0
    small = terms_asked <= BROADCAST_ROWS
    blocks = max(math.ceil(terms_asked / max(TEXT_BLOCK * BROADCAST_ROWS, 1)), 1)

    # Document frequency of the batch's vocabulary, then of every word of every request.
    vocabulary = asked.select(F.explode("tokens").alias("term")).distinct()
    vocabulary = _with_bins(index, vocabulary.withColumn("hash", word_hash("term", index.hash_function)))
    vocabulary = written(vocabulary, "vocabulary")
    counted = vocabulary.agg(F.count(F.lit(1)).alias("words"), F.collect_set("bin").alias("bins")).first()
    few_words = counted.words <= BROADCAST_ROWS
    metadata = _bin_pruning(counted.bins, index.bins).apply(index.hash_metadata)
    known = metadata.select("hash", "document_count").join(
        F.broadcast(vocabulary) if few_words else vocabulary, "hash"
    )
    # The requests of a part of a block are brought together while they are one row each; with a vocabulary that can be
    # broadcast their words are not moved again.
    parts = blocks * PARTS
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")
    wanted = asked.withColumn("part", part)
    if few_words:
        wanted = wanted.repartition(parts, "part")
    ordered = wanted.select(
        "part",
        "query_id",
        F.size(F.array_distinct("tokens")).alias("distinct_words"),
        words_with_positions("tokens").alias("ordered"),
    ).withColumn("starts", run_starts("ordered"))
    wanted = ordered.select("part", "query_id", "distinct_words", F.inline(runs("ordered", "starts"))).select(
        "part", "query_id", "distinct_words", F.col("word").alias("term"), F.col("positions").alias("places")
    )
    known = join_words(wanted, known, "term", "query_id", few_words)
    if not few_words:
        known = known.repartition(parts, "part")
    per_query = Window.partitionBy("part", "query_id")
    rarest_first = per_query.orderBy("document_count", "term")
    uncounted = F.lit(index.uncounted_texts)
    candidates = (F.col("minimum_count") + uncounted) * F.col("required") * F.lit(max(size.queries, 1))
    words = known.withColumns(
        {
            "required": F.count(F.lit(1)).over(per_query),
            "minimum_count": F.min("document_count").over(per_query),
            "rarity": F.row_number().over(rarest_first),
        }
    )
    if unknown_terms == "require":
        words = words.filter(F.col("required") == F.col("distinct_words"))
    narrow = candidates <= F.lit(BROADCAST_ROWS) if small else F.lit(False)
    words = words.withColumn("block", F.col("part") % blocks).drop("part")
    words = written(words, "words", "block")
    if fold and any_order:
        asked, words, folded = fold_words(asked, words)
        words = written(words.repartition(parts, part), "words", "block")
    route = F.when(F.col("required") == 1, "single").when(narrow, "narrow").otherwise("wide")
    if by_text:
        several = words.filter("required > 1").select("hash", "document_count").distinct()
        sums = several.agg(F.sum("document_count").alias("postings"), F.count(F.lit(1)).alias("different")).first()
        if sums.different and _worth_all_texts(index, sums.postings, sums.different):
            # A phrase of one different word may be one word, which is no place to look for neighbours.
            route = F.lit("text") if any_order else F.when(F.col("required") == 1, "single").otherwise("text")
    words = words.withColumn("route", route)
    is_rarest = F.col("rarity") == 1
    rows = (
        words.groupBy("route")
        .agg(
            F.collect_set("bin").alias("bins"),
            F.collect_set(F.when(is_rarest, F.col("bin"))).alias("rarest_bins"),
            F.sum(F.when(is_rarest, F.col("document_count") + uncounted)).alias("rarest_postings"),
            F.max("required").alias("most_words"),
        )
        .collect()
    )
    routes = {
        row.route: Route(
            _bin_pruning(row.bins, index.bins),
            _bin_pruning(row.rarest_bins, index.bins),
            row.rarest_postings,
        )
        for row in rows
    }
    total, average = index.statistics()
    return RequestPlan(
        terms=_with_bins(index, terms_of(asked, index.hash_function)),
        words=words,
        broadcastable=small,
        routes=routes,
        total_documents=total,
        average_document_length=average,
        folded=folded,
        most_words=max((row.most_words for row in rows), default=0),
        blocks=blocks,
    )


def request_plan(index: Index, requests: DataFrame) -> DataFrame:
    """Known words of every request from rarest to most frequent (``rarity`` 1, 2, ...)."""
    words = compile_requests(index, requests).words
    return words.select("query_id", "rarity", "term", "hash", "document_count")


def uncounted_words(plan: RequestPlan) -> DataFrame | None:
    """Requests of one word whose document frequency is not known, as rows of ``terms``."""
    single = plan.terms.filter("slots = 1")
    if plan.queries is not None:
        # The terms are literals of the plan; this starts no job.
        known = set(plan.queries)
        if all(row.query_id in known for row in single.select("query_id").collect()):
            return None
    uncounted = single.join(plan.words.select("query_id"), "query_id", "left_anti")
    return None if uncounted.isEmpty() else settled(uncounted)


# Hits: one row per request, text and word of the request that the text has.

_ASKED = "array<struct<query_id: int, document_count: bigint, required: bigint>>"


def asked_by_hash(plan: RequestPlan) -> Column:
    """What a small batch asks of the word whose ``hash`` a row has; ``query_id`` is a place in ``plan.queries``."""
    asked: dict[str, list[str]] = defaultdict(list)
    for word in plan.listed:
        asked[repr(word.hash)].append(
            f"named_struct('query_id', {word.query}, 'document_count', {word.document_count}L, "
            f"'required', {word.required}L)"
        )
    return lookup(F.col("hash"), {name: f"array({', '.join(own)})" for name, own in asked.items()}, _ASKED)


def _direct_hits(index: Index, plan: RequestPlan, values: list[str]) -> DataFrame:
    """Hits of all requests of a small batch; ``query_id`` is the request's place in ``plan.queries``."""
    found = asked_by_hash(plan)
    pruning = dataclasses.replace(_pruning_of(plan.listed, index.bins), spans=plan.spans)
    return pruning.apply(index.postings).select("hash", "text_id", *values, F.inline(found))


def _narrow_hits(index: Index, plan: RequestPlan, words: DataFrame, values: list[str]) -> DataFrame:
    needs = plan.routes["narrow"]
    rows = needs.words.apply(index.postings)
    # Postings of the rarest words are the candidates, at most BROADCAST_ROWS with their words.
    rarest = words.filter("rarity = 1").select("query_id", "hash")
    candidates = (
        needs.rarest.apply(index.postings)
        .join(F.broadcast(rarest), "hash")
        .select("query_id", "text_id")
    )
    if needs.rarest_postings <= LITERALS:
        # So few that the scan can look for them in the long lists of the frequent words.
        candidates = settled(candidates)
        text_ids = sorted({row.text_id for row in candidates.collect()})
        rows = Pruning(text_ids=text_ids).apply(rows)
    needed = candidates.join(
        F.broadcast(words.select("query_id", "hash", "document_count", "required")), "query_id"
    )
    return rows.select("hash", "text_id", *values).join(F.broadcast(needed), ["text_id", "hash"])


def _wide_hits(index: Index, plan: RequestPlan, words: DataFrame, values: list[str]) -> DataFrame:
    small = plan.broadcastable
    needs = plan.routes["wide"]
    asked = words.select("query_id", "hash", "rarity", "document_count", "required")

    def wanted(candidates: DataFrame, entries: DataFrame) -> DataFrame:
        return join_words(candidates, entries, "query_id", "text_id", small)

    # From rarest to most frequent: a candidate is a request and a text, whatever else either holds.
    rarest = asked.filter("rarity = 1").select("query_id", "hash")
    own = needs.rarest.apply(index.postings).select("hash", "text_id")
    candidates = join_words(own, rarest, "hash", "text_id", small).select("query_id", "text_id")
    rows = needs.words.apply(index.postings)
    for first, last in STEPS:
        if plan.most_words <= last:
            # The words themselves are the next step.
            break
        step = asked.filter(F.col("rarity").between(first, last)).select("query_id", "hash", "required")
        met = rows.select("hash", "text_id").join(wanted(candidates, step), ["text_id", "hash"])
        met = met.groupBy("query_id", "text_id").agg(
            F.count(F.lit(1)).alias("met"), F.first("required").alias("required")
        )
        enough = F.least("required", F.lit(last)) - (first - 1)
        candidates = met.filter(F.col("met") == enough).select("query_id", "text_id")
    entries = asked.select("query_id", "hash", "document_count", "required")
    return rows.select("hash", "text_id", *values).join(wanted(candidates, entries), ["text_id", "hash"])


def route_hits(index: Index, plan: RequestPlan, route: str, values: list[str]) -> DataFrame:
    """Hits of one route's requests.

    A text has rows for as many different words as it holds; ``required`` says how many a match needs.
    ``values`` names the posting columns to keep.
    """
    words = plan.words.filter(F.col("route") == route)
    if route == "single":
        rows = plan.routes[route].words.apply(index.postings).select("hash", "text_id", *values)
        asked = words.select("query_id", "hash", "document_count", "required")
        found = join_words(rows, asked, "hash", "text_id", plan.broadcastable)
    else:
        found = (_narrow_hits if route == "narrow" else _wide_hits)(index, plan, words, values)
    return found.select("query_id", "text_id", "hash", "document_count", "required", *values)


def all_hits(index: Index, plan: RequestPlan, values: list[str]) -> list[tuple[str, DataFrame]]:
    """Hits by route, or all at once for a direct batch; without those of the index by text."""
    if plan.direct:
        return [("direct", _direct_hits(index, plan, values))] if plan.listed else []
    return [(route, route_hits(index, plan, route, values)) for route in plan.routes if route != "text"]


def text_matches(
    plan: RequestPlan, find: Callable[[Block, DataFrame], DataFrame], k: int
) -> DataFrame | None:
    """What ``find`` has in the index by text for blocks of requests and their terms, at least the ``k`` best of each.

    A block has about ``TEXT_BLOCK * BROADCAST_ROWS`` words.  If there are several, each is answered before the next is looked at
    and its best results are kept in the shared folder, so the driver never holds more than one.
    """
    if "text" not in plan.routes or plan.direct:
        return None
    words = plan.words.filter("route = 'text'")
    if plan.listed is not None:
        return find(Block.collect(words), plan.terms)
    terms = words.select("block", "query_id", F.explode("places").alias("phrase_offset"), "hash")
    if plan.blocks == 1:
        return find(Block.collect(words), terms)
    spark, found, schema = words.sparkSession, [], None
    folder = new_shared_path(spark, "matches")
    for number in range(plan.blocks):
        block = Block.collect(words.filter(F.col("block") == number))
        if len(block.query_ids):
            best = top_k(find(block, terms.filter(F.col("block") == number)), k).drop("result_number")
            found.append(f"{folder}/block={number}")
            best.write.parquet(found[-1])
            schema = best.schema
    return spark.read.schema(schema).parquet(*found) if found else None


def named_queries(plan: RequestPlan, frame: DataFrame) -> DataFrame:
    """A direct batch's rows with the ids of their requests instead of their places."""
    if not plan.direct:
        return frame
    ids = F.array(*[F.lit(query) for query in plan.queries]) if plan.queries else F.array()
    kind = plan.terms.schema["query_id"].dataType
    return frame.withColumn("query_id", F.get(ids, F.col("query_id")).cast(kind))


def phrase_lists(index: Index, plan: RequestPlan) -> DataFrame:
    """One row per request and text with all its words: ``lists`` of hash and positions, and text length.

    In a direct batch ``query_id`` is the request's place.
    """
    entry = F.struct("hash", "positions")
    matched = []
    for route, hits in all_hits(index, plan, ["positions", "words_total"]):
        if route == "single":
            lists = hits.withColumn("lists", F.array(entry))
        else:
            lists = (
                hits.groupBy("text_id", "query_id")
                .agg(
                    F.collect_list(entry).alias("lists"),
                    F.first("required").alias("required"),
                    F.first("words_total").alias("words_total"),
                )
                .filter(F.size("lists") == F.col("required"))
            )
        matched.append(lists.select("query_id", "text_id", "words_total", "lists"))
    return union_all(matched) if matched else _no_lists(plan)


def _no_lists(plan: RequestPlan) -> DataFrame:
    query_type = "int" if plan.direct else plan.terms.schema["query_id"].dataType.simpleString()
    return no_rows(
        plan.terms.sparkSession,
        f"query_id {query_type}, text_id long, words_total int, "
        "lists array<struct<hash: string, positions: array<int>>>",
    )


def match_all(index: Index, requests: DataFrame, unknown_terms: str = "drop") -> DataFrame:
    """Postings of all words of each request, in the texts that have all of them."""
    plan = compile_requests(index, requests, unknown_terms)
    lists = named_queries(plan, phrase_lists(index, plan))
    return lists.select("query_id", "text_id", F.inline("lists"))


def match_all_by_intersection(index: Index, requests: DataFrame, query_id) -> DataFrame:
    """Ids of the texts with all known words of one request, as a chain of INTERSECTs.

    The plain form of the same question, kept to check ``match_all`` against.
    """
    words = compile_requests(index, requests.filter(F.col("query_id") == query_id)).words
    found = None
    for row in words.orderBy("rarity").collect():
        own = index.postings.filter((F.col("bin") == row.bin) & (F.col("hash") == row.hash)).select("text_id")
        found = own if found is None else found.intersect(own)
    return no_rows(requests.sparkSession, "text_id long") if found is None else found
