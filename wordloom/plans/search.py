"""Search: requests in, ranked texts out.

All searchers take a table of requests (``query_id``, ``request``), one row per request, and answer

    query_id, result_number, text_id, bm25_score, matching_words

with at most k rows per request, best first.  A request that matches nothing has no rows.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.postings import phrase_occurrences
from wordloom.functions.ranking import K1, SCORE_DIGITS, B, bm25
from wordloom.operators.indexing import Index
from wordloom.operators.ranking import top_k
from wordloom.operators.results import attach_texts
from wordloom.plans.by_text import Block
from wordloom.plans.early_stop import EARLY_POSTINGS, spans_to_read
from wordloom.plans.matching import (
    Folded,
    RequestPlan,
    all_hits,
    asked_terms,
    compile_requests,
    fold_requests,
    join_words,
    lookup,
    named_queries,
    phrase_lists,
    text_matches,
    uncounted_words,
    word_pruning,
)
from wordloom.session import BROADCAST_ROWS, LITERALS, LOCAL_ROWS, no_rows, union_all
from wordloom.sources.corpus import TextStore

METHODS = ("exact_phrase", "any_position")
RESULTS = 10


def _score(term_frequency, document_count, total_documents, average_length, k1, b) -> Column:
    return bm25(
        F.col(term_frequency),
        F.col(document_count),
        F.col("words_total"),
        F.lit(total_documents),
        F.lit(average_length).cast("double"),
        k1,
        b,
    )


def _ranked(scored: DataFrame, k: int, folded: Folded | None = None, queries: int | None = None) -> DataFrame:
    results = top_k(scored, k, one_query=queries is not None and queries <= 1)
    if folded is not None:
        results = folded.spread_answers(results, k)
    return results.select("query_id", "result_number", "text_id", "bm25_score", "matching_words")


def _no_matches(frame: DataFrame) -> DataFrame:
    query_type = frame.schema["query_id"].dataType.simpleString()
    return no_rows(
        frame.sparkSession,
        f"query_id {query_type}, text_id long, bm25_score double, matching_words long",
    )


def _word_matches(index: Index, terms: DataFrame, k1: float, b: float) -> DataFrame:
    """All texts with the only word of a request; ``terms`` has one row per request."""
    total, average = index.statistics()
    score = _score("term_frequency", "document_count", total, average, k1, b)
    pruning = word_pruning(terms, index.bins)
    metadata = pruning.apply(index.hash_metadata)
    rows = pruning.apply(index.postings).select("hash", "text_id", "term_frequency", "words_total")
    few = terms.select("query_id", "hash").limit(LITERALS + 1).collect()
    if len(few) <= LITERALS and pruning.hashes is not None:
        counts = {row.hash: row.document_count for row in metadata.collect()}
        kind = terms.schema["query_id"].dataType
        asked: dict[str, list[int]] = {}
        for place, row in enumerate(few):
            asked.setdefault(row.hash, []).append(place)
        places = lookup(
            F.col("hash"),
            {repr(name): f"array({', '.join(map(str, own))})" for name, own in asked.items()},
            "array<int>",
        )
        count = lookup(
            F.col("hash"),
            {repr(name): f"{counts[name]}L" if name in counts else "CAST(NULL AS BIGINT)" for name in asked},
            "long",
        )
        ids = F.array(*[F.lit(row.query_id) for row in few]) if few else F.array()
        found = rows.withColumn("document_count", count).withColumn("place", F.explode(places))
        found = found.withColumn("query_id", F.get(ids, F.col("place")).cast(kind))
    else:
        small = terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        frequency = terms.select("hash").distinct()
        if small:
            frequency = F.broadcast(frequency)
        metadata = metadata.join(frequency, "hash", "left_semi").select("hash", "document_count")
        known = terms.select("query_id", "hash").join(metadata, "hash", "left")
        found = join_words(rows, known, "hash", "text_id", small)
    return found.select(
        "query_id",
        "text_id",
        score.alias("bm25_score"),
        F.col("term_frequency").cast("long").alias("matching_words"),
    )


def search_word(
    index: Index, requests: DataFrame, k: int = RESULTS, k1: float = K1, b: float = B
) -> DataFrame:
    """Texts with a word; ``matching_words`` is how often it occurs.

    Answers requests of exactly one word.  A word whose document frequency is not known yet still matches,
    with a NULL score.
    """
    terms = asked_terms(index, requests)[0].filter("slots = 1")
    queries = terms.select("query_id").limit(LOCAL_ROWS + 1).collect()
    folded = None
    if len(queries) > LOCAL_ROWS:
        leaders, folded = fold_requests(terms.select("query_id", F.col("term").alias("words")))
        terms = terms.join(leaders.select("query_id"), "query_id", "left_semi")
    return _ranked(_word_matches(index, terms, k1, b), k, folded, len(queries))


def _scored_hits(route: str, hits: DataFrame, score: Column) -> DataFrame:
    """``query_id, text_id, bm25_score, matching_words`` of the texts with all words."""
    scored = hits.select("query_id", "text_id", "required", score.alias("bm25_score"))
    if route == "single":
        scored = scored.withColumn("matching_words", F.lit(1).cast("long"))
    else:
        scored = (
            scored.groupBy("text_id", "query_id")
            .agg(
                F.round(F.sum("bm25_score"), SCORE_DIGITS).alias("bm25_score"),
                F.count(F.lit(1)).alias("matching_words"),
                F.first("required").alias("required"),
            )
            .filter(F.col("matching_words") == F.col("required"))
        )
    return scored.select("query_id", "text_id", "bm25_score", "matching_words")


def _any_position_matches(
    index: Index, plan: RequestPlan, k: int, k1: float, b: float, early_postings: int = EARLY_POSTINGS
) -> DataFrame:
    """Matches of all requests, at least the ``k`` best of each."""

    def score_of(term_frequency: Column, document_count: Column, words_total: Column) -> Column:
        average = F.lit(plan.average_document_length).cast("double")
        return bm25(term_frequency, document_count, words_total, F.lit(plan.total_documents), average, k1, b)

    score = score_of(F.col("term_frequency"), F.col("document_count"), F.col("words_total"))
    values = ["term_frequency", "words_total"]

    def scored(spans: list[tuple[int, int]]) -> DataFrame:
        limited = dataclasses.replace(plan, direct=True, spans=spans)
        return union_all([_scored_hits(route, hits, score) for route, hits in all_hits(index, limited, values)])

    spans = spans_to_read(index, plan, k, score_of, scored, early_postings)
    if spans is not None:
        plan = dataclasses.replace(plan, direct=True, spans=spans)

    def in_texts(block: Block, _: DataFrame) -> DataFrame:
        scores = F.zip_with("frequencies", "counts", lambda tf, df: score_of(tf, df, F.col("words_total")))
        total = F.aggregate(scores, F.lit(0.0), lambda sum_, own: sum_ + own)
        found = block.any_position(index.text_words, k, plan.total_documents, plan.average_document_length, k1, b)
        return found.select(
            "query_id",
            "text_id",
            F.round(total, SCORE_DIGITS).alias("bm25_score"),
            F.size("counts").cast("long").alias("matching_words"),
        )

    found = text_matches(plan, in_texts, k)
    matched = [] if found is None else [found]
    matched += [_scored_hits(route, hits, score) for route, hits in all_hits(index, plan, values)]
    return named_queries(plan, union_all(matched)) if matched else _no_matches(plan.terms)


def search_any_position(
    index: Index,
    requests: DataFrame,
    k: int = RESULTS,
    k1: float = K1,
    b: float = B,
    unknown_terms: str = "drop",
    early_postings: int = EARLY_POSTINGS,
) -> DataFrame:
    """Texts with all words in any order; the score is the sum over the different words.

    A few requests whose words have ``early_postings`` or more read only what can be among their best, if the index
    is sorted.
    """
    plan = compile_requests(index, requests, unknown_terms, fold=True, by_text=True, any_order=True)
    return _ranked(_any_position_matches(index, plan, k, k1, b, early_postings), k, plan.folded, _queries(plan))


def _queries(plan: RequestPlan) -> int | None:
    return None if plan.queries is None else len(plan.queries)


def _with_phrases(plan: RequestPlan, lists: DataFrame) -> DataFrame:
    """Candidates with the phrase asked for: ``slots``, and ``minimum_count``, its rarest word's frequency."""
    if plan.direct:
        least = {word.query: word.minimum_count for word in plan.listed}
        slots = {n: f"array({', '.join(map(repr, own))})" for n, own in enumerate(plan.slots)}
        return lists.withColumns(
            {
                "slots": lookup(F.col("query_id"), slots, "array<string>"),
                "minimum_count": lookup(F.col("query_id"), {n: f"{c}L" for n, c in least.items()}, "long"),
            }
        )
    slots = (
        plan.terms.groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("phrase_offset", "hash"))).alias("slots"))
        .select("query_id", F.transform("slots", lambda slot: slot.hash).alias("slots"))
    )
    frequency = plan.words.select("query_id", "minimum_count").distinct()
    phrases = slots.join(frequency, "query_id")
    return join_words(lists, phrases, "query_id", "text_id", plan.broadcastable)


def _phrase_matches(index: Index, plan: RequestPlan, k: int, k1: float, b: float) -> DataFrame:
    if plan.paired:
        # Pairs have hashes of their own; each scan reads the bins and hashes that are asked for.
        index = dataclasses.replace(index, postings=index.postings.unionByName(index.pairs))
    score = _score(
        "occurrences",
        "minimum_count",
        plan.total_documents,
        plan.average_document_length,
        k1,
        b,
    )
    # The generator drops candidates without an occurrence: a filter would make Catalyst copy the
    # expression and compare all positions twice.
    occurrences = F.filter(F.array(phrase_occurrences("slots", "lists")), lambda found: found > 0)
    columns = ["query_id", "text_id", "words_total", "minimum_count"]
    found = _with_phrases(plan, phrase_lists(index, plan)).select(
        *columns, F.size("slots").alias("phrase_length"), F.explode(occurrences).alias("occurrences")
    )

    def scored(found: DataFrame) -> DataFrame:
        return found.select(
            "query_id",
            "text_id",
            score.alias("bm25_score"),
            (F.col("occurrences") * F.col("phrase_length")).cast("long").alias("matching_words"),
        )

    matches = scored(found)
    of_texts = text_matches(plan, lambda block, terms: scored(block.phrases(index.text_words, terms)), k)
    if of_texts is not None:
        matches = matches.unionByName(of_texts)
    return named_queries(plan, matches)


def search_phrase(
    index: Index, requests: DataFrame, k: int = RESULTS, k1: float = K1, b: float = B
) -> DataFrame:
    """Texts with the words next to each other in the order of the request, across punctuation.

    ``matching_words`` is the number of occurrences times the number of words.  A request with a word the
    index does not know matches nothing.
    """
    plan = compile_requests(index, requests, "require", fold=True, by_text=True, pairs=True)
    return _ranked(_phrase_matches(index, plan, k, k1, b), k, plan.folded, _queries(plan))


def search(
    index: Index,
    requests: DataFrame,
    k: int = RESULTS,
    method: str = "exact_phrase",
    texts: TextStore | None = None,
    unknown_terms: str | None = None,
) -> DataFrame:
    """Answer requests as a phrase or in any position, with their texts if a text store is given.

    A request of one word that has postings but no document frequency yet is answered by word alone.
    ``unknown_terms`` says what a word does that the index does not know; a phrase always needs all words.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    phrase = method == "exact_phrase"
    if phrase and unknown_terms not in (None, "require"):
        raise ValueError("a phrase requires all of its words")
    unknown_terms = "require" if phrase else unknown_terms or "drop"
    plan = compile_requests(
        index, requests, unknown_terms, fold=True, by_text=True, pairs=phrase, any_order=not phrase
    )
    find = _phrase_matches if phrase else _any_position_matches
    matches = find(index, plan, k, K1, B)

    queries = _queries(plan)
    uncounted = uncounted_words(plan)
    if uncounted is not None:
        matches = matches.unionByName(_word_matches(index, uncounted, K1, B))
        queries = None
    results = _ranked(matches, k, plan.folded, queries)
    return results if texts is None else attach_texts(results, texts)
