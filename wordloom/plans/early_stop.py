"""Which texts the best answers of a few requests can be among.

Blocks of text ids tell what each word of a request can score in them at best.  The texts of the most promising
blocks are scored first; the score of the k-th best of them is a bar, and of the other blocks only those are read
that can reach it.  All texts that are left out score less than k others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.operators.indexing import Index
from wordloom.operators.ranking import top_k
from wordloom.plans.matching import DIRECT_POSTINGS, RequestPlan, _pruning_of, asked_by_hash
from wordloom.session import LITERALS, durable

# With fewer postings than this it is quicker to read them all.
EARLY_POSTINGS = 200_000
# Blocks of each request that are scored first, and blocks that the driver lists at most.
FIRST_BLOCKS = 8
LISTED_BLOCKS = 20_000
# Sums of rounded scores are compared with room for the rounding of doubles.
_ROOM = 1e-6

# (term frequency, document frequency, length of the text) -> score
Score = Callable[[Column, Column, Column], Column]


def _spans(blocks: list[int], block_texts: int) -> list[tuple[int, int]]:
    """Spans of ids that cover some blocks, at most ``LITERALS``: the closest ones become one."""
    blocks = sorted(blocks)
    gaps = sorted(((two - one, place) for place, (one, two) in enumerate(zip(blocks, blocks[1:]))), reverse=True)
    cuts = sorted(place for gap, place in gaps[: LITERALS - 1] if gap > 1)
    begins, ends = [0, *[place + 1 for place in cuts]], [*cuts, len(blocks) - 1]
    return [
        (blocks[begin] * block_texts, (blocks[end] + 1) * block_texts - 1)
        for begin, end in zip(begins, ends, strict=True)
        if blocks
    ]


def block_bounds(index: Index, plan: RequestPlan, score: Score) -> DataFrame:
    """``query_id`` (the request's place), ``block, bound`` of all blocks that have all words of the request."""
    rows = _pruning_of(plan.listed, index.bins).apply(index.blocks)
    rows = rows.select("block", "profile", F.inline(asked_by_hash(plan)))

    def best(step: Column) -> Column:
        frequency, count = step.term_frequency, F.col("document_count")
        return F.greatest(score(frequency, count, step.shortest), score(frequency, count, step.longest))

    reach = rows.select("query_id", "block", "required", F.array_max(F.transform("profile", best)).alias("reach"))
    found = reach.groupBy("query_id", "block").agg(
        F.sum("reach").alias("bound"), F.count(F.lit(1)).alias("words"), F.first("required").alias("required")
    )
    return found.filter(F.col("words") == F.col("required")).select("query_id", "block", "bound")


def spans_to_read(
    index: Index,
    plan: RequestPlan,
    k: int,
    score: Score,
    scored: Callable[[list[tuple[int, int]]], DataFrame],
    least_postings: int = EARLY_POSTINGS,
) -> list[tuple[int, int]] | None:
    """Spans of text ids that hold the ``k`` best texts of every request; None if that is not worth while.

    ``scored`` gives ``query_id, text_id, bm25_score`` of all matches with ids in some spans.
    """
    if index.blocks is None or index.uncounted_texts or not plan.listed or len(plan.listed) > LITERALS:
        return None
    counts = {word.hash: word.document_count for word in plan.listed}
    if sum(counts.values()) < least_postings or min(counts.values()) < index.block_texts:
        return None
    bounds = durable(block_bounds(index, plan, score))
    promising = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block")
    first = bounds.withColumn("place", F.row_number().over(promising)).filter(F.col("place") <= FIRST_BLOCKS)
    blocks = sorted({row.block for row in first.select("block").collect()})
    best = top_k(scored(_spans(blocks, index.block_texts)), k)
    bars = {
        row.query_id: row.bar
        for row in best.groupBy("query_id").agg(F.min("bm25_score").alias("bar"), F.count(F.lit(1)).alias("rows")).collect()
        if row.rows >= k
    }
    reached = F.lit(False)
    for place in range(len(plan.queries)):
        own = F.col("query_id") == place
        reached |= own & (F.col("bound") >= bars[place] - _ROOM) if place in bars else own
    needed = bounds.filter(reached).select("block").distinct().limit(LISTED_BLOCKS + 1).collect()
    if len(needed) > LISTED_BLOCKS:
        return None
    if not plan.direct and len(needed) * index.block_texts * len(counts) > DIRECT_POSTINGS:
        return None
    return _spans([row.block for row in needed], index.block_texts)
