"""Mixing sources to target weights with hash-threshold histograms.

Every document has a stable hash of id and text.  A source takes whole passes over its documents as long as its
target allows, and of the rest those whose hash is below a threshold.  The threshold is found without
sorting: words are summed by source and hash bucket, the bucket where the budget ends is cut into finer
buckets, and so on until the hash is used up.  Thresholds for smaller budgets are nested in those for larger.

The document at the threshold is taken if that ends nearer to the target.  Repeated rows with the same id and text
share a hash; where they are at the threshold as many of them are taken as end nearest to it, told apart by a number.
A null text has size 0, a null id counts as empty, rows without a source are a
source of their own that comes last.  An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.operators.numbering import numbered
from wordloom.session import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
# Hash digits (16 values each) that one histogram tells apart, and digits in all.
_DIGITS = 3
_ALL_DIGITS = 15
# Sources are broadcast up to so many.
_BROADCAST = 100_000


def words_in(text: Column) -> Column:
    """Number of runs without white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def stable_hash(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of md5 over id and text."""
    named = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, _ALL_DIGITS), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A name that is never null and keeps the order by code point, null last."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("~"))


def targets(sizes: DataFrame) -> DataFrame:
    """``key, source_size, target`` from ``key, source_size``.

    Weights go around by the order of keys.  What is above a source's limit is shared among the others by
    weight, until none is above: one number per weight settles it, found by repeated sums over the sources.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    weighed = numbered(sizes, ["key"], "place").select("key", "source_size", weight.alias("weight"))
    limit = F.col("source_size") * REPEATS
    every = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weights, capped = every[0] or 0, every[1] or 0, 0
    while weights:
        share = F.lit(SHARE * total - capped) * F.col("weight") / F.lit(float(weights))
        now = weighed.agg(
            F.coalesce(F.sum(F.when(limit < share, limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(limit >= share, F.col("weight"))), F.lit(0)),
        ).first()
        if tuple(now) == (capped, weights):
            break
        capped, weights = now
    if not weights:
        return weighed.select("key", "source_size", limit.cast("double").alias("target"))
    share = F.lit(SHARE * total - capped) * F.col("weight") / F.lit(float(weights))
    return weighed.select(
        "key", "source_size", F.when(limit < share, limit.cast("double")).otherwise(share).alias("target")
    )


def _joined(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(sources) if few else sources, "key")


def thresholds(sized: DataFrame) -> DataFrame:
    """``key, source_size, target, passes, threshold, at_threshold, group_rows`` of every source.

    ``sized`` has ``key, size, hash``.  ``passes`` whole passes are taken, then what is below ``threshold``, and
    ``at_threshold`` of the ``group_rows`` rows that are at it.
    """
    sizes = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = targets(sizes).withColumn("passes", passes.cast("int"))
    budget = F.col("target") - F.col("passes") * F.col("source_size")
    state = state.select("key", "source_size", "target", "passes", budget.alias("rest"), F.lit(0).cast("long").alias("prefix"))
    state = written(state, "targets")
    few = state.count() <= _BROADCAST
    by_bucket = Window.partitionBy("key").orderBy("bucket")
    for used in range(_DIGITS, _ALL_DIGITS + 1, _DIGITS):
        # Rows of the bucket where the budget ends, by the next digits.
        cut = F.shiftright("hash", 4 * (_ALL_DIGITS - used))
        inside = _joined(sized, state.select("key", "prefix"), few).filter(
            F.shiftright("hash", 4 * (_ALL_DIGITS - used + _DIGITS)) == F.col("prefix")
        )
        histogram = inside.groupBy("key", cut.alias("bucket")).agg(
            F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")
        )
        summed = histogram.select(
            "key", "bucket", "size", "rows", F.sum("size").over(by_bucket).alias("up_to")
        )
        # The first bucket with more than the rest; where there is none, all rows are below.
        ends = (
            _joined(summed, state.select("key", "rest"), few)
            .filter(F.col("up_to") > F.col("rest"))
            .groupBy("key")
            .agg(F.min(F.struct("bucket", "size", "rows", "up_to")).alias("end"))
        )
        left = F.col("rest") - (F.col("end.up_to") - F.col("end.size"))
        # Of rows of the same size, as many as end nearest to the rest.
        nearest = F.floor((2 * left * F.col("end.rows") + F.col("end.size")) / (2.0 * F.col("end.size")))
        state = (
            state.join(ends, "key", "left")
            .select(
                "key",
                "source_size",
                "target",
                "passes",
                F.when(F.col("end").isNull(), F.col("rest")).otherwise(left).alias("rest"),
                F.coalesce(
                    F.col("end.bucket"),
                    F.shiftleft(F.col("prefix") + 1, 4 * _DIGITS),
                ).alias("prefix"),
                F.coalesce(nearest, F.lit(0)).cast("long").alias("at_threshold"),
                F.coalesce(F.col("end.rows"), F.lit(0)).alias("group_rows"),
            )
        )
        state = written(state, "thresholds")
    columns = ["key", "source_size", "target", "passes", F.col("prefix").alias("threshold"), "at_threshold", "group_rows"]
    return state.select(*columns)


def with_times(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (``key, hash`` and more) with their source's ``thresholds`` and ``times``, how often each is taken."""
    rows = _joined(rows, found, found.count() <= _BROADCAST)
    below, at = F.col("hash") < F.col("threshold"), F.col("hash") == F.col("threshold")
    cut = (F.col("at_threshold") > 0) & (F.col("at_threshold") < F.col("group_rows"))
    whole = below | (at & (F.col("at_threshold") > 0))
    if found.filter(cut).isEmpty():
        return rows.withColumn("times", F.col("passes") + whole.cast("int"))
    # Repeated rows at a threshold are numbered source by source; no other row is.
    group = numbered(rows.filter(cut & at), ["key"], "number")
    first = group.groupBy("key").agg(F.min("number").alias("first"))
    group = _joined(group, first, first.count() <= _BROADCAST)
    some = F.col("number") - F.col("first") < F.col("at_threshold")
    group = group.withColumn("times", F.col("passes") + some.cast("int")).drop("number", "first")
    others = rows.filter(~(cut & at)).withColumn("times", F.col("passes") + whole.cast("int"))
    return others.unionByName(group)


def sized_documents(documents: DataFrame) -> DataFrame:
    """``doc_id, key, size, hash`` of every document, as a table."""
    text = F.col("text")
    return written(
        documents.select(
            "doc_id",
            source_key(F.col("source")).alias("key"),
            words_in(text).alias("size"),
            stable_hash(F.col("doc_id"), text).alias("hash"),
        ),
        "sized",
    )


def mix(documents: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    sized = sized_documents(documents)
    rows = with_times(sized, thresholds(sized))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns."""
    found = thresholds(sized_documents(documents))
    names = documents.columns
    rows = documents.select(
        F.struct(*[F.col(f"`{name}`") for name in names]).alias("row"),
        source_key(F.col("source")).alias("key"),
        stable_hash(F.col("doc_id"), F.col("text")).alias("hash"),
    )
    times = with_times(rows, found).filter("times > 0")
    return times.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
