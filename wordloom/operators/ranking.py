"""The best results of each request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Parts a request's results are ranked in first, where k is too big for Spark's own early limit.
SLICES = 256


def top_k(scored: DataFrame, k: int, one_query: bool = False) -> DataFrame:
    """At most ``k`` rows per ``query_id``, numbered from 1 by falling score, then text id.

    The answer to a single request needs no shuffle: the best of each task are merged.

    Spark drops all but the k best rows of a request in every task before it shuffles, as long as k is
    within ``spark.sql.optimizer.windowGroupLimitThreshold``.  Beyond that the rows are ranked in slices
    first, so that no task sorts all matches of a frequent request.
    """
    order = [F.col("bm25_score").desc_nulls_last(), F.col("text_id")]
    threshold = int(
        scored.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")
    )
    if one_query and k <= threshold:
        # A window without a key over at most k rows, which stand in one partition already.
        best = scored.orderBy(*order).limit(k)
        return best.withColumn("result_number", F.row_number().over(Window.orderBy(*order)))
    if k > threshold:
        slices = Window.partitionBy("query_id", "slice").orderBy(*order)
        scored = (
            scored.withColumn("slice", F.pmod(F.xxhash64("text_id"), F.lit(SLICES)))
            .withColumn("place", F.row_number().over(slices))
            .filter(F.col("place") <= k)
            .drop("slice", "place")
        )
    ranked = Window.partitionBy("query_id").orderBy(*order)
    return scored.withColumn("result_number", F.row_number().over(ranked)).filter(
        F.col("result_number") <= k
    )
