"""What several operators share: words, stable samples, classes of linked rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.session import arrow_bounded, written  # noqa: F401

# A word over UTF-8 bytes, once A-Z are in lower case: digits, letters a-z, and all beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text given as UTF-8; ``bytes.lower`` changes A-Z only."""
    return WORD.findall(text.lower()) if text else []


def held_out(doc_id: Column | str) -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 4, is 2.  A null id counts as empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def row_hash(columns: Sequence[Column | str]) -> Column:
    """64 bits that depend on the values alone; a null is a value of its own."""
    columns = [F.col(column) if isinstance(column, str) else column for column in columns]
    return F.xxhash64(*columns, *[column.isNull() for column in columns])


def hash_share(columns: Sequence[Column | str]) -> Column:
    """A number from 0 to 1 that depends on the values alone; a null is a value of its own."""
    return F.pmod(row_hash(columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def different_rows(columns: Sequence[Column | str]) -> Column:
    """About how many rows differ in these columns, to 2 %: an aggregate of fixed size, whatever is repeated."""
    return F.approx_count_distinct(row_hash(columns), 0.02)


# A node with more links than this never has them brought into one task.
HOT_LINKS = 10_000
# As many hot nodes at most are broadcast: beyond that only those with still more links count as hot.
HOT_NODES = 10_000


def _starred(edges: DataFrame, key: str, other: str, hot: DataFrame | None) -> DataFrame:
    """``edges`` with ``least``, the smallest ``other`` of each ``key``.

    The links of a node come together in one task, but for those of ``hot`` nodes, which stay where they are.
    """
    grouped = Window.partitionBy(key)
    if hot is None:
        return edges.withColumn("least", F.min(other).over(grouped))
    named = F.broadcast(hot.withColumnRenamed("hot", key))
    cold = edges.join(named, key, "left_anti").withColumn("least", F.min(other).over(grouped))
    own = edges.join(named, key, "left_semi")
    least = own.groupBy(key).agg(F.min(other).alias("least"))
    return cold.unionByName(own.join(F.broadcast(least), key))


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """``node, component`` for every end of ``links`` (``left``, ``right``): the smallest id reachable.

    Alternating stars: large-star and small-star steps until every node is linked with the smallest of its
    component only.  The links of a node meet in one task; a hot node's never do, as its smallest neighbour is an
    aggregate that is broadcast, for at most ``HOT_NODES`` nodes.  Rounds grow with the logarithm of the longest
    path, so 50 are beyond any table; a RuntimeError tells if they are not.
    """
    edges = written(
        links.select(
            F.greatest("left", "right").alias("high"), F.least("left", "right").alias("low")
        )
        .filter("high != low")
        .distinct(),
        "links",
    )
    kind = edges.schema["low"].dataType.simpleString()
    for _ in range(rounds + 1):
        both = edges.select(F.col("high").alias("node"), F.col("low").alias("other")).unionByName(
            edges.select(F.col("low").alias("node"), F.col("high").alias("other"))
        )
        nodes = both.groupBy("node").agg(F.min("other").alias("least"), F.count(F.lit(1)).alias("links"))
        # Settled is a node with one link, or the smallest of its neighbours and itself.
        settled = (F.col("links") == 1) | (F.col("least") > F.col("node"))
        found = nodes.agg(F.count_if(~settled).alias("open"), F.max("links").alias("links")).first()
        if not found.open:
            break
        hot = None
        if found.links > HOT_LINKS:
            # No more than 2 * links / limit nodes have more links than the limit.
            limit = max(HOT_LINKS, 2 * edges.count() // HOT_NODES)
            names = [row.node for row in nodes.filter(F.col("links") > limit).select("node").collect()]
            if names:
                hot = edges.sparkSession.createDataFrame([(name,) for name in names], f"hot {kind}")
        # Large star: higher neighbours of a node are linked to the smallest of its neighbours and itself.
        large = _starred(both, "node", "other", hot).filter("other > node")
        large = large.select(F.col("other").alias("high"), F.least("least", "node").alias("low"))
        # Small star: lower neighbours of a node, and the node, are linked to the smallest of them.
        small = _starred(large, "high", "low", hot)
        ends = F.explode(F.array("high", "low"))
        small = small.select(ends.alias("high"), F.col("least").alias("low")).filter("high != low")
        edges = written(small.distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    members = edges.select(F.col("high").alias("node"), F.col("low").alias("component"))
    roots = edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return members.unionByName(roots)


def more_components(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` (as ``components`` gives them) after more ``links``: only components are linked anew."""

    def of(end: str) -> DataFrame:
        return groups.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component"))

    between = links.join(of("left"), "left", "left").join(of("right"), "right", "left")
    joined = components(
        between.select(
            F.coalesce("left_component", "left").alias("left"),
            F.coalesce("right_component", "right").alias("right"),
        )
    )
    renamed = joined.select(F.col("node").alias("component"), F.col("component").alias("joined"))
    old = groups.join(renamed, "component", "left").select(
        "node", F.coalesce("joined", "component").alias("component")
    )
    return written(old.unionByName(joined.join(groups, "node", "left_anti")), "components")
