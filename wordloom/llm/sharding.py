"""Sharding by best-fit-decreasing bin packing.

Documents with equal texts are a group that stays together.  Groups enter bins by falling size, each into the
bin with the least remaining capacity that still holds it; a balanced tree of remaining capacities finds that
bin.  ``pack`` uses as few bins of a fixed capacity as it can; for a fixed number of shards the smallest
capacity is taken that needs no more of them.

Groups of a size are packed as a run: the bin that holds one is the tightest for the next too, as long as that
fits, so a run costs a step for each bin it enters.  What the driver packs is bounded by the number of
different sizes and not by the corpus; sizes of more than ``SIZE_BITS`` bits count as if rounded up to so many.
A group larger than a shard cannot stay together: it is cut into pieces of a shard each.  Null texts are equal
to each other and have no bytes.  Repeated rows share a group and have slots of their own.
"""

from __future__ import annotations

import dataclasses
import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.operators.numbering import numbered
from wordloom.session import written

SHARDS = 24
# Groups of at least capacity / FINE bytes, at most FINE per shard, meet their rows by broadcast.
FINE = 1_000
# Sizes are exact below 2^16; there are at most 2^16 below that, and 2^15 from each power of two to the next.
SIZE_BITS = 16
ROW_BYTES = 8


class CapacityTree:
    """Bins by remaining capacity in an AVL tree; equal capacities are told apart by the bin's number."""

    @dataclasses.dataclass
    class _Node:
        key: tuple[int, int]
        left: CapacityTree._Node | None = None
        right: CapacityTree._Node | None = None
        height: int = 1

    def __init__(self):
        self._root = None

    @staticmethod
    def _height(node) -> int:
        return node.height if node else 0

    def _lift(self, node, left_up: bool):
        child = node.left if left_up else node.right
        if left_up:
            node.left, child.right = child.right, node
        else:
            node.right, child.left = child.left, node
        for changed in (node, child):
            changed.height = 1 + max(self._height(changed.left), self._height(changed.right))
        return child

    def _level(self, node):
        left, right = self._height(node.left), self._height(node.right)
        node.height = 1 + max(left, right)
        if left > right + 1:
            if self._height(node.left.left) < self._height(node.left.right):
                node.left = self._lift(node.left, False)
            return self._lift(node, True)
        if right > left + 1:
            if self._height(node.right.right) < self._height(node.right.left):
                node.right = self._lift(node.right, True)
            return self._lift(node, False)
        return node

    def add(self, remaining: int, number: int) -> None:
        def put(node):
            if node is None:
                return self._Node((remaining, number))
            if (remaining, number) < node.key:
                node.left = put(node.left)
            else:
                node.right = put(node.right)
            return self._level(node)

        self._root = put(self._root)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the least remaining capacity that is at least ``size``."""
        node, best = self._root, None
        while node is not None:
            if node.key[0] >= size:
                best, node = node.key, node.left
            else:
                node = node.right
        if best is not None:
            self._root = self._without(self._root, best)
        return best

    def _without(self, node, key):
        if key < node.key:
            node.left = self._without(node.left, key)
        elif key > node.key:
            node.right = self._without(node.right, key)
        elif node.left is None or node.right is None:
            return node.left or node.right
        else:
            least = node.right
            while least.left is not None:
                least = least.left
            node.key = least.key
            node.right = self._without(node.right, least.key)
        return self._level(node)


def pack_runs(runs: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int]]:
    """Runs of items, (size, count) by falling size, as (number of the run, bin, count) in the order of packing."""
    tree, bins, found = CapacityTree(), 0, []
    for run, (size, count) in enumerate(runs):
        while count:
            bin_ = tree.take_tightest(size)
            if bin_ is None:
                bin_ = (max(capacity, size), bins)
                bins += 1
            entering = min(count, bin_[0] // size)
            tree.add(bin_[0] - entering * size, bin_[1])
            found.append((run, bin_[1], entering))
            count -= entering
    return found


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item; items must come by falling size.  One beyond the capacity has a bin to itself."""
    return [bin_ for _, bin_, _ in pack_runs([(size, 1) for size in sizes], capacity)]


def pack_into(runs: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """``pack_runs`` into at most ``shards`` bins with about the smallest capacity that allows it."""
    if not runs:
        return []

    def fits(found: list[tuple[int, int, int]]) -> bool:
        return all(bin_ < shards for _, bin_, _ in found)

    low = max(-(-sum(size * count for size, count in runs) // shards), runs[0][0])
    found = pack_runs(runs, low)
    if fits(found):
        return found
    # Twice the mean always suffices for what fits into it: two bins less than half full would be one.
    high, best = low, found
    step = max(low // 1_000, 1)
    while not fits(best):
        low, high = high, high + step
        best, step = pack_runs(runs, high), step * 2
    while high - low > max(high // 20_000, 1):
        middle = (low + high) // 2
        found = pack_runs(runs, middle)
        if fits(found):
            high, best = middle, found
        else:
            low = middle
    return best


def _rounded(size: Column) -> Column:
    """The size, rounded up to ``SIZE_BITS`` significant bits."""
    over = F.greatest(F.length(F.bin(size)) - SIZE_BITS, F.lit(0))
    unit = F.pow(F.lit(2), over).cast("long")
    return F.ceil(size / unit) * unit


def assign_shards(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``rows`` (``group``, ``size``, ``doc_id``, and more) with ``shard`` and ``slot``.

    Slots count from 0 in every shard by ``doc_id``.
    """
    spark = rows.sparkSession
    groups = written(
        rows.groupBy("group").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), F.max("size").alias("each")),
        "groups",
    )
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    capacity = max(-(-total // shards), 1)
    # Fewer than ``shards`` groups are larger than one.
    cut_groups = groups.filter(F.col("bytes") > capacity).collect()
    whole_groups = groups.filter(F.col("bytes") <= capacity).select(
        _rounded(F.col("bytes")).alias("run"), "group", (F.col("bytes") >= capacity // FINE).alias("large")
    )
    counts = whole_groups.groupBy("run").agg(F.count(F.lit(1)).alias("n")).orderBy("run").toArrow().to_pydict()

    # (size, count, piece, group); a run of whole groups has piece -1.
    runs: list[tuple[int, int, int, bytes]] = [(size, n, -1, b"") for size, n in zip(*counts.values(), strict=True)]
    first_of = dict(zip(counts["run"], itertools.accumulate(counts["n"], initial=0), strict=False))
    pieces: dict[bytes, int] = {}
    for row in cut_groups:
        own = max(capacity // row.each, 1)
        pieces[bytes(row.group)] = own
        for piece in range(math.ceil(row.rows / own)):
            size = min(own, row.rows - piece * own) * row.each
            runs.append((size, 1, piece, bytes(row.group)))
    runs.sort(key=lambda run: (-run[0], *run[1:]))

    # Groups are numbered by size; each step of the packing takes the next numbers of its run.
    steps, of_piece = [], []
    for number, shard, n in pack_into([run[:2] for run in runs], shards):
        size, _, piece, group = runs[number]
        if piece >= 0:
            of_piece.append((group, piece, shard))
        else:
            steps.append((size, first_of[size], first_of[size] + n, shard))
            first_of[size] += n
    of_run = spark.createDataFrame(steps, "run long, since long, till long, shard int")
    # As small as what was packed.
    placed_groups = written(
        numbered(whole_groups, ["run", "group"], "number")
        .join(F.broadcast(of_run), "run")
        .filter("number >= since AND number < till")
        .select("group", "shard", "large"),
        "placed_groups",
    )
    large = placed_groups.filter("large").select("group", "shard")
    small = placed_groups.filter("NOT large").select("group", "shard")
    cut = spark.createDataFrame(list(pieces.items()), "group binary, piece_rows long")
    by_broadcast = large.select("group").unionByName(cut.select("group"))
    # No group that is left for the shuffle has more than a thousandth of a shard.
    placed = (
        rows.join(F.broadcast(large), "group")
        .unionByName(rows.join(F.broadcast(by_broadcast), "group", "left_anti").join(small, "group"))
        .select(*rows.columns, "shard")
    )
    if pieces:
        counted = numbered(rows.join(F.broadcast(cut), "group"), ["group", "doc_id"], "number")
        first = counted.groupBy("group").agg(F.min("number").alias("first"))
        piece = F.floor((F.col("number") - F.col("first")) / F.col("piece_rows")).cast("int")
        of_piece = spark.createDataFrame(of_piece, "group binary, piece int, shard int")
        placed = placed.unionByName(
            counted.join(F.broadcast(first), "group")
            .withColumn("piece", piece)
            .join(F.broadcast(of_piece), ["group", "piece"])
            .select(*rows.columns, "shard")
        )
    ordered = numbered(placed, ["shard", "doc_id", "group"], "slot")
    first = ordered.groupBy("shard").agg(F.min("slot").alias("first"))
    return ordered.join(F.broadcast(first), "shard").select(
        *rows.columns, "shard", (F.col("slot") - F.col("first")).alias("slot")
    )


def _measured(documents: DataFrame, *more) -> DataFrame:
    text = F.col("text").cast("binary")
    return documents.select(
        "doc_id",
        F.coalesce(F.unhex(F.md5(text)), F.lit(b"")).alias("group"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        *more,
    )


def shard_documents(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every document."""
    rows = written(_measured(documents, F.crc32(F.col("text").cast("binary")).alias("text_crc32")), "measured")
    return assign_shards(rows, shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def sharded(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """All columns of ``documents``, then ``shard`` and ``slot``, which replace columns of these names."""
    names = [name for name in documents.columns if name not in ("shard", "slot")]
    row = F.struct(*[F.col(f"`{name}`") for name in names]).alias("row")
    return assign_shards(_measured(documents, row), shards).select("row.*", "shard", "slot")
