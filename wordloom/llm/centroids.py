"""Clusters of integer vectors around centroids, found with a vantage-point tree.

Vectors of exactly ``dimensions`` components, none null or non-finite, become integers ``floor(scale * x)``; all others
are left out.  The first centroids are the vectors with the smallest sha256 of ``1:<vec_id>`` (a null id counts as
empty text; of rows alike in id the smaller vector comes first).  Each round builds a vantage-point tree over the
centroids, ships it to every task and assigns each vector to its nearest centroid; then each centroid that has
vectors becomes the floor of their mean.  Fewer vectors than centroids are as many clusters; no vectors, no rows.
Repeated rows are vectors of their own.

A vector is searched best-first: of the open nodes the one with the least lower bound is next, and a node is left
out only if its bound is above the best distance so far, so that equal distances are always seen and the smaller
number wins.  A batch of vectors goes through the tree together, each with an agenda of its own.  Distances that
decide are exact integers; bounds are floats with room for their rounding.  Components beyond ``EXACT`` are
computed as Python integers.  A distance or sum that does not fit a long is null.
"""

from __future__ import annotations

import dataclasses
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import arrow_bounded
from wordloom.session import written

CENTROIDS = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
# Centroids of a leaf.
LEAF = 3
# Integers up to this size have squared distances that fit 64 bits, for up to 2^12 components.
EXACT = 1 << 24
# Vectors that go through the tree together.
_TOGETHER = 4096
# Room for the rounding of bounds, as part of the distances that they are made of.
_ROUNDING = 1e-9
_LONG = 2**63 - 1


@dataclasses.dataclass(frozen=True)
class Node:
    """A ball: centroids of ``leaf``, or those within ``radius`` of ``vantage`` and those from ``beyond`` on."""

    leaf: tuple[int, ...]
    vantage: int = -1
    radius: float = 0.0
    beyond: float = 0.0
    inner: int = -1
    outer: int = -1


def _whole(rows: list[list[int]]) -> np.ndarray:
    small = all(-EXACT <= x <= EXACT for own in rows for x in own)
    return np.array(rows, np.int64 if small else object)


def squared(ones: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors to one vector."""
    if ones.dtype == object or two.dtype == object:
        ones, two = ones.astype(object), two.astype(object)
    apart = ones - two
    return (apart * apart).sum(axis=1)


def _root(distance) -> float:
    """The distance of a squared one; infinite beyond doubles, where no bound is made of it."""
    try:
        return math.sqrt(distance)
    except OverflowError:
        return math.inf


def build_tree(centroids: np.ndarray) -> list[Node]:
    """A vantage-point tree; node 0 is the root.

    The vantage point of a node is the member that lies farthest from the first one; the median distance halves
    the others, equal distances staying together inside.
    """
    nodes: list[Node | None] = []

    def build(members: list[int]) -> int:
        place = len(nodes)
        nodes.append(None)
        if len(members) <= LEAF:
            nodes[place] = Node(tuple(members))
            return place
        from_first = squared(centroids[members], centroids[members[0]])
        vantage = members[max(range(len(members)), key=lambda i: (from_first[i], -i))]
        others = [member for member in members if member != vantage]
        distances = dict(zip(others, squared(centroids[others], centroids[vantage]), strict=True))
        middle = sorted(distances.values())[(len(others) - 1) // 2]
        inside = [member for member in others if distances[member] <= middle]
        outside = [member for member in others if distances[member] > middle]
        if not outside:
            # All lie within the median: no radius tells them apart.
            nodes[place] = Node(tuple(members))
            return place
        nodes[place] = Node(
            (),
            vantage,
            _root(max(distances[member] for member in inside)),
            _root(min(distances[member] for member in outside)),
            build(inside),
            build(outside),
        )
        return place

    build(list(range(len(centroids))))
    return nodes


def nearest(vectors: np.ndarray, centroids: np.ndarray, tree: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each vector; of equal ones the smaller number."""
    n = len(vectors)
    exact = vectors.dtype == object or centroids.dtype == object
    best = np.full(n, None, object) if exact else np.full(n, np.iinfo(np.int64).max, np.int64)
    found = np.full(n, -1, np.int64)
    reach = np.full(n, np.inf)
    # What each vector still has to look at, by node.
    bounds = np.full((n, len(tree)), np.inf)
    bounds[:, 0] = 0.0

    def meet(rows: np.ndarray, number: int) -> np.ndarray:
        distance = squared(vectors[rows], centroids[number])
        if exact:
            better = np.array(
                [best[row] is None or (d, number) < (best[row], found[row]) for row, d in zip(rows, distance, strict=True)],
                bool,
            )
        else:
            better = (distance < best[rows]) | ((distance == best[rows]) & (number < found[rows]))
        won = rows[better]
        best[won], found[won] = distance[better], number
        far = np.array([_root(d) for d in distance]) if exact else np.sqrt(distance.astype(np.float64))
        reach[won] = far[better]
        return far

    open_ = np.arange(n)
    while len(open_):
        chosen = bounds[open_].argmin(axis=1)
        least = bounds[open_, chosen]
        going = least <= reach[open_] * (1 + _ROUNDING)
        going &= np.isfinite(least)
        open_, chosen, least = open_[going], chosen[going], least[going]
        for number in np.unique(chosen).tolist():
            node = tree[number]
            at = chosen == number
            rows, bound = open_[at], least[at]
            bounds[rows, number] = np.inf
            for member in node.leaf:
                meet(rows, member)
            if node.vantage >= 0:
                far = meet(rows, node.vantage)
                known = np.isfinite(far) & math.isfinite(node.beyond)
                room = _ROUNDING * (far + node.beyond)
                with np.errstate(invalid="ignore"):
                    inner, outer = far - node.radius - room, node.beyond - far - room
                bounds[rows, node.inner] = np.maximum(bound, np.where(known, inner, 0.0))
                bounds[rows, node.outer] = np.maximum(bound, np.where(known, outer, 0.0))
    return found, best


def kept_vectors(embeddings: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``vec_id, vector`` of the vectors that are clustered."""
    vector = F.col("embedding")
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    kept = embeddings.filter((F.size(vector) == dimensions) & F.coalesce(finite, F.lit(False)))
    return kept.select("vec_id", F.transform(vector, lambda x: x.cast("double")).alias("vector"))


def integers(flat: np.ndarray, dimensions: int, scale: int = SCALE) -> np.ndarray:
    """Vectors of ``floor(scale * x)``: 64-bit integers where these are exact, else Python integers."""
    raw = np.asarray(flat, np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(raw * scale)
    if np.abs(scaled).max(initial=0) <= EXACT:
        return scaled.astype(np.int64).reshape(-1, dimensions)
    # A double so large that the product is beyond doubles is an integer itself.
    whole = [int(x) if np.isfinite(x) else int(y) * scale for x, y in zip(scaled, raw, strict=True)]
    return np.array(whole, object).reshape(-1, dimensions)


def _groups(column: pa.Array, dimensions: int, scale: int):
    """Integer vectors of a batch, some at a time."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    step = _TOGETHER * dimensions
    for begin in range(0, len(flat), step):
        yield integers(flat[begin : begin + step], dimensions, scale)


def _sums(vectors: DataFrame, centroids: np.ndarray, scale: int) -> tuple[list[int], list[list[int]]]:
    """How many vectors each centroid has and their sum, added up in tasks first; whole integers throughout."""
    tree, (k, dimensions) = build_tree(centroids), centroids.shape

    def add(batches):
        counts, sums = [0] * k, np.zeros((k, dimensions), object)
        for batch in batches:
            for own in _groups(batch.column(0), dimensions, scale):
                found, _ = nearest(own, centroids, tree)
                for number in np.unique(found).tolist():
                    mine = own[found == number]
                    counts[number] += len(mine)
                    sums[number] += mine.sum(axis=0).astype(object)
        filled = [number for number in range(k) if counts[number]]
        yield pa.record_batch(
            [
                pa.array([number * (dimensions + 1) + i for number in filled for i in range(dimensions + 1)], pa.int64()),
                pa.array([str(x) for number in filled for x in (counts[number], *sums[number])], pa.string()),
            ],
            ["place", "value"],
        )

    def total(batches):
        found: dict[int, int] = {}
        for batch in batches:
            for place, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[place] = found.get(place, 0) + int(value)
        yield pa.record_batch(
            [pa.array(list(found), pa.int64()), pa.array([str(x) for x in found.values()], pa.string())],
            ["place", "value"],
        )

    schema = "place long, value string"
    rows = vectors.select("vector").mapInArrow(add, schema).repartition("place").mapInArrow(total, schema)
    # One row per centroid and component.
    values = {row.place: int(row.value) for row in rows.collect()}
    width = dimensions + 1
    counts = [values.get(number * width, 0) for number in range(k)]
    return counts, [[values.get(number * width + i, 0) for i in range(1, width)] for number in range(k)]


def first_centroids(vectors: DataFrame, k: int, dimensions: int, scale: int) -> np.ndarray:
    named = F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.orderBy(F.sha2(named, 256), "vector").limit(k).select("vector").collect()
    return integers([x for row in rows for x in row.vector], dimensions, scale)


def fit_centroids(
    vectors: DataFrame,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
) -> np.ndarray:
    """Centroids after some rounds over ``vectors`` (``vec_id, vector``); those without vectors stay as they are."""
    centroids = first_centroids(vectors, k, dimensions, scale)
    for _ in range(rounds if len(centroids) else 0):
        counts, sums = _sums(vectors, centroids, scale)
        moved = [
            [x // count for x in own] if count else list(old)
            for count, own, old in zip(counts, sums, centroids.tolist(), strict=True)
        ]
        centroids = _whole(moved)
    return centroids


def _sum(column: str) -> Column:
    """A sum that is null if a part of it is, or if it does not fit a long."""
    summed = F.sum(F.col(column).cast("decimal(38,0)"))
    return F.when((F.count(column) == F.count(F.lit(1))) & (summed <= _LONG), summed.cast("long"))


def cluster(
    embeddings: DataFrame,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that is kept."""
    spark = embeddings.sparkSession
    arrow_bounded(spark)
    vectors = written(kept_vectors(embeddings, dimensions), "vectors")
    centroids = fit_centroids(vectors, k, rounds, dimensions, scale)
    tree = build_tree(centroids)

    def assign(column: pa.Array) -> pa.Array:
        numbers, distances = [], []
        for own in _groups(column, dimensions, scale):
            found, best = nearest(own, centroids, tree)
            numbers += found.tolist()
            distances += [d if d <= _LONG else None for d in best.tolist()]
        return pa.StructArray.from_arrays(
            [pa.array(numbers, pa.int32()), pa.array(distances, pa.int64())], ["cluster", "distance"]
        )

    found = F.arrow_udf(assign, "cluster int, distance long")(F.col("vector"))
    assigned = written(vectors.select("vec_id", found.alias("found")).select("vec_id", "found.*"), "assigned")
    sums = {
        row.cluster: row.inertia
        for row in assigned.groupBy("cluster").agg(_sum("distance").alias("inertia")).collect()
    }
    every = None if None in sums.values() or sum(sums.values()) > _LONG else sum(sums.values())
    # One row per centroid.
    about = pa.table(
        {
            "cluster": pa.array(sorted(sums), pa.int32()),
            "cluster_inertia": pa.array([sums[number] for number in sorted(sums)], pa.int64()),
            "inertia": pa.array([every] * len(sums), pa.int64()),
            "centroid_sha256": pa.array(
                [
                    hashlib.sha256(",".join(map(str, centroids[number].tolist())).encode()).hexdigest()
                    for number in sorted(sums)
                ],
                pa.string(),
            ),
        }
    )
    rows = assigned.join(F.broadcast(spark.createDataFrame(about)), "cluster")
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
