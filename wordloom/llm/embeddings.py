"""Embedding near-duplicates by a PCA-ordered tiled comparison.

Vectors of a label are scaled to length 1, turned to principal axes, put in order of a grid over the leading
axes and cut into tiles.  Two tiles are compared only if the boxes around their leading coordinates are near
enough.  Of two tiles all products of the leading axes come first; what they and the length of the remaining
parts cannot bring to the threshold is dropped, the rest goes on axis block by axis block, and what remains is
decided by the full product, near the threshold by that of the original vectors.

A pair of tiles yields counts of links and a spanning forest of them, never the links themselves.  Vectors that
are equal and have the same label are one vector with a weight.

Vectors that are null, zero, or hold null or non-finite components, and those without a label, link with
nothing, nor do vectors of different lengths.  Rows with the same ``vec_id`` are vectors of their own.  A null
``vec_id`` takes part like any other and is never the smallest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import arrow_bounded, components
from wordloom.operators.numbering import numbered
from wordloom.session import written

COSINE = 0.98
TILE = 2048
# Axes of the order, of the boxes, and of one step of a product.
_ORDER_AXES = 3
_BOX_AXES = 8
_STEP = 16
# Lengths of vectors that have principal axes, those of most vectors; others keep their own axes, which leave out less.
_LENGTHS = 100
# And the longest of them: axes are a square matrix.
_LONGEST = 4_096
_MARGIN = 1e-9


def _rows_of(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors as arrays of doubles; None for what links with nothing."""
    found = []
    for value in column:
        vector = value.as_py()
        if not vector or any(x is None for x in vector):
            found.append(None)
            continue
        vector = np.array(vector, np.float64)
        big = np.abs(vector).max()
        found.append(vector if np.isfinite(big) and big > 0 else None)
    return found


def unit(vector: np.ndarray) -> np.ndarray:
    """The vector at length 1; scaled first, so that no square leaves the range of doubles."""
    vector = vector / np.abs(vector).max()
    return vector / np.sqrt(vector @ vector)


def _vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, size, vector`` (bytes of doubles at length 1; null if it links with nothing), a table."""

    def convert(batches):
        for batch in batches:
            rows = _rows_of(batch.column(2))
            labels = batch.column(1)
            valid = [row is not None and labels[i].is_valid for i, row in enumerate(rows)]
            yield pa.record_batch(
                [
                    batch.column(0),
                    labels,
                    pa.array([len(r) if v else None for r, v in zip(rows, valid, strict=True)], pa.int32()),
                    pa.array([unit(r).tobytes() if v else None for r, v in zip(rows, valid, strict=True)], pa.binary()),
                ],
                ["vec_id", "label", "size", "vector"],
            )

    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    schema = "vec_id long, label string, size int, vector binary"
    return written(rows.mapInArrow(convert, schema), "vectors")


class Axes(dict):
    """Axes of each length of vectors, as columns; its own ones for a length that is not named."""

    def __missing__(self, size: int) -> np.ndarray:
        return np.eye(size)


def principal_axes(vectors: DataFrame) -> Axes:
    """For each length of vectors, axes by falling variance, as columns."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.array(batch.column(0).to_pylist())
            for size in np.unique(sizes).tolist():
                rows = np.frombuffer(
                    b"".join(batch.column(1).filter(pa.array(sizes == size)).to_pylist()), np.float64
                ).reshape(-1, size)
                rows = np.hstack([np.ones((len(rows), 1)), rows])
                sums[size] = sums.get(size, 0) + rows.T @ rows
        yield pa.record_batch(
            [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
            ["size", "sums"],
        )

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[size] = sums.get(size, 0) + np.frombuffer(own, np.float64)
        yield pa.record_batch(
            [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
            ["size", "sums"],
        )

    schema = "size int, sums binary"
    rows = vectors.filter(F.col("vector").isNotNull()).select("size", "vector")
    most = rows.filter(F.col("size") <= _LONGEST).groupBy("size").count()
    most = most.orderBy(F.col("count").desc(), "size").limit(_LENGTHS).collect()
    rows = rows.filter(F.col("size").isin([row.size for row in most]))
    summed = rows.mapInArrow(add, schema).repartition(8).mapInArrow(merge, schema).collect()
    total: dict[int, np.ndarray] = {}
    for row in summed:
        total[row.size] = total.get(row.size, 0) + np.frombuffer(row.sums, np.float64)
    axes = Axes()
    for size, sums in total.items():
        sums = sums.reshape(size + 1, size + 1)
        n, mean = sums[0, 0], sums[0, 1:] / sums[0, 0]
        _, columns = np.linalg.eigh(sums[1:, 1:] / n - np.outer(mean, mean))
        axes[size] = np.ascontiguousarray(columns[:, ::-1])
    return axes


def compare_tiles(a: np.ndarray, b: np.ndarray, axes: np.ndarray, cosine: float = COSINE) -> np.ndarray:
    """Which rows of ``a`` and ``b`` (of length 1) are linked, as a matrix of booleans."""
    turned_a, turned_b = a @ axes, b @ axes
    size = a.shape[1]
    lead = min(_STEP, size)
    product = turned_a[:, :lead] @ turned_b[:, :lead].T

    def rest(turned: np.ndarray, done: int) -> np.ndarray:
        return np.sqrt(np.maximum((turned[:, done:] ** 2).sum(1), 0))

    alive = product + np.outer(rest(turned_a, lead), rest(turned_b, lead)) >= cosine - _MARGIN
    rows, columns = np.nonzero(alive)
    linked = np.zeros(product.shape, bool)
    if not len(rows):
        return linked
    if len(rows) * 8 > product.size:
        # Most pairs go on: the remaining axes at once.
        product += turned_a[:, lead:] @ turned_b[:, lead:].T
        linked = alive & (product >= cosine + _MARGIN)
        rows, columns = np.nonzero(alive & (np.abs(product - cosine) < _MARGIN))
    else:
        sums, done = product[rows, columns], lead
        while done < size and len(rows):
            upto = min(done + _STEP, size)
            sums = sums + np.einsum("ij,ij->i", turned_a[rows, done:upto], turned_b[columns, done:upto])
            reach = sums + rest(turned_a, upto)[rows] * rest(turned_b, upto)[columns]
            go = reach >= cosine - _MARGIN
            rows, columns, sums, done = rows[go], columns[go], sums[go], upto
    if len(rows):
        exact = np.einsum("ij,ij->i", a[rows], b[columns])
        linked[rows[exact >= cosine], columns[exact >= cosine]] = True
    return linked


def spanning_links(linked: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs that connect what ``linked`` connects, fewer than rows and columns together."""
    found: list[tuple[int, int]] = []
    row_free, column_free = linked.any(1), linked.any(0)
    while True:
        open_ = np.flatnonzero(row_free)
        if not len(open_):
            return found
        queue = [int(open_[0])]
        row_free[queue[0]] = False
        while queue:
            row = queue.pop()
            columns = np.flatnonzero(linked[row] & column_free)
            column_free[columns] = False
            found += [(row, int(column)) for column in columns]
            for column in columns.tolist():
                rows = np.flatnonzero(linked[:, column] & row_free)
                row_free[rows] = False
                found += [(int(new), column) for new in rows]
                queue += rows.tolist()


def _tiled(vectors: DataFrame, axes: Axes) -> DataFrame:
    """Different vectors in tiles: ``number, tile, label, size, vector, weight``, a table."""

    def order(batches):
        for batch in batches:
            names = batch.schema.names
            sizes, raws = batch.column(names.index("size")).to_pylist(), batch.column(names.index("vector")).to_pylist()
            cells = []
            for size, raw in zip(sizes, raws, strict=True):
                lead = np.frombuffer(raw, np.float64) @ axes[size][:, :_ORDER_AXES]
                # Linked vectors are at most sqrt(2 - 2 cosine) apart: a cell is as wide.
                cells.append(np.floor(lead / np.sqrt(2 - 2 * COSINE)).astype(int).tolist())
            yield pa.record_batch([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], [*names, "cell"])

    different = vectors.filter(F.col("vector").isNotNull()).groupBy("label", "size", "vector").agg(
        F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least")
    )
    schema = "label string, size int, vector binary, weight long, least long, cell array<int>"
    ordered = numbered(different.mapInArrow(order, schema), ["label", "size", "cell", "vector"], "number")
    tile = F.floor(F.col("number") / TILE).cast("long")
    # A tile holds one label: its parts are tiles of their own.
    return ordered.select("number", tile.alias("tile"), "label", "size", "vector", "weight", "least")


def _tiles(tiled: DataFrame, axes: Axes) -> DataFrame:
    """One row per tile and label with its vectors, and the box around them; a table."""

    def gather(table: pa.Table) -> pa.Table:
        numbers = np.array(table.column("number").to_pylist(), np.int64)
        order = np.argsort(numbers)
        raws = table.column("vector").to_pylist()
        size = table.column("size")[0].as_py()
        rows = np.frombuffer(b"".join(raws), np.float64).reshape(-1, size)[order]
        lead = rows @ axes[size][:, :_BOX_AXES]
        weights = np.array(table.column("weight").to_pylist(), np.int64)[order]
        return pa.table(
            {
                "tile": table.column("tile")[:1],
                "label": table.column("label")[:1],
                "size": table.column("size")[:1],
                "numbers": pa.array([numbers[order].tobytes()], pa.binary()),
                "weights": pa.array([weights.tobytes()], pa.binary()),
                "vectors": pa.array([rows.tobytes()], pa.binary()),
                "low": pa.array([lead.min(0).tolist()], pa.list_(pa.float64())),
                "high": pa.array([lead.max(0).tolist()], pa.list_(pa.float64())),
            }
        )

    schema = (
        "tile long, label string, size int, numbers binary, weights binary, vectors binary, "
        "low array<double>, high array<double>"
    )
    grouped = tiled.select("tile", "label", "size", "number", "weight", "vector").groupBy("tile", "label", "size")
    return written(grouped.applyInArrow(gather, schema), "tiles")


def near_vectors(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    arrow_bounded(embeddings.sparkSession)
    vectors = _vectors(embeddings)
    axes = principal_axes(vectors)
    tiled = written(_tiled(vectors, axes), "tiled")
    tiles = _tiles(tiled, axes)

    # Boxes are small: pairs of them are made without the vectors, label by label.
    one = tiles.select("label", "size", F.col("tile").alias("tile_a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"))
    two = tiles.select("label", "size", F.col("tile").alias("tile_b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    gaps = F.transform(
        F.sequence(F.lit(0), F.size("low_a") - 1),
        lambda i: F.greatest(
            F.get("low_a", i) - F.get("high_b", i), F.get("low_b", i) - F.get("high_a", i), F.lit(0.0)
        ),
    )
    apart = F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap * gap)
    pairs = written(
        one.join(two, ["label", "size"])
        .filter((F.col("tile_a") <= F.col("tile_b")) & (apart <= 2 - 2 * cosine + _MARGIN))
        .select("label", "size", "tile_a", "tile_b"),
        "tile_pairs",
    )

    def side(name: str) -> DataFrame:
        return tiles.select(
            "label", "size", F.col("tile").alias(f"tile_{name}"), F.col("numbers").alias(f"numbers_{name}"),
            F.col("weights").alias(f"weights_{name}"), F.col("vectors").alias(f"vectors_{name}"),
        )

    both = (
        pairs.join(side("a"), ["label", "size", "tile_a"])
        .join(side("b"), ["label", "size", "tile_b"])
        .select("size", F.expr("tile_a = tile_b").alias("same"), *[f"{x}_{s}" for x in ("numbers", "weights", "vectors") for s in "ab"])
        .repartition(F.xxhash64("numbers_a", "numbers_b"))
    )

    def link(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                size, same, *blobs = [column[row].as_py() for column in batch.columns]
                na, nb, wa, wb = (np.frombuffer(blob, np.int64) for blob in blobs[:4])
                a, b = (np.frombuffer(blob, np.float64).reshape(-1, size) for blob in blobs[4:])
                linked = compare_tiles(a, b, axes[size], cosine)
                if same:
                    np.fill_diagonal(linked, False)
                left, right = linked @ wb.astype(np.float64), wa.astype(np.float64) @ linked
                edges = spanning_links(linked)
                counted = [(na, left)] if same else [(na, left), (nb, right)]
                for numbers, links in counted:
                    some = links > 0
                    n = int(some.sum())
                    yield pa.record_batch(
                        [
                            pa.array(numbers[some]),
                            pa.array(links[some].astype(np.int64)),
                            pa.nulls(n, pa.int64()),
                        ],
                        ["node", "links", "other"],
                    )
                if edges:
                    yield pa.record_batch(
                        [
                            pa.array([int(na[i]) for i, _ in edges], pa.int64()),
                            pa.nulls(len(edges), pa.int64()),
                            pa.array([int(nb[j]) for _, j in edges], pa.int64()),
                        ],
                        ["node", "links", "other"],
                    )

    found = written(both.mapInArrow(link, "node long, links long, other long"), "links_found")
    counts = found.filter(F.col("links").isNotNull()).groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.filter(F.col("other").isNotNull()).select(F.col("node").alias("left"), F.col("other").alias("right"))
    groups = components(edges)
    nodes = (
        tiled.select(F.col("number").alias("node"), "label", "size", "vector", "weight", "least")
        .join(counts, "node", "left")
        .join(groups, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    smallest = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(smallest, "component").select(
        "label", "size", "vector", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    )
    nodes = nodes.select(*[F.col(name).alias(f"own_{name}") for name in nodes.columns])
    same = (
        (F.col("label") == F.col("own_label"))
        & (F.col("size") == F.col("own_size"))
        & (F.col("vector") == F.col("own_vector"))
    )
    component = F.when(F.col("own_vector").isNull(), F.col("vec_id")).otherwise(F.col("own_component_id"))
    return vectors.join(nodes, same, "left").select(
        "vec_id",
        F.coalesce("own_n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
