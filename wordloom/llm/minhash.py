"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set: its shingles of five words, each with how often it occurs times an inverse document
frequency.  Frequencies are counted over all documents in ``2**FEATURE_BITS`` buckets of shingle hashes, so
that the table has the same size for any corpus; a bucket's rare shingles share a floor in proportion to the
corpus, and what many documents share stands out.  Consistent samples (the same for two texts with a
probability that is their weighted Jaccard similarity) are banded.  Texts that share a band are compared
exactly, and linked at ``SIMILARITY`` or more.

Texts that are equal are one node from the start.  In a band's bucket everything is compared with the most
central text first.  What that does not connect is compared with all others of the bucket, in blocks: a
sketch of each text (its weight in ``GROUPS`` groups of shingles) bounds the similarity of two texts from
above, and only pairs that can reach the threshold and that nothing connects yet are compared exactly, the
likeliest first.  So copies never make all pairs, and no link between two texts that share a bucket is lost.

Texts without words (null, empty, signs only) are near to nothing; shorter texts than a shingle are one
shingle.  The class of a document is the smallest ``doc_id`` of its group, null if all are null; of several
rows with the same id and text one stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import arrow_bounded, components, more_components
from wordloom.session import written

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 10
ROWS = 3
FEATURE_BITS = 18
# A slice of the frequency table is one row.
_SLICES = 16
# Texts of about so many bytes are hashed at once.
_CHUNK = 1 << 20
GROUPS = 64
# Texts of a block, and of a bucket that is not cut into blocks.
BLOCK = 2048
SMALL = 64
# Pairs tried first for a text and each component near it; then all that are left.
TRIES = 3

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, size: int) -> np.ndarray:
    powers = np.full(size, base, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and where each text's words begin (one entry more than texts)."""
    sizes = np.array([len(text) for text in texts], np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    word = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    first = np.zeros(len(data) + 1, bool)
    first[begins] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    # A word's bytes are digits of a number to a 64-bit base; its place in the text is divided out.
    sums = np.concatenate(
        (np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data))))
    )
    hashes = (sums[ends + 1] - sums[starts]) * _powers(_INVERSE, len(data))[starts]
    return _mix(hashes), np.searchsorted(starts, begins)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of some texts in order of text and hash: number of the text, hash, how often."""
    words, begins = word_hashes(texts)
    counts = np.diff(begins)
    owner = np.repeat(np.arange(len(texts)), counts)
    left = begins[1:][owner] - np.arange(len(words))
    made = np.zeros(len(words), np.uint64)
    for step in range(SHINGLE):
        # The words of a text shorter than a shingle make one together.
        has = left > step
        shifted = np.zeros(len(words), np.uint64)
        shifted[: max(len(words) - step, 0)] = words[step:]
        made = np.where(has, _mix(made + shifted + np.uint64(step + 1)), made)
    whole = (left >= SHINGLE) | ((counts[owner] < SHINGLE) & (left == counts[owner]))
    owner, made = owner[whole], made[whole]
    order = np.lexsort((made, owner))
    owner, made = owner[order], made[order]
    if not len(made):
        return owner, made, np.empty(0, np.int64)
    fresh = np.flatnonzero(
        np.concatenate(([True], (made[1:] != made[:-1]) | (owner[1:] != owner[:-1])))
    )
    often = np.diff(np.concatenate((fresh, [len(made)])))
    return owner[fresh], made[fresh], often


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def _chunks(texts: list[bytes | None]):
    """Ranges of texts with about ``_CHUNK`` bytes."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or b"")
        if size >= _CHUNK:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def inverse_frequencies(documents: DataFrame) -> np.ndarray:
    """``log(1 + documents / document frequency)`` of every bucket of shingle hashes."""
    arrow_bounded(documents.sparkSession)

    def count(batches):
        total = np.zeros(1 << FEATURE_BITS, np.int64)
        rows = 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            rows += len(texts)
            for begin, end in _chunks(texts):
                _, hashes, _ = shingles([text or b"" for text in texts[begin:end]])
                total += np.bincount(_buckets(hashes), minlength=len(total))
        parts = np.split(total, _SLICES)
        yield pa.record_batch(
            [
                pa.array(range(_SLICES), pa.int32()),
                pa.array([part.astype(np.uint32 if part.max() < 2**32 else np.int64).tobytes() for part in parts], pa.binary()),
                pa.array([rows] + [0] * (_SLICES - 1), pa.int64()),
            ],
            ["slice", "counts", "rows"],
        )

    def add(batches):
        # A task sums the slices it is dealt; the sums meet on the driver, one table per task.
        sums: dict[int, np.ndarray] = {}
        rows = 0
        width = (1 << FEATURE_BITS) // _SLICES
        for batch in batches:
            for number, counts, own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                part = np.frombuffer(counts, np.uint32 if len(counts) == 4 * width else np.int64)
                sums[number] = sums.get(number, 0) + part.astype(np.int64)
                rows += own
        names = list(sums)
        yield pa.record_batch(
            [
                pa.array(names, pa.int32()),
                pa.array([sums[n].tobytes() for n in names], pa.binary()),
                pa.array([rows] + [0] * (len(names) - 1) if names else [], pa.int64()),
            ],
            ["slice", "counts", "rows"],
        )

    schema = "slice int, counts binary, rows long"
    summed = (
        documents.select(F.col("text").cast("binary").alias("text"))
        .mapInArrow(count, schema)
        .repartition(_SLICES, "slice")
        .mapInArrow(add, schema)
        .collect()
    )
    total = np.zeros(1 << FEATURE_BITS)
    width = len(total) // _SLICES
    for row in summed:
        total[row.slice * width : (row.slice + 1) * width] += np.frombuffer(row.counts, np.int64)
    rows = sum(row.rows for row in summed)
    return np.log1p(max(rows, 1) / np.maximum(total, 1)).astype(np.float32)


def samples(owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray, texts: int, size: int) -> np.ndarray:
    """``size`` consistent samples of each text, as hashes; a column of zeros for a text without shingles."""
    found = np.zeros((size, texts), np.uint64)
    if not len(owner):
        return found
    begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    counts = np.diff(np.concatenate((begins, [len(owner)])))
    which = owner[begins]
    logs = np.log(weights.astype(np.float32))
    low = np.uint64(0xFFFFFF)
    unit = np.float32(2.0**-24)
    for k in range(size):
        one = _mix(hashes ^ np.uint64((k + 1) * 0x632BE59BD9B4E019 % (1 << 64)))
        two = _mix(one + _BASE)
        u1, u2 = one >> np.uint64(40), (one >> np.uint64(16)) & low
        u3, u4 = two >> np.uint64(40), (two >> np.uint64(16)) & low
        rate = -(np.log((u1.astype(np.float32) + np.float32(0.5)) * unit) + np.log((u2.astype(np.float32) + np.float32(0.5)) * unit))
        cost = -(np.log((u3.astype(np.float32) + np.float32(0.5)) * unit) + np.log((u4.astype(np.float32) + np.float32(0.5)) * unit))
        shift = ((one & np.uint64(0xFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-16)
        level = np.floor(logs / rate + shift)
        value = np.log(cost) - rate * (level - shift) - rate
        least = np.minimum.reduceat(value, begins)
        at = np.flatnonzero(value == np.repeat(least, counts))
        # The first of equal values: shingles stand in hash order.
        at = at[np.concatenate(([True], owner[at[1:]] != owner[at[:-1]]))]
        found[k, which] = _mix(hashes[at] + level[at].astype(np.int64).astype(np.uint64) * _BASE + np.uint64(k))
    return found


def signed(texts: list[bytes | None], idf: np.ndarray) -> tuple[list[list[int]], list[bytes]]:
    """Band keys and sketch of each text; no keys for a text without words."""
    keys: list[list[int]] = []
    drawn: list[bytes] = []
    for begin, end in _chunks(texts):
        owner, hashes, often = shingles([text or b"" for text in texts[begin:end]])
        weights = often * idf[_buckets(hashes)]
        found = samples(owner, hashes, weights, end - begin, BANDS * ROWS)
        bands = np.zeros((BANDS, end - begin), np.uint64)
        for row in range(ROWS):
            bands = _mix(bands + found[row::ROWS] + np.uint64(row + 1))
        bands = _mix(bands + np.arange(BANDS, dtype=np.uint64)[:, None]).view(np.int64)
        filled = np.bincount(owner, minlength=end - begin) > 0
        keys += [own if has else [] for own, has in zip(bands.T.tolist(), filled.tolist(), strict=True)]
        drawn += [own.tobytes() for own in sketches(owner, hashes, weights, end - begin)]
    return keys, drawn


def weighted_jaccard(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller weights over sum of the greater, of sorted hashes with their weights."""
    _, left, right = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    shared = np.minimum(one[1][left], two[1][right]).sum()
    both = one[1].sum() + two[1].sum() - shared
    return float(shared / both) if both > 0 else 0.0


def _weighted(text: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, hashes, often = shingles([text])
    return hashes, (often * idf[_buckets(hashes)]).astype(np.float64)


def sketches(owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray, texts: int) -> np.ndarray:
    """The weight of each text's shingles in each group of hashes."""
    group = (_mix(hashes + np.uint64(77)) % np.uint64(GROUPS)).astype(np.int64)
    summed = np.bincount(owner * GROUPS + group, weights, minlength=texts * GROUPS)
    return summed.reshape(texts, GROUPS).astype(np.float32)


def similarity_bounds(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """No two texts of these sketches are more similar than this."""
    shared = np.zeros((len(one), len(two)), np.float32)
    for group in range(GROUPS):
        shared += np.minimum(one[:, group, None], two[None, :, group])
    both = one.sum(1)[:, None] + two.sum(1)[None, :] - shared
    return shared / np.maximum(both, 1e-12)


# Sketches are rounded to 32 bits.
_ROUNDING = 1e-4


def _reachable(least: float) -> Column:
    def bound(ones: pa.Array, twos: pa.Array) -> pa.Array:
        one, two = (
            np.frombuffer(b"".join(side.to_pylist()), np.float32).reshape(-1, GROUPS) for side in (ones, twos)
        )
        shared = np.minimum(one, two).sum(1)
        both = np.maximum(one.sum(1) + two.sum(1) - shared, 1e-12)
        return pa.array(shared / both >= least - _ROUNDING)

    return F.arrow_udf(bound, "boolean")("pivot_sketch", "sketch")


def _similar(idf: np.ndarray, least: float) -> Column:
    def compare(ones: pa.Array, twos: pa.Array) -> pa.Array:
        found = []
        last, known = None, None
        for one, two in zip(ones, twos, strict=True):
            one, two = one.as_py(), two.as_py()
            if one != last:
                last, known = one, _weighted(one, idf)
            found.append(weighted_jaccard(known, _weighted(two, idf)) >= least - 1e-9)
        return pa.array(found, pa.bool_())

    return F.arrow_udf(compare, "boolean")("pivot_text", "text")


def _node() -> Column:
    """A text's node: its md5, 16 bytes."""
    return F.unhex(F.md5(F.col("text").cast("binary")))


def signatures(documents: DataFrame, idf: np.ndarray) -> DataFrame:
    """``doc_id, node, bands, sketch`` of every document, as a table."""

    def sign(texts: pa.Array) -> pa.Array:
        keys, drawn = signed(texts.to_pylist(), idf)
        return pa.StructArray.from_arrays(
            [pa.array(keys, pa.list_(pa.int64())), pa.array(drawn, pa.binary())], ["bands", "sketch"]
        )

    found = F.arrow_udf(sign, "bands array<long>, sketch binary")(F.col("text").cast("binary"))
    rows = documents.select("doc_id", _node().alias("node"), found.alias("found"))
    return written(rows.select("doc_id", "node", "found.bands", "found.sketch"), "signatures")


def _texts_of(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """The text of every node (``node``, ``rep``), as a table: that of one of its documents."""
    own = documents.select("doc_id", F.col("text").cast("binary").alias("text"), _node().alias("own"))
    texts = own.join(nodes, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("own") == F.col("node")))
    return written(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")


def _linked(pairs: DataFrame, texts: DataFrame, drawn: DataFrame | None, idf: np.ndarray, least: float) -> DataFrame:
    """Those of ``pairs`` (``pivot``, ``node``) that are similar, as a table; hopeless ones go by their sketches."""
    if drawn is not None:
        of_pivot = drawn.select(F.col("node").alias("pivot"), F.col("sketch").alias("pivot_sketch"))
        pairs = pairs.join(drawn, "node").join(of_pivot, "pivot").filter(_reachable(least)).select("pivot", "node")
    pivots = texts.select(F.col("node").alias("pivot"), F.col("text").alias("pivot_text"))
    similar = pairs.join(texts, "node").join(pivots, "pivot").filter(_similar(idf, least))
    return written(similar.select(F.col("pivot").alias("left"), F.col("node").alias("right")), "similar")


def _unordered(pairs: DataFrame) -> DataFrame:
    """Different pairs ``pivot, node``, each in one order."""
    return pairs.select(
        F.least("pivot", "node").alias("pivot"), F.greatest("pivot", "node").alias("node")
    ).distinct()


def _grouped(rows: DataFrame, groups: DataFrame, node: str, component: str) -> DataFrame:
    """Rows with the component of ``node``, which is the node itself if nothing is linked with it."""
    own = groups.select(F.col("node").alias(node), F.col("component").alias(component))
    return rows.join(own, node, "left").withColumn(component, F.coalesce(component, node))


def _block_pairs(bucket: DataFrame, least: float, tries: int | None) -> DataFrame:
    """``pivot, node`` from big buckets: each open text with texts of other components it can be similar to.

    ``bucket`` has ``key, node, size, component, sketch, bands, open``.
    A pair is made in the first of the bands that it shares, and by one of its texts if both are open.
    At most ``tries`` texts of a component and block, the likeliest first, or all.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    left = bucket.filter("open")
    ones = left.select("key", "node", "component", "sketch", "bands", own.alias("one"), every.alias("two"))
    # Only blocks in which a text is open are met.
    met = left.select("key", own.alias("one")).distinct()
    twos = bucket.select("key", "node", "component", "sketch", "bands", "open", own.alias("two")).join(met, "key")
    # Both come from the same tables: their columns need names of their own.
    twos = twos.select(*[F.col(name).alias(f"its_{name}") for name in twos.columns])

    def compare(one: pa.Table, two: pa.Table) -> pa.Table:
        found_one: list[bytes] = []
        found_two: list[bytes] = []
        if one.num_rows and two.num_rows:
            a, b = (
                np.frombuffer(b"".join(raw.to_pylist()), np.float32).reshape(-1, GROUPS)
                for raw in (one.column("sketch"), two.column("its_sketch"))
            )
            nodes, others = one.column("node").to_pylist(), two.column("its_node").to_pylist()
            components_ = one.column("component").to_pylist(), two.column("its_component").to_pylist()
            names = {name: i for i, name in enumerate({*components_[0], *components_[1]})}
            group_a, group_b = (np.array([names[name] for name in side]) for side in components_)
            bands_a, bands_b = (
                np.array(side.to_pylist()) for side in (one.column("bands"), two.column("its_bands"))
            )
            key = one.column("key")[0].as_py()
            both_open = np.array(two.column("its_open").to_pylist())
            order_of = {name: i for i, name in enumerate(sorted({*nodes, *others}))}
            place_a, place_b = (np.array([order_of[name] for name in side]) for side in (nodes, others))
            for begin in range(0, len(a), 256):
                bounds = similarity_bounds(a[begin : begin + 256], b)
                open_ = (bounds >= least - _ROUNDING) & (group_a[begin : begin + 256, None] != group_b)
                open_ &= ~both_open | (place_a[begin : begin + 256, None] < place_b)
                rows, columns = np.nonzero(open_)
                same = bands_a[begin + rows] == bands_b[columns]
                first = bands_a[begin + rows, same.argmax(1)] == key
                rows, columns = rows[first], columns[first]
                if tries is not None:
                    order = np.lexsort((-bounds[rows, columns], group_b[columns], rows))
                    rows, columns = rows[order], columns[order]
                    fresh = np.concatenate(
                        ([True], (rows[1:] != rows[:-1]) | (group_b[columns[1:]] != group_b[columns[:-1]]))
                    ) if len(rows) else np.empty(0, bool)
                    place = np.arange(len(rows)) - np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))
                    rows, columns = rows[place < tries], columns[place < tries]
                found_one += [nodes[begin + row] for row in rows.tolist()]
                found_two += [others[column] for column in columns.tolist()]
        return pa.table({"pivot": pa.array(found_one, pa.binary()), "node": pa.array(found_two, pa.binary())})

    return (
        ones.groupBy("key", "one", "two")
        .cogroup(twos.groupBy("its_key", "its_one", "its_two"))
        .applyInArrow(compare, "pivot binary, node binary")
    )


def near_duplicates(documents: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``doc_id, node, class_id, kept`` of every document."""
    spark = documents.sparkSession
    arrow_bounded(spark)
    documents = documents.select("doc_id", "text")
    idf = inverse_frequencies(documents)
    found = signatures(documents, idf)
    nodes = written(
        found.filter(F.size("bands") > 0)
        .groupBy("node")
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "nodes",
    )
    rows = nodes.select("node", F.explode("bands").alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    # A node's buckets are no more than the bands, so they meet in its row: how many texts stand in them is central.
    held = rows.join(sizes, "key").groupBy("node").agg(
        F.collect_list(F.struct("key", "size")).alias("held"), F.sum("size").alias("central")
    )
    bucket = written(held.select("node", "central", F.inline("held")).select("key", "node", "size", "central"), "buckets")
    drawn = nodes.select("node", "sketch")
    texts = _texts_of(
        nodes.select("node", "rep").join(bucket.select("node").distinct(), "node", "left_semi"), documents
    )

    # The text that stands in the biggest buckets is the most central of each.
    best = bucket.groupBy("key").agg(F.max(F.struct("central", "node")).alias("best"))
    pivots = written(best.select("key", F.col("best.node").alias("pivot")), "pivots")
    bucket = bucket.drop("central")
    pairs = written(_unordered(bucket.join(pivots, "key").filter("pivot != node")), "pairs")
    links = _linked(pairs, texts, drawn, idf, least)
    groups = components(links)

    # What a bucket's pivot is not connected with is left to compare with all of the bucket.
    grouped = written(_grouped(bucket, groups, "node", "component"), "grouped")
    of_pivot = _grouped(pivots, groups, "pivot", "pivot_component").select("key", "pivot_component")
    left = written(
        grouped.join(of_pivot, "key").filter("component != pivot_component").drop("pivot_component", "component"),
        "left",
    )
    few = left.filter(F.col("size") <= SMALL).select("key", F.col("node").alias("pivot"))
    others = _grouped(few, groups, "pivot", "pivot_component").join(grouped, "key")
    tried = pairs
    pairs = _unordered(others.filter("component != pivot_component"))
    left = left.filter(F.col("size") > SMALL)
    big = not left.isEmpty()
    members = bucket.join(left.select("key").distinct(), "key", "left_semi").join(
        left.select("key", "node", F.lit(True).alias("open")), ["key", "node"], "left"
    )
    members = members.withColumn("open", F.coalesce("open", F.lit(False)))
    if big:
        members = written(members.join(nodes.select("node", "sketch", "bands"), "node"), "members")
    for tries in (TRIES, None):
        if big:
            near = _unordered(_block_pairs(_grouped(members, groups, "node", "component"), least, tries))
            pairs = pairs.unionByName(near).distinct() if tries else near
        pairs = written(pairs.join(tried, ["pivot", "node"], "left_anti"), "pairs")
        more = _linked(pairs, texts, drawn if tries else None, idf, least)
        if not more.isEmpty():
            groups = more_components(groups, more)
        tried = tried.unionByName(pairs)
        if not big:
            break

    of_class = _grouped(nodes.select("node", "rep"), groups, "node", "component")
    kept = of_class.groupBy("component").agg(
        F.min("rep").alias("class_id"),
        F.min(F.struct(F.col("rep").isNull().alias("no_id"), "rep", "node")).alias("kept"),
    )
    of_node = of_class.join(kept, "component").select(
        "node", "rep", "class_id", (F.col("kept.node") == F.col("node")).alias("kept_node")
    )
    alone = F.col("kept_node").isNull()
    return (
        found.select("doc_id", "node")
        .join(of_node, "node", "left")
        .select(
            "doc_id",
            "node",
            F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            (alone | (F.col("kept_node") & F.col("doc_id").eqNullSafe(F.col("rep")))).alias("kept"),
        )
    )


def without_near_duplicates(documents: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One document of each group, with all its columns; texts without words stay."""
    kept = written(near_duplicates(documents, least).filter("kept").groupBy("doc_id", "node").count(), "kept")
    names = documents.columns
    # Columns of documents keep their places, whatever they are called.
    inner = documents.select(F.struct(*[F.col(f"`{name}`") for name in names]).alias("row"))
    keyed = inner.select(
        "row", F.col("row.doc_id").alias("own_id"), F.unhex(F.md5(F.col("row.text").cast("binary"))).alias("own_node")
    )
    stay = keyed.join(
        kept.select("doc_id", "node"),
        F.col("own_id").eqNullSafe(F.col("doc_id")) & F.col("own_node").eqNullSafe(F.col("node")),
        "left_semi",
    )
    if not kept.filter(F.col("count") > 1).isEmpty():
        stay = stay.groupBy("own_id", "own_node").agg(F.first("row").alias("row"))
    return stay.select("row.*")
