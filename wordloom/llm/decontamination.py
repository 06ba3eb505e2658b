"""Benchmark decontamination with suffix arrays of the training texts.

Each batch of training texts is a shard with a suffix array over its words.  Every suffix of every benchmark
item is looked up by binary search; where the longest match is at least a window (``WINDOW`` words, or the
whole item if it is shorter), all places of the window are read off the array.  Suffixes that begin outside a
run of benchmark words cannot match a window and are left out of the array.

The benchmark goes to the tasks in blocks of at most ``BLOCK_BYTES`` bytes of text; each block is one search.
Null and empty texts have no words, and nothing in them matches; a null or empty item has no window.  Items
without an id mark words but are not listed; items that share an id count as one.  Repeated documents are
searched like any other.
"""

from __future__ import annotations

import dataclasses
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import arrow_bounded, words_of
from wordloom.session import written

WINDOW = 10
BLOCK_BYTES = 8 << 20

_MATCH = pa.struct(
    [("item_id", pa.string()), ("item_word", pa.int64()), ("start", pa.int64()), ("words", pa.int64())]
)
_SCAN = pa.struct(
    [
        ("n_words", pa.int64()),
        ("starts", pa.list_(pa.int64())),
        ("ends", pa.list_(pa.int64())),
        ("items", pa.list_(pa.string())),
        ("matches", pa.list_(_MATCH)),
    ]
)
_MATCHES_TYPE = "array<struct<item_id: string, item_word: long, start: long, words: long>>"
_SCAN_TYPE = (
    "n_words long, starts array<long>, ends array<long>, items array<string>, "
    f"matches {_MATCHES_TYPE}"
)
_FOUND_TYPE = (
    "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    f"matches {_MATCHES_TYPE}"
)


@dataclasses.dataclass(frozen=True)
class Suffixes:
    """A block of benchmark items: words as numbers from 1, 0 after every item, and the suffixes to look up."""

    vocabulary: dict[bytes, int]
    tokens: np.ndarray
    starts: np.ndarray
    windows: np.ndarray
    item_of: list[str | None]
    items: np.ndarray
    item_starts: np.ndarray
    shortest: int
    longest: int


def benchmark_suffixes(items: list[tuple[str | None, bytes | None]], window: int = WINDOW) -> Suffixes:
    vocabulary: dict[bytes, int] = {}
    tokens: list[int] = []
    starts, windows, numbers, names, item_starts, sizes = [], [], [], [], [], []
    for name, text in items:
        words = words_of(text)
        if not words:
            continue
        need = min(window, len(words))
        for offset in range(len(words) - need + 1):
            starts.append(len(tokens) + offset)
            windows.append(need)
            numbers.append(len(names))
        item_starts.append(len(tokens))
        names.append(name)
        sizes.append(len(words))
        tokens += [vocabulary.setdefault(word, len(vocabulary) + 1) for word in words]
        tokens.append(0)
    return Suffixes(
        vocabulary,
        np.array(tokens, np.int64),
        np.array(starts, np.int64),
        np.array(windows, np.int64),
        names,
        np.array(numbers, np.int64),
        np.array(item_starts, np.int64),
        min((min(window, size) for size in sizes), default=1),
        max(sizes, default=0),
    )


def in_long_runs(tokens: np.ndarray, shortest: int) -> np.ndarray:
    """Places inside runs of at least ``shortest`` known words."""
    known = np.concatenate(([False], tokens > 0, [False]))
    edges = np.flatnonzero(known[1:] != known[:-1])
    begins, ends = edges[::2], edges[1::2]
    long = ends - begins >= shortest
    inside = np.zeros(len(tokens) + 1, np.int64)
    inside[begins[long]] += 1
    inside[ends[long]] -= 1
    return np.flatnonzero(np.cumsum(inside[:-1]) > 0)


def suffix_array(tokens: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in the order of the words that follow, by prefix doubling up to ``depth`` words."""
    rank = np.zeros(len(tokens) + 1, np.int64)
    # Ranks are dense from the start, as a benchmark may have more different words than the shard has tokens.
    rank[places] = np.unique(tokens[places], return_inverse=True)[1] + 1
    width = 1
    while True:
        following = rank[np.minimum(places + width, len(tokens))]
        keys = rank[places] * np.int64(len(tokens) + len(places) + 2) + following
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        fresh = np.concatenate(([1], (ordered[1:] != ordered[:-1]).astype(np.int64)))
        numbers = np.cumsum(fresh)
        rank[places[order]] = numbers
        width *= 2
        if width >= depth or numbers[-1] == len(places):
            return places[order]


def _compare(tokens, at, test, start, limit) -> tuple[np.ndarray, np.ndarray]:
    """Sign of (words at ``at``) - (words of the test suffix), and the words they share; ``limit`` words count."""
    size = len(at)
    sign, shared = np.zeros(size, np.int64), np.zeros(size, np.int64)
    active = np.arange(size)
    step = 0
    while len(active):
        active = active[limit[active] > step]
        own = tokens[np.minimum(at[active] + step, len(tokens) - 1)]
        own = np.where(at[active] + step < len(tokens), own, 0)
        asked = test[start[active] + step]
        same = (own == asked) & (asked > 0)
        shared[active[same]] = step + 1
        other = ~same
        sign[active[other]] = np.sign(own[other] - asked[other])
        active = active[same]
        step += 1
    return sign, shared


def _bound(tokens, array, test, start, limit, after: bool) -> np.ndarray:
    """First place in the suffix array that is not below (``after``: that is above) the test suffix."""
    low, high = np.zeros(len(start), np.int64), np.full(len(start), len(array), np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        sign, _ = _compare(tokens, array[middle], test, start[open_], limit[open_])
        right = sign <= 0 if after else sign < 0
        low[open_[right]] = middle[right] + 1
        high[open_[~right]] = middle[~right]


def search_shard(tokens: np.ndarray, suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Places of the shard where a window stands, and the number of the benchmark suffix each time."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if not len(suffixes.starts):
        return none
    places = in_long_runs(tokens, suffixes.shortest)
    if not len(places):
        return none
    array = suffix_array(tokens, places, suffixes.longest)
    rest = np.full(len(suffixes.starts), suffixes.longest, np.int64)
    at = _bound(tokens, array, suffixes.tokens, suffixes.starts, rest, after=False)
    longest = np.zeros(len(at), np.int64)
    for neighbour in (at - 1, at):
        valid = np.flatnonzero((neighbour >= 0) & (neighbour < len(array)))
        _, shared = _compare(
            tokens, array[neighbour[valid]], suffixes.tokens, suffixes.starts[valid], rest[valid]
        )
        longest[valid] = np.maximum(longest[valid], shared)
    hit = np.flatnonzero(longest >= suffixes.windows)
    if not len(hit):
        return none
    start, need = suffixes.starts[hit], suffixes.windows[hit]
    low = _bound(tokens, array, suffixes.tokens, start, need, after=False)
    high = _bound(tokens, array, suffixes.tokens, start, need, after=True)
    count = high - low
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return array[np.repeat(low, count) + within], np.repeat(hit, count)


def _matches_of(places: np.ndarray, numbers: np.ndarray, begin: int, suffixes: Suffixes) -> list[dict]:
    """The longest match of each item with one document: windows that follow each other are one match."""
    item = suffixes.items[numbers]
    word = suffixes.starts[numbers] - suffixes.item_starts[item]
    order = np.lexsort((places, places - word, item))
    item, word, places, need = item[order], word[order], places[order], suffixes.windows[numbers[order]]
    breaks = np.flatnonzero(
        np.concatenate(([True], (item[1:] != item[:-1]) | (places[1:] != places[:-1] + 1) | (word[1:] != word[:-1] + 1)))
    )
    ends = np.concatenate((breaks[1:], [len(item)]))
    best: dict[int, tuple] = {}
    for i, j in zip(breaks.tolist(), ends.tolist(), strict=True):
        found = (int(j - i - 1 + need[i]), -int(places[i]), int(word[i]))
        key = int(item[i])
        if key not in best or found > best[key]:
            best[key] = found
    return [
        {"item_id": suffixes.item_of[key], "item_word": word, "start": -place - begin, "words": words}
        for key, (words, place, word) in sorted(best.items())
    ]


def _scanned(text: Column, suffixes: Suffixes) -> Column:
    def scan(texts: pa.Array) -> pa.Array:
        tokens: list[int] = []
        begins, sizes = [], []
        get = suffixes.vocabulary.get
        for text in texts:
            words = words_of(text.as_py())
            begins.append(len(tokens))
            sizes.append(len(words))
            tokens += [get(word, 0) for word in words]
            tokens.append(0)
        shard = np.array(tokens, np.int64)
        places, numbers = search_shard(shard, suffixes)
        rows = [{"n_words": n, "starts": [], "ends": [], "items": [], "matches": []} for n in sizes]
        order = np.argsort(places, kind="stable")
        places, numbers = places[order], numbers[order]
        rows_hit = np.searchsorted(np.array(begins), places, side="right") - 1
        cuts = np.flatnonzero(np.concatenate(([True], rows_hit[1:] != rows_hit[:-1]))) if len(rows_hit) else []
        for i, j in zip(cuts, [*cuts[1:], len(rows_hit)], strict=False):
            number = int(rows_hit[i])
            own, tests = places[i:j], numbers[i:j]
            row, begin = rows[number], begins[number]
            ends = own + suffixes.windows[tests]
            # Overlapping windows are one span.
            reach = np.maximum.accumulate(ends)
            split = np.flatnonzero(np.concatenate(([True], own[1:] > reach[:-1])))
            row["starts"] = (own[split] - begin).tolist()
            row["ends"] = (reach[np.concatenate((split[1:], [len(own)])) - 1] - begin).tolist()
            names = {suffixes.item_of[item] for item in np.unique(suffixes.items[tests]).tolist()}
            row["items"] = sorted(name for name in names if name is not None)
            row["matches"] = _matches_of(own, tests, begin, suffixes)
        return pa.array(rows, _SCAN)

    return F.arrow_udf(scan, _SCAN_TYPE)(text)


def _combine(*scans: pa.Array) -> pa.Array:
    """The results of all blocks for each document."""
    rows = []
    nothing = hashlib.sha256(b"").hexdigest()
    for parts in zip(*[scan.to_pylist() for scan in scans], strict=True):
        row = {"n_words": parts[0]["n_words"], "n_hit": 0, "n_items": 0, "items_sha256": nothing, "contaminated": False, "matches": []}
        spans = sorted(span for part in parts for span in zip(part["starts"], part["ends"], strict=True))
        if spans:
            reach = 0
            for start, end in spans:
                row["n_hit"] += max(0, end - max(start, reach))
                reach = max(reach, end)
            items = sorted({item for part in parts for item in part["items"]})
            row["n_items"] = len(items)
            row["items_sha256"] = hashlib.sha256(",".join(items).encode()).hexdigest()
            row["contaminated"] = True
            row["matches"] = [match for part in parts for match in part["matches"]]
        rows.append(row)
    kinds = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("matches", pa.list_(_MATCH))]
    return pa.array(rows, pa.struct(kinds))


def benchmark_blocks(
    benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> list[Suffixes]:
    """Items (``item_id``, ``text``) in blocks of about ``block_bytes``, so that a task holds a bounded part.

    Repeated rows are one item, so that none makes a block of its own.
    """
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")
    )
    items = written(items.filter(F.length("text") > 0).distinct(), "items")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return [
        benchmark_suffixes(
            sorted(
                ((row.item_id, bytes(row.text)) for row in items.filter(part == block).collect()),
                key=lambda item: (item[0] is None, item[0] or "", item[1]),
            ),
            window,
        )
        for block in range(blocks)
    ]


def contamination(text: Column | str, blocks: list[Suffixes]) -> Column:
    """What a text shares with the benchmark: ``n_words, n_hit, n_items, items_sha256, contaminated, matches``.

    ``matches`` has the longest verbatim match with each item: the item's word and the text's word where it
    begins, and its length in words.
    """
    text = F.col(text) if isinstance(text, str) else text
    scans = [_scanned(text.cast("binary"), block) for block in blocks]
    return F.arrow_udf(_combine, _FOUND_TYPE)(*scans)


def scan_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id`` and the fields of ``contamination`` for every document."""
    arrow_bounded(documents.sparkSession)
    found = contamination("text", benchmark_blocks(benchmark, window))
    return documents.select("doc_id", found.alias("found")).select("doc_id", "found.*")


def without_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents that hold no window of the benchmark, with all their columns."""
    arrow_bounded(documents.sparkSession)
    found = contamination("text", benchmark_blocks(benchmark, window))
    return documents.filter(~found["contaminated"])
