"""Scoring texts with a hidden Markov language model.

A text is its words and one end.  Words are counted over all documents, in those that may be learned from and in all.
The model emits symbols: each frequent word is one, the end is one, and all other words of a class (by their last
bytes) share one.  A rare word's probability is that of its class times its own within the class, so that a text's
probability stays exact for any number of words: with every unknown word of a class as one outcome, probabilities
add up to one.  Frequent words are at most ``FREQUENT``, so the tables of the model have a bounded size; counts of
rare words stay a table that the rare words of texts meet in a join.  A word is rare by its number in all
documents, so no key of that join is hot.

Latent states are trained by Baum-Welch: in every round each task sums the expected counts of its texts by the
scaled forward and backward recursions, sums are added up by slices of symbols, and the driver normalises them.  Each of
the ``WARM_ROUNDS`` and ``ROUNDS`` rounds covers every text that may be learned from.  The score of a text is the forward
recursion over the whole of it.

Held out are documents whose crc32 of the id as text, modulo 5, is 1; a null id counts as empty text.  Null and empty
texts are an end alone.  Repeated rows are texts of their own.  Without any text to learn from all words are alike.
"""

from __future__ import annotations

import dataclasses
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import arrow_bounded
from wordloom.session import written

STATES = 8
ROUNDS = 3
WARM_ROUNDS = 12
# Words with a symbol of their own, at most, and classes of the others; with the end these are 2^16 symbols.
FREQUENT = 65_023
CLASSES = 512
CLASS_BYTES = 3
# The base score adds this to every count.
ADDED = 0.5
# Weight of the counts of all states together in those of each state, as a number of tokens.
SHARED = 1_000.0
# Transitions that every state has to begin with.
STEPS = 1.0

# A word cannot hold a space, so this stands for the end.
END = b" "
# Frequencies are told apart by this factor when the bound of frequent words is sought.
_STEPS_PER_DOUBLING = 8
# Words that a task counts before it hands them on, tokens whose recursions run together, bytes of symbols that are put in
# order of length at once, slices of the counts.
_COUNTED = 1 << 20
_TOGETHER = 1 << 19
_SORTED_BYTES = 1 << 24
_SLICES = 32


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words of a text given as UTF-8: A-Z in lower case, cut at white space of ASCII."""
    return text.lower().split() if text else []


def words_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of some texts given as UTF-8, like ``tokens_of``, one after the other: which text each is of, its
    number, and the different words by number."""
    texts = texts.fill_null(b"")
    # The functions for ASCII look at bytes alone.
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.StringArray.from_buffers(len(texts), *texts.buffers()[1:], offset=texts.offset)))
    words = lists.flatten()
    text = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    # White space at the ends of a text leaves an empty piece.
    filled = pc.greater(pc.binary_length(words), 0)
    encoded = words.filter(filled).dictionary_encode()
    return text[filled.to_numpy(zero_copy_only=False)], encoded.indices.to_numpy(), encoded.dictionary.cast(pa.binary())


def held_out(doc_id: Column | str) -> Column:
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 1


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-CLASS_BYTES:]) % CLASSES


def _class(word: str) -> Column:
    # A word shorter than the beginning sought is taken whole.
    tail = F.when(F.octet_length(word) > CLASS_BYTES, F.substring(word, -CLASS_BYTES, CLASS_BYTES)).otherwise(F.col(word))
    return (F.crc32(tail) % CLASSES).cast("int")


# The model


@dataclasses.dataclass(frozen=True)
class Markov:
    """Probabilities of the first state, of the next state, and (a row per symbol) of the symbol in each state."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


@dataclasses.dataclass(frozen=True)
class _Batch:
    """Symbol sequences side by side: step by step, in each step those that are long enough, longest first."""

    symbols: np.ndarray
    begins: np.ndarray
    rank: np.ndarray
    order: np.ndarray

    @classmethod
    def of(cls, sequences: list[np.ndarray]) -> _Batch:
        lengths = np.array([len(own) for own in sequences], np.int64)
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        # How many sequences have a symbol at each step.
        alive = np.cumsum(np.bincount(lengths, minlength=lengths[0] + 1)[::-1])[::-1][1:]
        begins = np.concatenate(([0], np.cumsum(alive)))
        data = np.concatenate([sequences[i] for i in order])
        rank = np.repeat(np.arange(len(lengths)), lengths)
        step = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        place = begins[step] + rank
        symbols, ranks = np.empty(len(data), np.int64), np.empty(len(data), np.int64)
        symbols[place], ranks[place] = data, rank
        return cls(symbols, begins, ranks, order)


def _steps(batch: _Batch, states: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Room for a number for each state and place, and a view of it for each step, with a row per state."""
    room = np.empty(len(batch.symbols) * states)
    begins = batch.begins.tolist()
    views = [
        room[begin * states : end * states].reshape(states, end - begin)
        for begin, end in zip(begins[:-1], begins[1:], strict=True)
    ]
    return room, views


def _forward(model: Markov, batch: _Batch, steps: list[np.ndarray], emitted: np.ndarray) -> np.ndarray:
    """Puts scaled forward probabilities into ``steps``; returns their scales."""
    scale = np.empty(len(emitted))
    move = np.ascontiguousarray(model.move.T)
    before = None
    for begin, now in zip(batch.begins.tolist(), steps, strict=False):
        end = begin + now.shape[1]
        if before is None:
            now[:] = model.start[:, None]
        else:
            np.matmul(move, before[:, : end - begin], out=now)
        now *= emitted[begin:end].T
        now /= np.add.reduce(now, axis=0, out=scale[begin:end])
        before = now
    return scale


def log_likelihoods(model: Markov, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural logarithm of the probability of each sequence."""
    found = np.zeros(len(sequences))
    if sequences:
        batch = _Batch.of(sequences)
        scale = _forward(model, batch, _steps(batch, len(model.start))[1], model.emit[batch.symbols])
        found[batch.order] = np.bincount(batch.rank, np.log(scale), minlength=len(sequences))
    return found


@dataclasses.dataclass
class Counts:
    """Expected counts of first states, of moves and (a row per symbol) of symbols by state; and log likelihood."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    likelihood: float = 0.0

    @classmethod
    def none(cls, states: int, symbols: int) -> Counts:
        return cls(np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)))

    def add(self, model: Markov, sequences: list[np.ndarray]) -> None:
        if not sequences:
            return
        batch = _Batch.of(sequences)
        states = len(model.start)
        room, steps = _steps(batch, states)
        emitted = model.emit[batch.symbols]
        scale = _forward(model, batch, steps, emitted)
        self.likelihood += float(np.log(scale).sum())
        np.reciprocal(scale, out=scale)
        begins = batch.begins.tolist()
        moved = np.zeros_like(self.move)
        # From the last step to the first, forward probabilities become those of each state at each place.
        after = None
        for step in range(len(steps) - 2, -1, -1):
            begin, end = begins[step + 1], begins[step + 2]
            ahead = np.multiply(emitted[begin:end].T, scale[begin:end], order="C")
            if after is not None:
                ahead[:, : after.shape[1]] *= after
            going = steps[step][:, : end - begin]
            moved += going @ ahead.T
            after = model.move @ ahead
            going *= after
        self.start += steps[0].sum(axis=1)
        self.move += moved * model.move
        width = np.diff(batch.begins)
        place = np.arange(len(batch.symbols)) + np.repeat(batch.begins[:-1] * (states - 1), width)
        width = np.repeat(width, width)
        for state in range(states):
            self.emit[:, state] += np.bincount(batch.symbols, room[place], minlength=len(self.emit))
            place += width


def normalised(counts: Counts, shared: np.ndarray) -> Markov:
    """The model of some counts; each state has ``SHARED`` tokens of the frequencies ``shared`` besides."""
    states = len(counts.start)
    start = counts.start + 1.0 / states
    move = counts.move + STEPS / states
    emit = counts.emit + SHARED * shared[:, None]
    return Markov(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def first_model(shared: np.ndarray, states: int) -> Markov:
    """Where training begins: states that stay, each with frequencies that differ a little by symbol."""
    noise = np.random.default_rng(13).random((len(shared), states))
    emit = shared[:, None] * (0.5 + noise)
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Markov(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


# Words


@dataclasses.dataclass(frozen=True)
class Vocabulary:
    """Symbols of frequent words, and what the counts of words come to.

    ``learned`` has the count of every symbol, ``outcomes`` how many different words it stands for, unknown ones
    counted as one.  ``tokens`` and ``types`` are over all that is learned from, the end included.
    """

    frequent: dict[bytes, int]
    learned: np.ndarray
    outcomes: np.ndarray
    tokens: int
    types: int
    rare: DataFrame

    @property
    def end(self) -> int:
        return len(self.learned) - 1

    @property
    def base_total(self) -> float:
        return self.tokens + ADDED * (self.types + 1)

    def shared(self) -> np.ndarray:
        """How often each symbol is, as a part of all."""
        counts = self.learned + ADDED * self.outcomes
        return counts / counts.sum()


def word_totals(documents: DataFrame) -> DataFrame:
    """``word, every, learned``: how often each word is in all documents and in those learned from, as a table."""

    def count(batches):
        found: tuple[Counter, Counter] = (Counter(), Counter())

        def counted():
            words = list(found[0].keys() | found[1].keys())
            learned = [found[0][word] for word in words]
            other = [found[1][word] for word in words]
            for own in found:
                own.clear()
            return pa.record_batch(
                [pa.array(words, pa.binary()), pa.array(learned, pa.int64()), pa.array(other, pa.int64())],
                ["word", "learned", "other"],
            )

        for batch in batches:
            held = batch.column("held_out").to_pylist()
            for out, text in zip(held, batch.column("text"), strict=True):
                own = found[out]
                own.update(tokens_of(text.as_py()))
                own[END] += 1
                if len(own) > _COUNTED:
                    yield counted()
        yield counted()

    rows = documents.select(held_out("doc_id").alias("held_out"), F.col("text").cast("binary").alias("text"))
    counted = rows.mapInArrow(count, "word binary, learned long, other long").groupBy("word")
    return written(
        counted.agg(F.sum(F.col("learned") + F.col("other")).alias("every"), F.sum("learned").alias("learned")), "words"
    )


def fit_vocabulary(documents: DataFrame, frequent: int = FREQUENT) -> Vocabulary:
    words = word_totals(documents)
    seen = F.count(F.when(F.col("learned") > 0, 1))
    total = words.agg(F.coalesce(F.sum("learned"), F.lit(0)), seen).first()
    others = words.filter(F.col("word") != F.lit(END))
    end = words.filter(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("learned"), F.lit(0))).first()[0]

    # The least frequency that at most so many words have: one row for each step of frequencies.
    level = F.floor(F.log2("every") * _STEPS_PER_DOUBLING).cast("int")
    levels = sorted(others.groupBy(level.alias("level")).count().collect(), key=lambda row: -row.level)
    least, taken = math.inf, 0
    for row in levels:
        taken += row["count"]
        if taken > frequent:
            break
        least = row.level
    is_frequent = level >= least if least < math.inf else F.lit(False)
    chosen = others.filter(is_frequent).select("word", "learned").orderBy("word").collect()
    rare = others.filter(~is_frequent).withColumn("class", _class("word"))

    symbols = len(chosen) + CLASSES + 1
    learned, outcomes = np.zeros(symbols, np.int64), np.ones(symbols, np.int64)
    learned[: len(chosen)] = [row.learned for row in chosen]
    # One row per class.
    for row in rare.groupBy("class").agg(F.sum("learned").alias("learned"), seen.alias("types")).collect():
        learned[len(chosen) + row["class"]] = row.learned
        outcomes[len(chosen) + row["class"]] = row.types + 1
    # A class without words still has unknown ones.
    learned[-1] = end
    return Vocabulary(
        {bytes(row.word): number for number, row in enumerate(chosen)}, learned, outcomes, total[0], total[1], rare
    )


def encoded(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Documents as symbols, as a table.

    ``row, doc_id, held_out, n_tokens, symbols, n_frequent, base_frequent, rare``: the packed symbols, how many
    tokens with a symbol of their own are known, their part of the base score, and the rare words.
    """
    frequent, end = vocabulary.frequent, vocabulary.end
    known = vocabulary.learned > 0
    kind = np.uint16 if end < 1 << 16 else np.uint32
    base = np.log10((vocabulary.learned + ADDED) / vocabulary.base_total)
    # Classes count with the words that they stand for.
    own_symbols = np.ones(end + 1, bool)
    own_symbols[len(frequent) : end] = False
    known = (known & own_symbols).astype(np.int64)
    base = np.where(own_symbols, base, 0.0)
    classes = len(frequent)

    def encode(batches):
        memo: dict[bytes, int] = {}

        def symbol_of(word: bytes) -> int:
            symbol = frequent.get(word)
            if symbol is None:
                symbol = memo.get(word)
                if symbol is None:
                    if len(memo) > _COUNTED:
                        memo.clear()
                    symbol = memo[word] = classes + class_of(word)
            return symbol

        for batch in batches:
            size = batch.num_rows
            text, numbers, words = words_in(batch.column("text"))
            own = np.fromiter(map(symbol_of, words.to_pylist()), np.int64, len(words))[numbers]
            sizes = np.bincount(text, minlength=size) + 1
            ends = np.cumsum(sizes)
            # Every text's end stands behind its words.
            symbols = np.full(ends[-1] if size else 0, end, kind)
            symbols[np.arange(len(text)) + text] = own
            row = np.repeat(np.arange(size), sizes)
            # The rare words of each text, each once.
            at = np.flatnonzero(own >= classes)
            found, times = np.unique(text[at] * len(words) + numbers[at], return_counts=True)
            rows, found = np.divmod(found, max(len(words), 1))
            begins = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=size))))
            rare = pa.StructArray.from_arrays(
                [words.take(pa.array(found, pa.int64())), pa.array(times, pa.int64())], ["word", "times"]
            )
            offsets = np.append(0, ends * symbols.itemsize).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(offsets), pa.py_buffer(symbols.tobytes())])
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(sizes, pa.int64()),
                    packed,
                    pa.array(np.bincount(row, known[symbols], size), pa.int64()),
                    pa.array(np.bincount(row, base[symbols], size), pa.float64()),
                    pa.ListArray.from_arrays(pa.array(begins, pa.int32()), rare),
                ],
                ["doc_id", "held_out", "n_tokens", "symbols", "n_frequent", "base_frequent", "rare"],
            )

    id_kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", held_out("doc_id").alias("held_out"), F.col("text").cast("binary").alias("text"))
    made = rows.mapInArrow(
        encode,
        f"doc_id {id_kind}, held_out boolean, n_tokens long, symbols binary, n_frequent long, base_frequent double, "
        "rare array<struct<word: binary, times: bigint>>",
    )
    return written(made.withColumn("row", F.monotonically_increasing_id()), "encoded")


def _sequences(column: pa.Array, symbols: int):
    """Symbol sequences of a batch with their places, some at a time, the longest first."""
    return _by_length(_unpacked(column, symbols))


def _unpacked(column: pa.Array, symbols: int) -> list[np.ndarray]:
    kind = np.uint16 if symbols <= 1 << 16 else np.uint32
    return [np.frombuffer(raw, kind) for raw in column.to_pylist()]


def _by_length(every: list[np.ndarray]):
    places: list[int] = []
    size = 0
    for place in sorted(range(len(every)), key=lambda place: -len(every[place])):
        if places and size + len(every[place]) > _TOGETHER:
            yield places, [every[i] for i in places]
            places, size = [], 0
        places.append(place)
        size += len(every[place])
    if places:
        yield places, [every[i] for i in places]


# Training and scores


def baum_welch(rows: DataFrame, model: Markov) -> Counts:
    """Expected counts over all ``symbols`` of ``rows``: added up in tasks, then by slices of symbols."""
    symbols, states = model.emit.shape
    width = -(-symbols // _SLICES)
    schema = "slice int, counts binary, head binary"

    def parts(counts: Counts):
        head = np.concatenate(([counts.likelihood], counts.start, counts.move.ravel()))
        for number in range(_SLICES):
            yield number, counts.emit[number * width : (number + 1) * width], head if number == 0 else head[:0]

    def batch_of(found):
        numbers, counts, heads = zip(*found, strict=True) if found else ((), (), ())
        return pa.record_batch(
            [
                pa.array(numbers, pa.int32()),
                pa.array([own.tobytes() for own in counts], pa.binary()),
                pa.array([own.tobytes() for own in heads], pa.binary()),
            ],
            ["slice", "counts", "head"],
        )

    def expect(batches):
        counts = Counts.none(states, symbols)

        def add(held: list[np.ndarray]) -> None:
            for _, own in _by_length(held):
                counts.add(model, own)

        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            held += _unpacked(batch.column(0), symbols)
            size += batch.column(0).nbytes
            if size > _SORTED_BYTES:
                add(held)
                held, size = [], 0
        add(held)
        yield batch_of(list(parts(counts)))

    def total(batches):
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for number, counts, head in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                own = [np.frombuffer(raw, np.float64) for raw in (counts, head)]
                sums[number] = [a + b for a, b in zip(sums[number], own, strict=True)] if number in sums else own
        yield batch_of([(number, *own) for number, own in sums.items()])

    # What a task hands on is as big as the model, however few texts it has, so there is one for each core.
    rows = rows.select("symbols").coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, 1))
    summed = rows.mapInArrow(expect, schema).repartition(_SLICES, "slice").mapInArrow(total, schema)
    counts = Counts.none(states, symbols)
    for row in summed.collect():
        own = np.frombuffer(row.counts, np.float64).reshape(-1, states)
        counts.emit[row.slice * width : row.slice * width + len(own)] += own
        if row.slice == 0:
            head = np.frombuffer(row.head, np.float64)
            counts.likelihood = float(head[0])
            counts.start, counts.move = head[1 : states + 1].copy(), head[states + 1 :].reshape(states, states).copy()
    return counts


def fit_markov(
    rows: DataFrame,
    vocabulary: Vocabulary,
    states: int = STATES,
    rounds: int = ROUNDS,
    warm_rounds: int = WARM_ROUNDS,
) -> Markov:
    """Train on the rows (``encoded``) that are not held out: every round, the warm ones too, covers all of them."""
    shared = vocabulary.shared()
    model = first_model(shared, states)
    learned = rows.filter(~F.col("held_out")).select("symbols")
    for _ in range(warm_rounds + rounds):
        model = normalised(baum_welch(learned, model), shared)
    return model


def _rare_sums(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``row, rare_known, rare_base, rare_within`` of rows with rare words."""
    spark = rows.sparkSession
    first = len(vocabulary.frequent)
    # One row per class.
    totals = vocabulary.learned[first:-1] + ADDED * vocabulary.outcomes[first:-1]
    classes = spark.createDataFrame(
        pa.table({"class": pa.array(range(CLASSES), pa.int32()), "class_total": pa.array(totals, pa.float64())})
    )
    counted = F.col("learned") + F.lit(ADDED)
    words = vocabulary.rare.join(F.broadcast(classes), "class").select(
        "word",
        (F.col("learned") > 0).cast("long").alias("known"),
        F.log10(counted / F.lit(float(vocabulary.base_total))).alias("base"),
        F.log10(counted / F.col("class_total")).alias("within"),
    )
    held = rows.select("row", F.inline("rare")).join(words, "word")
    return held.groupBy("row").agg(
        F.sum(F.col("times") * F.col("known")).alias("rare_known"),
        F.sum(F.col("times") * F.col("base")).alias("rare_base"),
        F.sum(F.col("times") * F.col("within")).alias("rare_within"),
    )


def score_rows(rows: DataFrame, vocabulary: Vocabulary, model: Markov) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row (``encoded``)."""
    symbols = len(model.emit)

    def forward(column: pa.Array) -> pa.Array:
        found = np.zeros(len(column))
        for places, own in _sequences(column, symbols):
            found[places] = log_likelihoods(model, own)
        return pa.array(found / math.log(10))

    scored = rows.select(
        "row",
        "doc_id",
        "held_out",
        "n_tokens",
        "n_frequent",
        "base_frequent",
        F.arrow_udf(forward, "double")(F.col("symbols")).alias("forward"),
    )
    none = F.lit(0.0)
    return scored.join(_rare_sums(rows, vocabulary), "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_frequent") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base_frequent") + F.coalesce("rare_base", none)).alias("base_score"),
        (F.col("forward") + F.coalesce("rare_within", none)).alias("score"),
    )


def score_texts(documents: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Learn from ``documents`` (``doc_id, text``) and score all of them."""
    arrow_bounded(documents.sparkSession)
    vocabulary = fit_vocabulary(documents)
    rows = encoded(documents, vocabulary)
    return score_rows(rows, vocabulary, fit_markov(rows, vocabulary, states, rounds))
