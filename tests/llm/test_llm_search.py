"""Search along a sharing graph, clusters and the language model: brute force, edge cases, hand-made cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from wordloom.llm import centroids, hidden_markov, shared_search

CLASHING = "rank int, score double, item string, terms string, n long, place string, row string, word string, held_out string"
EXTRA = (1, 0.5, "x", "y", 7, "z", "r", "w", "h")
TEXTS = [
    (1, "The cat sat on the mat. the END"),
    (2, "the cat sat on the mat the end"),
    (2, "the cat sat on the mat the end"),
    (3, None),
    (4, ""),
    (5, " \n\t?!"),
    (6, "cat " * 5000 + "dog"),
    (None, "A cat, a dog; Ünïcode ÜNÏCODE 42"),
    (7, "dog_dog dog-dog 42"),
    (8, "nothing else matters here"),
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(*row, *EXTRA) for row in TEXTS]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASHING}")


# Search


ITEMS = [
    (1, "the cat and the dog"),
    (1, "the cat and the dog"),
    (1, "another text: cat dog"),
    (2, "cat dog 42 cat cat"),
    (None, "the mat"),
    (3, None),
    (4, "?!"),
    (5, "absent words only"),
    (6, "the cat sat on the mat; Ünïcode"),
]


def ranked(documents, items, k):
    """As the rules say, one document and item at a time."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def terms(text):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return pattern.findall(lower)

    own = [(doc_id, terms(text)) for doc_id, text in documents if terms(text)]
    n, length = len(own), sum(len(words) for _, words in own)
    found = []
    for item_id, text in dict.fromkeys(items):
        scores = []
        for doc_id, words in own:
            m = 100 - 25 + (25 * len(words) * n) // length
            score = 0
            for term in terms(text):
                df = sum(term in other for _, other in own)
                tf = words.count(term)
                weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
                score += weight * ((10**9 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, none, doc_id) in enumerate(sorted(scores)[:k], 1):
            found.append((item_id, rank, None if none else doc_id, -score))
    return sorted(found, key=repr)


@pytest.mark.parametrize("block_terms", [50_000, 4])
@pytest.mark.parametrize("k", [20, 2])
def test_ranks_are_those_of_brute_force(spark, texts, block_terms, k):
    items = spark.createDataFrame([(*row, *EXTRA) for row in ITEMS], f"item_id long, text string, {CLASHING}")
    rows = shared_search.search_items(texts.repartition(3), items, k, block_terms).collect()
    assert sorted(map(tuple, rows), key=repr) == ranked(TEXTS, ITEMS, k)
    assert len({row.score for row in rows}) > 5


def test_random_texts_rank_alike_in_any_cut(spark, monkeypatch):
    random.seed(5)
    words = [f"w{int(random.paretovariate(0.7)) % 60}" for _ in range(4000)]
    documents = [(i % 97, " ".join(random.choices(words, k=random.randint(1, 60)))) for i in range(400)]
    items = [(i, " ".join(random.choices(words, k=random.randint(1, 25)))) for i in range(25)]
    frame = spark.createDataFrame(documents, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    # So few numbers that a batch of documents is cut into many.
    monkeypatch.setattr(shared_search, "_NUMBERS", 3000)
    rows = shared_search.search_items(frame, asked).collect()
    expected = ranked(documents, items, 20)
    assert sorted(map(tuple, rows), key=repr) == expected


def test_nothing_to_search(spark, texts):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for documents, asked in ((texts.limit(0), items), (texts, items.limit(0)), (texts, items.filter("item_id IN (3, 4)"))):
        found = shared_search.search_items(documents, asked)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.collect() == []
    blank = texts.filter("doc_id IN (3, 4, 5)")
    assert shared_search.search_items(blank, items).collect() == []


def test_parts_are_shared_and_add_up():
    random.seed(7)
    common = [random.sample(range(40), 6) for _ in range(4)]
    items = [
        dict(collections.Counter([*random.choice(common), *random.choice(common), *random.choices(range(40), k=3)]))
        for _ in range(30)
    ]
    graph = shared_search.share_terms(items, 40)
    values = np.random.default_rng(1).integers(0, 1000, (40, 9))
    expected = np.array([[sum(times * values[t, d] for t, times in item.items()) for d in range(9)] for item in items])
    assert (shared_search.item_scores(graph, values) == expected).all()
    # Fewer additions than term by term; no pair of parts is left that two items share.
    assert len(graph.joined) + sum(map(len, graph.parts)) < 0.7 * sum(map(len, items))
    left = collections.Counter(pair for own in graph.parts for pair in itertools.combinations(own, 2))
    assert max(left.values(), default=0) <= 1


# Clusters


def clustered(rows, k, rounds, dimensions, scale):
    """As the rules say, with Python integers and every centroid tried."""
    kept = [
        (vec_id, [math.floor(float(x) * scale) if abs(x) < 1e300 else int(x) * scale for x in vector])
        for vec_id, vector in rows
        if vector is not None and len(vector) == dimensions
        and all(x is not None and math.isfinite(x) for x in vector)
    ]
    order = sorted(kept, key=lambda row: (hashlib.sha256(f"1:{'' if row[0] is None else row[0]}".encode()).hexdigest(), row[1]))
    middle = [vector for _, vector in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(middle)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for number in range(len(middle)):
            own = [vector for (_, vector), (_, n) in zip(kept, found, strict=True) if n == number]
            if own:
                middle[number] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    found = assign()

    def fits(total):
        return total if total <= 2**63 - 1 else None

    inertia = fits(sum(distance for distance, _ in found))
    return sorted(
        (
            (
                vec_id, number, fits(distance), fits(sum(d for d, n in found if n == number)), inertia,
                hashlib.sha256(",".join(map(str, middle[number])).encode()).hexdigest(),
            )
            for (vec_id, _), (distance, number) in zip(kept, found, strict=True)
        ),
        key=repr,
    )


def vectors_of(spark, rows):
    return spark.createDataFrame(
        [(*row, "x", 1, "y", "z") for row in rows],
        "vec_id long, embedding array<double>, vector string, cluster int, found string, distance string",
    )


@pytest.mark.parametrize("k", [1, 5, 16])
def test_clusters_are_those_of_brute_force(spark, k):
    random.seed(k)
    # Few values, so that distances are often equal; ids repeat.
    rows = [(i % 190, [random.randint(-3, 3) / 8 for _ in range(3)]) for i in range(300)]
    nan, inf = float("nan"), float("inf")
    rows += [(500, None), (501, []), (502, [1.0] * 4), (503, [1.0, None, 2.0]), (504, [nan] * 3), (505, [1.0, -inf, 0.0])]
    rows += [(None, [0.1, 0.2, -0.3])] * 3
    found = centroids.cluster(vectors_of(spark, rows).repartition(4), k, 3, 3, 64).collect()
    assert sorted(map(tuple, found), key=repr) == clustered(rows, k, 3, 3, 64)


def test_vectors_beyond_64_bits(spark):
    rows = [(i, [float(i) * 10**29, -(10.0 ** (i % 3)), 1.7e308 if i == 7 else 0.25 * i]) for i in range(12)]
    found = centroids.cluster(vectors_of(spark, rows), 4, 3, 3, 64).collect()
    assert sorted(map(tuple, found), key=repr) == clustered(rows, 4, 3, 3, 64)
    assert any(row.distance is None for row in found) and all(row.inertia is None for row in found)


def test_few_vectors_and_none(spark):
    rows = [(3, [1.0, 2.0]), (9, [1.5, 2.0])]
    found = centroids.cluster(vectors_of(spark, rows), 16, 3, 2, 64).collect()
    assert sorted(map(tuple, found), key=repr) == clustered(rows, 16, 3, 2, 64)
    same = [(i, [0.5, 0.5]) for i in range(40)]
    found = centroids.cluster(vectors_of(spark, same), 16, 3, 2, 64).collect()
    assert {(row.cluster, row.distance, row.inertia) for row in found} == {(0, 0, 0)}
    for none in (vectors_of(spark, rows).limit(0), vectors_of(spark, [(1, None)])):
        assert centroids.cluster(none, 16, 3, 2, 64).collect() == []


@pytest.mark.parametrize("k", [2, 17, 200])
def test_the_tree_finds_the_nearest_and_leaves_most_out(k, monkeypatch):
    rng = np.random.default_rng(k)
    for spread in (4, 10_000):
        middle, vectors = rng.integers(-spread, spread, (k, 3)), rng.integers(-spread, spread, (400, 3))
        middle[k // 2] = middle[0]
        asked = []
        squared = centroids.squared
        monkeypatch.setattr(centroids, "squared", lambda ones, two: asked.append(len(ones)) or squared(ones, two))
        tree = centroids.build_tree(middle)
        asked.clear()
        found, best = centroids.nearest(vectors, middle, tree)
        monkeypatch.undo()
        every = ((vectors[:, None] - middle) ** 2).sum(axis=2)
        assert (best == every.min(axis=1)).all() and (found == every.argmin(axis=1)).all()
        assert sum(asked) <= every.size and (k < 200 or sum(asked) < 0.5 * every.size)


# Language model


def test_tokens_and_classes(spark):
    assert hidden_markov.tokens_of("Ab\x0bC\x1cd É e".encode()) == ["ab".encode(), "c\x1cd É".encode(), b"e"]
    words = [b"a", b"ab", b"abc", b"abcd", "größe".encode(), "é".encode(), b"1234567"]
    frame = spark.createDataFrame([(word,) for word in words], "word binary")
    found = {bytes(row.word): row.own for row in frame.select("word", hidden_markov._class("word").alias("own")).collect()}
    assert found == {word: hidden_markov.class_of(word) for word in words}


def naive_forward(model, symbols):
    """All paths of states, one by one: the probability and the expected counts."""
    states, total = len(model.start), 0.0
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit)
    for path in itertools.product(range(states), repeat=len(symbols)):
        p = model.start[path[0]] * model.emit[symbols[0], path[0]]
        for (a, b), symbol in zip(itertools.pairwise(path), symbols[1:], strict=True):
            p *= model.move[a, b] * model.emit[symbol, b]
        total += p
        start[path[0]] += p
        for a, b in itertools.pairwise(path):
            move[a, b] += p
        for state, symbol in zip(path, symbols, strict=True):
            emit[symbol, state] += p
    return total, start / total, move / total, emit / total


def random_model(states, symbols, seed):
    rng = np.random.default_rng(seed)
    start, move, emit = rng.random(states), rng.random((states, states)), rng.random((symbols, states))
    return hidden_markov.Markov(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def test_recursions_agree_with_all_paths():
    model = random_model(3, 5, 1)
    rng = np.random.default_rng(2)
    sequences = [rng.integers(0, 5, size) for size in (1, 4, 6, 6, 2, 1)]
    counts = hidden_markov.Counts.none(3, 5)
    counts.add(model, sequences)
    naive = [naive_forward(model, own) for own in sequences]
    assert np.allclose(hidden_markov.log_likelihoods(model, sequences), [math.log(own[0]) for own in naive])
    assert math.isclose(counts.likelihood, sum(math.log(own[0]) for own in naive))
    for place, own in enumerate((counts.start, counts.move, counts.emit), 1):
        assert np.allclose(own, sum(found[place] for found in naive))


def test_long_sequences_do_not_vanish():
    model = random_model(4, 50, 3)
    long = np.random.default_rng(4).integers(0, 50, 30_000)
    found = hidden_markov.log_likelihoods(model, [long, long[:10]])
    now, total = model.start * model.emit[long[0]], 0.0
    for symbol in long[1:]:
        total += math.log(now.sum())
        now = (now / now.sum()) @ model.move * model.emit[symbol]
    assert math.isclose(found[0], total + math.log(now.sum()), rel_tol=1e-9) and found[0] < -100_000


def held(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 == 1


def words_of(text):
    return [word.lower() for word in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())] + [b" "]


def base_of(rows):
    learned = collections.Counter(word for doc_id, text in rows if not held(doc_id) for word in words_of(text))
    size, types = sum(learned.values()), len(learned)
    return learned, size, lambda text: sum(
        math.log10((learned[word] + 0.5) / (size + 0.5 * (types + 1))) for word in words_of(text)
    )


@pytest.mark.parametrize("frequent", [3, 65_023])
def test_scores_are_those_of_the_definition(spark, texts, frequent):
    vocabulary = hidden_markov.fit_vocabulary(texts, frequent)
    rows = hidden_markov.encoded(texts, vocabulary)
    model = hidden_markov.fit_markov(rows, vocabulary, states=2, rounds=2, warm_rounds=1)
    found = hidden_markov.score_rows(rows, vocabulary, model).collect()
    learned, size, base = base_of(TEXTS)
    assert (vocabulary.tokens, vocabulary.types) == (size, len(learned))
    assert len(vocabulary.frequent) <= frequent

    # Rare words by class, as they are in the texts learned from.
    rare = collections.defaultdict(collections.Counter)
    for word, count in learned.items():
        if word != b" " and word not in vocabulary.frequent:
            rare[hidden_markov.class_of(word)][word] += count

    def score(text):
        total, now = 0.0, None
        for word in words_of(text):
            if word == b" ":
                symbol = vocabulary.end
            elif word in vocabulary.frequent:
                symbol = vocabulary.frequent[word]
            else:
                own = rare[hidden_markov.class_of(word)]
                symbol = len(vocabulary.frequent) + hidden_markov.class_of(word)
                total += math.log10((own[word] + 0.5) / (sum(own.values()) + 0.5 * (len(own) + 1)))
            now = model.emit[symbol] * (model.start if now is None else now @ model.move)
            total, now = total + math.log10(now.sum()), now / now.sum()
        return total

    expected = sorted(
        (
            (doc_id, held(doc_id), len(words_of(text)), sum(word in learned for word in words_of(text)), size,
             round(base(text), 6), round(score(text), 6))
            for doc_id, text in TEXTS
        ),
        key=repr,
    )
    assert sorted(((*row[:5], round(row.base_score, 6), round(row.score, 6)) for row in found), key=repr) == expected
    assert {row.held_out for row in found} == {True, False}


def test_probabilities_of_all_outcomes_add_up_to_one(spark, texts):
    vocabulary = hidden_markov.fit_vocabulary(texts, 3)
    assert math.isclose(vocabulary.shared().sum(), 1)
    model = hidden_markov.normalised(hidden_markov.Counts.none(4, len(vocabulary.learned)), vocabulary.shared())
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1)
    first = len(vocabulary.frequent)
    rare = collections.defaultdict(list)
    for row in vocabulary.rare.collect():
        if row.learned:
            rare[row["class"]].append(row.learned)
    for number in range(hidden_markov.CLASSES):
        symbol = first + number
        total = vocabulary.learned[symbol] + 0.5 * vocabulary.outcomes[symbol]
        assert math.isclose((sum(count + 0.5 for count in rare[number]) + 0.5) / total, 1)


def test_states_learn_what_goes_together(spark):
    """Two made-up languages with the same frequent words in another order: held-out texts become likelier."""
    random.seed(9)
    one, two = [f"eins{i}" for i in range(30)], [f"deux{i}" for i in range(30)]
    rows = [(i, " ".join(random.choices(one if i % 2 else two, k=40))) for i in range(600)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = hidden_markov.score_texts(documents, states=2).filter("held_out").collect()
    gain = sum(row.score - row.base_score for row in found) / sum(row.n_tokens for row in found)
    # Nearly all of what knowing the language is worth.
    assert len(found) > 80 and gain > 0.9 * math.log10(2) * 40 / 41


def test_full_rounds_read_every_text_and_never_lose(spark, texts):
    vocabulary = hidden_markov.fit_vocabulary(texts, 20)
    rows = hidden_markov.encoded(texts, vocabulary).filter("NOT held_out")
    model = hidden_markov.first_model(vocabulary.shared(), 3)
    tokens = sum(len(words_of(text)) for doc_id, text in TEXTS if not held(doc_id))
    before = -math.inf
    for _ in range(4):
        counts = hidden_markov.baum_welch(rows, model)
        assert math.isclose(counts.emit.sum(), tokens, rel_tol=1e-9)
        model = hidden_markov.Markov(
            counts.start / counts.start.sum(),
            counts.move / counts.move.sum(axis=1, keepdims=True),
            counts.emit / counts.emit.sum(axis=0),
        )
        assert counts.likelihood > before - 1e-6
        before = counts.likelihood


def test_nothing_to_learn_from(spark, texts):
    assert hidden_markov.score_texts(texts.limit(0)).collect() == []
    only = texts.filter("doc_id IN (3, 8)")
    assert all(held(row.doc_id) for row in only.collect())
    found = hidden_markov.score_texts(only).collect()
    assert all((row.train_tokens, row.n_known, row.base_score) == (0, 0, 0.0) for row in found)
    assert all(math.isfinite(row.score) for row in found)


def test_words_of_a_batch_are_those_of_each_text():
    texts = ["  Ab\x0bC\x1cd  É e\t", "", None, " \n", "x", "x X\ry", "größe ÄB"]
    raw = pa.array([None if text is None else text.encode() for text in ["cut", *texts]], pa.binary()).slice(1)
    text, numbers, words = hidden_markov.words_in(raw)
    found = [[] for _ in texts]
    for place, number in zip(text.tolist(), numbers.tolist(), strict=True):
        found[place].append(words[number].as_py())
    assert found == [hidden_markov.tokens_of(None if text is None else text.encode()) for text in texts]


def test_every_round_learns_from_all_texts(spark):
    """With more texts than a sample would have, the model is that of all rounds over all of them."""
    rows = [(i, f"a b{i % 7} c{i % 3} {'d ' * (i % 5)}") for i in range(6_000)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    vocabulary = hidden_markov.fit_vocabulary(documents)
    encoded = hidden_markov.encoded(documents, vocabulary)
    learned = [row.symbols for row in encoded.filter("NOT held_out").select("symbols").collect()]
    sequences = [np.frombuffer(raw, np.uint16) for raw in learned]
    model = hidden_markov.first_model(vocabulary.shared(), 2)
    for _ in range(4):
        counts = hidden_markov.Counts.none(2, len(model.emit))
        counts.add(model, sequences)
        model = hidden_markov.normalised(counts, vocabulary.shared())
    found = hidden_markov.fit_markov(encoded, vocabulary, states=2, rounds=1, warm_rounds=3)
    for own, wanted in ((found.start, model.start), (found.move, model.move), (found.emit, model.emit)):
        assert np.allclose(own, wanted, rtol=1e-6, atol=0)
