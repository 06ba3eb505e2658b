"""Toxicity by weak supervision.

Voters look at a text: word lists, words and word beginnings mined from labelled rows, and patterns.  A
generative label model over all texts' votes estimates how accurate each voter is and which of them
correlate, and turns votes into posterior labels; a linear classifier learns these and scores texts.

Texts that are null or empty have no votes and get the score of a text without any feature.  Labels that are
null are left out; of several labels of one document the greatest counts.  Without a labelled row, or with
labels of one kind only, the word lists and patterns vote alone.
"""

from __future__ import annotations

import dataclasses
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import arrow_bounded, different_rows, hash_share, held_out, row_hash, words_of
from wordloom.session import BROADCAST_ROWS, written

# At most about so many labelled rows are mined for words and train the classifier.
SAMPLE_ROWS = 20_000
# Word beginnings of these lengths in bytes are features.
PREFIXES = (4, 5, 6, 7)
# A mined feature's texts are toxic at least at this rate, and at MINED_RATE by the lower end of its interval.
MINED_SEEN = 0.9
MINED_RATE = 0.5
MINED_Z = 2.58
# So many mined features at most, the surest first: they go to every task.
MINED_FEATURES = 4096
# From so many labels of each kind on, correlations are those within labelled classes.
TOLD_LABELS = 50
THRESHOLD = 0.3

INSULTS = {
    "en": "idiot idiots moron morons loser losers stupid dumb dumbass clown clowns scum trash garbage "
    "pathetic worthless disgusting imbecile jerk creep freak bastard bitch asshole fool filthy vermin "
    "retard degenerate crap shit shitty fuck fucking cunt dick prick whore slut scumbag",
    "other": "idioten dummkopf trottel arschloch schlampe wichser mistkerl hurensohn versager abschaum "
    "widerlich scheisse idiote imbécile connard connasse salope crétin débile ordure minable nul "
    "idiotas imbécil estúpido estúpida gilipollas cabrón puta basura patético asqueroso mierda",
}
_LISTS = {name: frozenset(w.encode() for w in text.split()) for name, text in INSULTS.items()}
_MASKED = re.compile(rb"(?<![0-9a-z])[a-z]{1,2}[*@#$]{2,}[a-z]{1,4}(?![0-9a-z])")
_ADDRESS = re.compile(
    rb"(?:you are|you re|you're|du bist|ihr seid|tu es|vous \xc3\xaates|eres|sois) "
    rb"(?:such |so |an? |the |ein |eine |une? |un |una )*([0-9a-z\x80-\xff]+)"
)

VOTERS = (
    "insults",
    "insults_other",
    "many_insults",
    "mined_words",
    "mined_short_beginnings",
    "mined_long_beginnings",
    "masked",
    "address",
    "shouting",
)


def features_of(words: set[bytes], memo: dict | None = None, known=None) -> set[bytes]:
    """Words (``=word``) and word beginnings (``^begi``) of a text; only ``known`` ones if these are given."""
    found: set[bytes] = set()
    for word in words:
        own = memo.get(word) if memo is not None else None
        if own is None:
            own = [b"=" + word, *[b"^" + word[:n] for n in PREFIXES if len(word) >= n]]
            if known is not None:
                own = [feature for feature in own if feature in known]
            if memo is not None:
                if len(memo) > 200_000:
                    memo.clear()
                memo[word] = own
        found.update(own)
    return found


def votes_of(text: bytes | None, words: list[bytes], features: set[bytes]) -> int:
    """Bit i says that voter i takes the text for toxic."""
    distinct = set(words)
    insults = sum(word in _LISTS["en"] or word in _LISTS["other"] for word in distinct)
    lower = (text or b"").lower()
    letters = sum(map(text.count, (b"!",))) if text else 0
    fired = (
        not _LISTS["en"].isdisjoint(distinct),
        not _LISTS["other"].isdisjoint(distinct),
        insults >= 2,
        any(feature[:1] == b"=" for feature in features),
        any(feature[:1] == b"^" and len(feature) <= 6 for feature in features),
        any(feature[:1] == b"^" and len(feature) > 6 for feature in features),
        bool(_MASKED.search(lower)),
        any(m[1] in _LISTS["en"] or m[1] in _LISTS["other"] for m in _ADDRESS.finditer(lower)),
        letters >= 3 and letters * 10 >= len(words),
    )
    return sum(1 << i for i, vote in enumerate(fired) if vote)


# The label model


@dataclasses.dataclass(frozen=True)
class LabelModel:
    """Posterior of every vote pattern, the voters' accuracies and the pairs taken to be correlated."""

    posterior: np.ndarray
    prior: float
    accuracies: dict[str, float]
    correlated: list[tuple[str, str]]


def _fitted(weights: np.ndarray, votes: np.ndarray, pairs: list[tuple[int, int]], rounds: int = 30):
    """The distribution over vote patterns of most entropy with the single and pair rates of ``weights``.

    Iterative proportional fitting; patterns are few (2 to the number of voters).
    """
    total = weights.sum()
    table = np.full(len(weights), 1.0 / len(weights))
    groups = [votes[:, [i]] @ [1] for i in range(votes.shape[1])]
    groups += [votes[:, [i, j]] @ [1, 2] for i, j in pairs]
    wanted = []
    for group in groups:
        sums = np.bincount(group, weights, minlength=group.max() + 1) + 0.5
        wanted.append(sums / (total + 0.5 * len(sums)))
    # Pair tables have their own smoothing; singles come last so that they hold exactly.
    for _ in range(rounds):
        for group, rates in reversed(list(zip(groups, wanted, strict=True))):
            now = np.bincount(group, table, minlength=len(rates))
            table = table * (rates / np.maximum(now, 1e-300))[group]
    return table / table.sum()


def fit_label_model(
    counts: np.ndarray, labelled: np.ndarray, voters: tuple[str, ...] = VOTERS, rounds: int = 25
) -> LabelModel:
    """From how many texts show each vote pattern, and how many labelled 0 and 1 (two columns).

    Expectation maximization from a majority-vote start.  After a first pass with independent voters, pairs
    that still correlate within a class get a parameter of their own.
    """
    m = len(voters)
    votes = (np.arange(1 << m)[:, None] >> np.arange(m)) & 1
    counts = np.asarray(counts, float)
    labelled = np.asarray(labelled, float)
    free = np.maximum(counts - labelled.sum(1), 0)
    posterior = np.where(votes.sum(1) > 0, 0.8, 0.02)
    if labelled.sum() > 0:
        told = labelled.sum(1) > 0
        rate = labelled[:, 1] / np.maximum(labelled.sum(1), 1)
        posterior = np.where(told, (posterior + rate * labelled.sum(1)) / (1 + labelled.sum(1)), posterior)
    pairs: list[tuple[int, int]] = []
    prior = 0.1
    for step in range(2 * rounds):
        heavy = [free * (1 - posterior) + labelled[:, 0], free * posterior + labelled[:, 1]]
        prior = float((heavy[1].sum() + 1) / (heavy[0].sum() + heavy[1].sum() + 10))
        clean, toxic = (_fitted(w + 1e-9, votes, pairs, 3 if not pairs else 20) for w in heavy)
        odds = prior * toxic / np.maximum((1 - prior) * clean, 1e-300)
        posterior = odds / (1 + odds)
        if step == rounds:
            # Labels tell a correlation within a class from one that makes the class; few labels do not.
            told = labelled.sum(0).min() >= TOLD_LABELS
            pairs = _correlated([labelled[:, 0], labelled[:, 1]] if told else heavy, votes)
            if not pairs:
                break
    rates = [np.array([w @ votes / max(w.sum(), 1e-9)])[0] for w in heavy]
    accuracies = {
        name: float(prior * rates[1][i] + (1 - prior) * (1 - rates[0][i]))
        for i, name in enumerate(voters)
    }
    return LabelModel(posterior, prior, accuracies, [(voters[i], voters[j]) for i, j in pairs])


def _correlated(heavy: list[np.ndarray], votes: np.ndarray, least: float = 0.1) -> list[tuple[int, int]]:
    found = set()
    for weights in heavy:
        total = weights.sum()
        if total < 20:
            continue
        mean = weights @ votes / total
        both = (votes * weights[:, None]).T @ votes / total
        spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
        correlation = (both - np.outer(mean, mean)) / np.outer(spread, spread)
        for i in range(votes.shape[1]):
            for j in range(i):
                size = abs(correlation[i, j])
                if min(mean[i], mean[j]) * total >= 5 and size >= max(least, 4 / math.sqrt(total)):
                    found.add((j, i))
    return sorted(found)


# The classifier


@dataclasses.dataclass(frozen=True)
class ToxicityModel:
    """Weights of mined features and voters; ``label_model`` tells what the voters are worth."""

    features: dict[bytes, int]
    weights: np.ndarray
    bias: float
    label_model: LabelModel | None

    def score(self, text: Column | str) -> Column:
        """Score of a text column from 0 to 1, batch by batch."""
        features, weights, bias = self.features, self.weights, self.bias

        def scores(texts: pa.Array) -> pa.Array:
            memo: dict = {}
            first_voter = len(features)
            found = np.empty(len(texts))
            for row, text in enumerate(texts):
                raw = text.as_py()
                words = words_of(raw)
                own = features_of(set(words), memo, features)
                total = bias + sum(weights[features[feature]] for feature in own)
                votes = votes_of(raw, words, own)
                while votes:
                    low = votes & -votes
                    total += weights[first_voter + low.bit_length() - 1]
                    votes ^= low
                found[row] = 1 / (1 + math.exp(-max(-500.0, min(500.0, total))))
            return pa.array(found)

        text = F.col(text) if isinstance(text, str) else text
        return F.arrow_udf(scores, "double")(text.cast("binary"))


def _votes_udf(features: frozenset[bytes] | dict[bytes, int]):
    def votes(texts: pa.Array) -> pa.Array:
        memo: dict = {}
        found = []
        for text in texts:
            raw = text.as_py()
            words = words_of(raw)
            found.append(votes_of(raw, words, features_of(set(words), memo, features)))
        return pa.array(found, pa.int32())

    return F.arrow_udf(votes, "int")


def _feature_counts(rows: DataFrame, known: frozenset[bytes] | None) -> DataFrame:
    """In how many texts each feature occurs, summed in each task first."""

    def count(batches):
        found: Counter = Counter()
        memo: dict = {}
        for batch in batches:
            for text in batch.column(0):
                found.update(features_of(set(words_of(text.as_py())), memo, known))
        yield pa.record_batch([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["feature", "n"])

    return (
        rows.select(F.col("text").cast("binary").alias("text"))
        .mapInArrow(count, "feature binary, n long")
        .groupBy("feature")
        .agg(F.sum("n").alias("n"))
    )


def _mined(sample: DataFrame, total: dict[int, int]) -> dict[bytes, int]:
    """Features whose texts are nearly always toxic, and often enough by Wilson's lower bound."""
    least = math.ceil(MINED_RATE * MINED_Z**2 / (1 - MINED_RATE))
    toxic = _feature_counts(sample.filter("toxic = 1"), None).filter(F.col("n") >= least).collect()
    found = {bytes(row.feature): row.n for row in toxic}
    clean = _feature_counts(sample.filter("toxic = 0"), frozenset(found)).collect()
    other = {bytes(row.feature): row.n for row in clean}
    rated = []
    for feature, n in found.items():
        size = n + other.get(feature, 0)
        rate, z2 = n / size, MINED_Z**2
        low = (rate + z2 / (2 * size) - MINED_Z * math.sqrt(rate * (1 - rate) / size + z2 / (4 * size**2))) / (1 + z2 / size)
        if rate >= MINED_SEEN and low >= max(MINED_RATE, total[1] / (total[0] + total[1])):
            rated.append((-low, feature))
    return {feature: i for i, (_, feature) in enumerate(sorted(rated)[:MINED_FEATURES])}


def _linear(
    active: pa.ListArray, targets: np.ndarray, many: np.ndarray, width: int, rounds: int = 400, l2: float = 1e-3
):
    """Logistic regression on posterior labels of weighted rows: full-batch gradient steps with momentum."""
    if not len(active):
        return np.zeros(width), -2.0
    rows = np.repeat(np.arange(len(active)), active.value_lengths().to_numpy(zero_copy_only=False))
    columns = active.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    weights, bias, n = np.zeros(width), -2.0, many.sum()
    speed, bias_speed = np.zeros(width), 0.0
    support = np.bincount(columns, many[rows], minlength=width) if len(columns) else np.zeros(width)
    pace = 1.0 / np.maximum(support / n, 0.002)
    for _ in range(rounds):
        total = bias + np.bincount(rows, weights[columns], minlength=len(active))
        error = many * (1 / (1 + np.exp(-np.clip(total, -50, 50))) - targets)
        slope = np.bincount(columns, error[rows], minlength=width) / n + l2 * weights
        speed = 0.9 * speed - 0.02 * np.minimum(pace, 50) * slope
        bias_speed = 0.9 * bias_speed - 0.2 * error.sum() / n
        weights, bias = weights + speed, bias + bias_speed
    return weights, float(bias)


def fit_toxicity(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn from ``documents`` (``doc_id``, ``text``) and ``labels`` (``doc_id``, ``toxic``).

    Labels of held-out rows are not read.  Vote patterns are counted over all texts.  Words are mined in about
    ``sample_rows`` labelled texts, chosen by a hash of id and text; the classifier is trained on these and about
    as many unlabelled ones.  Rows alike in id and text are one text of a sample, however many they are.
    """
    spark = documents.sparkSession
    arrow_bounded(spark)
    known = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    total = {row.toxic: row["count"] for row in known.groupBy("toxic").count().collect()}
    if sum(total.values()) <= BROADCAST_ROWS:
        known = F.broadcast(known)
    # Labels meet hashes, votes or sampled texts: the other texts are never shuffled.
    rows = documents.select("doc_id", "text")
    share_of = hash_share(["doc_id", "text"])
    named = rows.select("doc_id", share_of.alias("share"), row_hash(["doc_id", "text"]).alias("name"))
    # One id may have many rows, and many of them may be copies: what differs is counted, not rows.
    different = named.join(known, "doc_id").agg(different_rows(["name"])).first()[0]
    share = min(1.0, sample_rows / max(different, 1))
    picked = named.filter(F.col("share") < share).join(known, "doc_id").select("doc_id", "toxic").distinct()
    picked = written(picked, "picked")
    if picked.count() <= BROADCAST_ROWS:
        picked = F.broadcast(picked)
    chosen = rows.filter(share_of < share).join(picked, "doc_id").distinct()
    both = total.get(0, 0) > 0 and total.get(1, 0) > 0
    features = _mined(chosen, total) if both else {}

    votes = _votes_udf(features)
    patterns = (
        rows.select("doc_id", votes(F.col("text").cast("binary")).alias("votes"))
        .join(known, "doc_id", "left")
        .groupBy("votes", "toxic")
        .count()
        .collect()
    )
    counts = np.zeros(1 << len(VOTERS))
    labelled = np.zeros((1 << len(VOTERS), 2))
    for row in patterns:
        counts[row.votes] += row["count"]
        if row.toxic is not None and both:
            labelled[row.votes, row.toxic] += row["count"]
    model = fit_label_model(counts, labelled)

    # A label is one more voter: as accurate as the posterior labels say.
    agreed = labelled[:, 1] @ model.posterior + labelled[:, 0] @ (1 - model.posterior)
    accuracy = min(max(agreed / max(labelled.sum(), 1), 0.6), 0.99)
    known_features = dict(features)

    def activate(texts: pa.Array) -> pa.Array:
        memo: dict = {}
        found = []
        for text in texts:
            raw = text.as_py()
            words = words_of(raw)
            own = features_of(set(words), memo, known_features)
            bits = votes_of(raw, words, own)
            active = sorted(known_features[feature] for feature in own)
            active += [len(known_features) + i for i in range(len(VOTERS)) if bits >> i & 1]
            found.append({"votes": bits, "active": active})
        return pa.array(found, pa.struct([("votes", pa.int32()), ("active", pa.list_(pa.int32()))]))

    # Unlabelled texts have posterior labels too; held-out ones stay out.
    every = named.agg(different_rows(["name"])).first()[0]
    others = min(1.0, sample_rows / max(every, 1))
    unlabelled = rows.filter(~held_out("doc_id") & (share_of < others))
    if both:
        unlabelled = unlabelled.join(known, "doc_id", "left_anti")
    unlabelled = unlabelled.withColumn("toxic", F.lit(None).cast("int"))
    sample = chosen.unionByName(unlabelled) if both else unlabelled
    key = [F.xxhash64("doc_id", "text", F.col("doc_id").isNull(), F.col("text").isNull()).alias("key"), "toxic"]
    seen = F.arrow_udf(activate, "votes int, active array<int>")(F.col("text").cast("binary"))
    # Copies of a text count once; texts alike to the classifier are one row with a weight.
    table = (
        sample.select(*key, seen.alias("seen"))
        .select("key", "toxic", "seen.votes", "seen.active")
        .distinct()
        .groupBy("votes", "active", "toxic")
        .agg(F.count(F.lit(1)).alias("weight"))
        .orderBy("votes", "active", "toxic")
        .toArrow()
    )
    posterior = model.posterior[table.column("votes").to_numpy()]
    odds = posterior / np.maximum(1 - posterior, 1e-9)
    if both:
        toxic = table.column("toxic")
        told = np.where(toxic.is_valid().to_numpy(), 2.0 * toxic.fill_null(0).to_numpy() - 1.0, 0.0)
        odds = odds * (accuracy / (1 - accuracy)) ** told
    active = table.column("active").combine_chunks()
    many = table.column("weight").to_numpy().astype(float)
    weights, bias = _linear(active, odds / (1 + odds), many, len(features) + len(VOTERS))
    return ToxicityModel(features, weights, bias, model)


def score_documents(documents: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    arrow_bounded(documents.sparkSession)
    scored = documents.select("doc_id", model.score("text").alias("score"))
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
