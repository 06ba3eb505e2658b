"""Language by rank-order profiles of n-grams of one to three letters.

A profile is a language's most frequent n-grams by rank.  A text is given the language whose profile is
nearest to the ranks of its own most frequent n-grams, by the sum of out-of-place distances.  Case is folded,
everything that is no letter counts as a word boundary.  A null text, one without letters, and any text when
there is nothing to learn from get ``und`` with score 0.  Equal distances go to the first language by name,
equal frequencies to the smaller n-gram.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.llm.common import arrow_bounded, different_rows, hash_share, held_out

PROFILE = 400
# About so many texts of each language are learned from.
SAMPLE_TEXTS = 3_000
# So many languages are told apart, those with most different texts; ties go by name.
LANGUAGES = 200
UNKNOWN = "und"
# Word boundary; letters have larger numbers.
_EDGE = 1
_BITS = 21


def letter_table() -> np.ndarray:
    """Code point -> its lower case, or the boundary if it is no letter."""
    table = np.full(0x110000, _EDGE, np.uint32)
    for start, end in ((0, 0xD800), (0xE000, 0x110000)):
        for point in range(start, end):
            char = chr(point)
            if char.isalpha():
                lower = char.lower()
                table[point] = ord(lower) if len(lower) == 1 else point
    return table


def ngrams(text: str | None, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams of a text as numbers, and how often each occurs."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    marks = letters[points]
    edge = marks == _EDGE
    if edge.all():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keep = ~edge
    keep[1:] |= ~edge[:-1]
    marks = marks[keep].astype(np.uint64)
    marks = np.concatenate(([_EDGE], marks[1:] if marks[0] == _EDGE else marks, [_EDGE])).astype(np.uint64)
    pairs = (marks[:-1] << np.uint64(_BITS)) | marks[1:]
    triples = (pairs[:-1] << np.uint64(_BITS)) | marks[2:]
    inner = marks[1:-1] != _EDGE
    both = (marks[:-1] != _EDGE) | (marks[1:] != _EDGE)
    return np.unique(
        np.concatenate((marks[marks != _EDGE], pairs[both], triples[inner])), return_counts=True
    )


def most_frequent(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The ``size`` most frequent n-grams in rank order."""
    if len(codes) > 2 * size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))][:size]


@dataclasses.dataclass(frozen=True)
class Profiles:
    """Languages by name, n-grams in any profile, and each one's rank in each language."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray

    def distances(self, top: np.ndarray) -> np.ndarray:
        """Mean out-of-place distance of ranked n-grams to each language, from 0 to 1."""
        place = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        ranks = np.where((self.codes[place] == top)[:, None], self.ranks[place], -1)
        off = np.abs(ranks - np.arange(len(top))[:, None])
        return np.where(ranks < 0, PROFILE, np.minimum(off, PROFILE)).sum(0) / (PROFILE * len(top))

    def predict(self, text: Column | str) -> Column:
        """``struct<lang_pred, score>`` of a text column."""
        profiles = self
        holder: dict = {}

        def guess(texts: pa.Array) -> pa.Array:
            if "letters" not in holder:
                holder["letters"] = letter_table()
            names, scores = [], []
            for text in texts:
                top = most_frequent(*ngrams(text.as_py(), holder["letters"]))
                if not len(top) or not profiles.languages:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                near = 1 - profiles.distances(top)
                best = int(np.argmax(near))
                rest = np.delete(near, best).max() if len(near) > 1 else 0.0
                names.append(profiles.languages[best])
                scores.append(float(near[best] / max(near[best] + rest, 1e-12)) if near[best] > 0 else 0.0)
            return pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"]
            )

        text = F.col(text) if isinstance(text, str) else text
        return F.arrow_udf(guess, "lang_pred string, score double")(text)


def fit_profiles(documents: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> Profiles:
    """Profiles of the languages in ``documents`` (``doc_id``, ``text``, ``lang``), held-out rows left out.

    Learned from about ``sample_texts`` texts of each language, chosen by a hash of id and text; rows alike in
    both are one text, however many they are.  Of more than ``LANGUAGES`` values of ``lang``, which no corpus of
    languages has, the others are not learned, as profiles go to every task.
    """
    arrow_bounded(documents.sparkSession)
    rows = documents.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id")
    )
    sizes = rows.groupBy("lang").agg(different_rows(["doc_id", "text"]).alias("texts"))
    sizes = sizes.orderBy(F.col("texts").desc(), "lang").limit(LANGUAGES).collect()
    shares = documents.sparkSession.createDataFrame(
        [(row.lang, sample_texts / max(row.texts, 1)) for row in sizes], "lang string, share double"
    )
    chosen = (
        rows.join(F.broadcast(shares), "lang")
        .filter(hash_share(["doc_id", "text"]) < F.col("share"))
        .select("doc_id", "text", "lang")
        .distinct()
    )

    def count(batches):
        letters = letter_table()
        for batch in batches:
            found: dict = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, counts = ngrams(text, letters)
                found.setdefault(lang, []).append((codes, counts))
            for lang, parts in found.items():
                codes, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                sums = np.bincount(place, np.concatenate([p[1] for p in parts]), minlength=len(codes))
                yield pa.record_batch(
                    [
                        pa.array([lang] * len(codes), pa.string()),
                        pa.array(codes.astype(np.int64)),
                        pa.array(sums.astype(np.int64)),
                    ],
                    ["lang", "code", "n"],
                )

    counted = (
        chosen.select("lang", "text")
        .mapInArrow(count, "lang string, code long, n long")
        .groupBy("lang", "code")
        .agg(F.sum("n").alias("n"))
    )
    best_first = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    ranked = (
        counted.withColumn("place", F.row_number().over(best_first) - 1)
        .filter(F.col("place") < PROFILE)
        .select("lang", "code", "place")
        .collect()
    )
    languages = sorted({row.lang for row in ranked})
    codes = np.array(sorted({row.code for row in ranked}), np.uint64)
    ranks = np.full((len(codes), len(languages)), -1)
    column = {lang: i for i, lang in enumerate(languages)}
    for row in ranked:
        ranks[np.searchsorted(codes, np.uint64(row.code)), column[row.lang]] = row.place
    return Profiles(languages, codes, ranks)


def identify(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row."""
    arrow_bounded(documents.sparkSession)
    guessed = documents.select("doc_id", profiles.predict("text").alias("guess"))
    return guessed.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        F.col("guess.lang_pred").alias("lang_pred"),
        F.col("guess.score").alias("score"),
    )
