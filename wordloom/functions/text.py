"""Normalization and tokenization as plain Spark columns.

Text is decomposed, stripped of accents and lowercased one character at a time, then cut into words,
digit runs and symbol runs.  Every step is a built-in expression, so no Python worker ever sees a text.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Combining marks newer than the accent table being matched.  They stay in the text.
KEPT_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xAFA, 0xAFF), (0xB55, 0xB55),
    (0xC04, 0xC04), (0xC3C, 0xC3C), (0xCF3, 0xCF3), (0xD00, 0xD00), (0xD3B, 0xD3C), (0xD81, 0xD81),
    (0xEBA, 0xEBA), (0xECE, 0xECE), (0x1715, 0x1715), (0x180F, 0x180F), (0x1ABF, 0x1ACE),
    (0x1CF7, 0x1CF7), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0xA8FF, 0xA8FF), (0x10D24, 0x10D27),
    (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85),
    (0x11070, 0x11070), (0x11073, 0x11074), (0x110C2, 0x110C2), (0x11145, 0x11146),
    (0x111C9, 0x111C9), (0x111CE, 0x111CF), (0x11241, 0x11241), (0x1133B, 0x1133B),
    (0x1145E, 0x1145E), (0x1182C, 0x1183A), (0x11930, 0x11935), (0x11937, 0x11938),
    (0x1193B, 0x1193E), (0x11940, 0x11940), (0x11942, 0x11943), (0x119D1, 0x119D7),
    (0x119DA, 0x119E0), (0x119E4, 0x119E4), (0x11A01, 0x11A0A), (0x11A33, 0x11A39),
    (0x11A3B, 0x11A3E), (0x11A47, 0x11A47), (0x11A51, 0x11A5B), (0x11A8A, 0x11A99),
    (0x11D31, 0x11D36), (0x11D3A, 0x11D3A), (0x11D3C, 0x11D3D), (0x11D3F, 0x11D45),
    (0x11D47, 0x11D47), (0x11D8A, 0x11D8E), (0x11D90, 0x11D91), (0x11D93, 0x11D97),
    (0x11EF3, 0x11EF6), (0x11F00, 0x11F01), (0x11F03, 0x11F03), (0x11F34, 0x11F3A),
    (0x11F3E, 0x11F42), (0x13440, 0x13440), (0x13447, 0x13455), (0x16F4F, 0x16F4F),
    (0x16F7F, 0x16F87), (0x16FE4, 0x16FE4), (0x16FF0, 0x16FF1), (0x1CF00, 0x1CF2D),
    (0x1CF30, 0x1CF46), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE),
    (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)

# Characters dropped with the accents although they are not marks any more.
DROPPED_LETTERS = ((0x1CF2, 0x1CF3),)

# Capitals younger than some Python Unicode tables, as (first, last, first small letter).
YOUNG_CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD),
    (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70),
    (0x16EA0, 0x16EB8, 0x16EBB),
)

# The Hangul syllable block and its jamo (Unicode, chapter 3.12).
HANGUL_FIRST, HANGUL_LAST = 0xAC00, 0xD7A3
LEADING_JAMO, VOWEL_JAMO, TRAILING_JAMO = (0x1100, 0x1112), (0x1161, 0x1175), (0x11A8, 0x11C2)
HANGUL_TEST = "[\\x{AC00}-\\x{D7A3}]"

# What a word is, for text that is already normalized.  ASCII text needs only the first.
ASCII_WORD = r"[a-z]+|[0-9]+|[\x00-\x08\x0e-\x1f\x7f]+"
UNICODE_WORD = (
    r"(?U)[\p{Nd}\p{Nl}]+|\p{No}+"
    r"|[\p{IsAlphabetic}\p{M}\x{200c}\x{200d}&&[^\p{Nl}\p{Nd}]]+"
    r"|[^\s\p{IsAlphabetic}\p{M}\p{N}\x{200c}\x{200d}\p{P}$+<=>^`|~]+"
)


def _codes(ranges) -> frozenset[int]:
    return frozenset(code for first, last in ranges for code in range(first, last + 1))


_KEPT = _codes(KEPT_MARKS)
_DROPPED = _codes(DROPPED_LETTERS)


def fold_character(char: str) -> str:
    """The normalized form of one character, by rule."""
    if ord(char) in _KEPT:
        return char
    if ord(char) in _DROPPED:
        return ""
    parts = unicodedata.normalize("NFD", char)
    return "".join(part.lower() for part in parts if unicodedata.category(part)[0] != "M")


@functools.cache
def fold_alphabet() -> tuple[str, str]:
    """Arguments for ``translate``: all characters that change, and what they change to.

    Characters that vanish come last, where ``translate`` has no counterpart and deletes them.  Hangul
    syllables, the only characters that fold into several, are left out.
    """
    young = {
        code: chr(small + code - first)
        for first, last, small in YOUNG_CAPITALS
        for code in range(first, last + 1)
    }
    changed, dropped = [], []
    # No other plane has characters that change.
    for code in (*range(0x30000), *range(0xE0000, 0xE1000)):
        if 0xD800 <= code <= 0xDFFF or HANGUL_FIRST <= code <= HANGUL_LAST:
            continue
        char = chr(code)
        folded = young.get(code) or fold_character(char)
        if not folded:
            dropped.append(char)
        elif folded != char:
            changed.append((char, folded))
    source = "".join(char for char, _ in changed) + "".join(dropped)
    return source, "".join(folded for _, folded in changed)


def _decompose_hangul(text: Column) -> Column:
    """Every syllable as its leading, vowel and, if it has one, trailing jamo; arithmetic of its number."""
    leading, vowel, trailing = (
        "".join(chr(code) for code in range(first, last + 1))
        for first, last in (LEADING_JAMO, VOWEL_JAMO, TRAILING_JAMO)
    )
    trailings = len(trailing) + 1

    def jamo(alphabet: str, place: Column) -> Column:
        return F.substring(F.lit(alphabet), place.cast("int"), F.lit(1))

    def split_syllable(char: Column) -> Column:
        number = F.ascii(char) - F.lit(HANGUL_FIRST)
        rest = number % F.lit(trailings)
        return F.when(
            char.between(chr(HANGUL_FIRST), chr(HANGUL_LAST)),
            F.concat(
                jamo(leading, F.floor(number / (len(vowel) * trailings)) + 1),
                jamo(vowel, F.floor(number / trailings) % F.lit(len(vowel)) + 1),
                F.when(rest > 0, jamo(trailing, rest)).otherwise(F.lit("")),
            ),
        ).otherwise(char)

    return F.array_join(F.transform(F.split(text, ""), split_syllable), "")


def is_ascii(text: Column) -> Column:
    """True when no character takes more than one byte."""
    return F.octet_length(text) == F.char_length(text)


def normalize(text: Column | str) -> Column:
    """Decompose, strip accents, lowercase; NULL stays NULL."""
    text = F.col(text) if isinstance(text, str) else text
    folded = F.translate(text, *fold_alphabet())
    return (
        F.when(is_ascii(text), F.lower(text))
        .when(text.rlike(HANGUL_TEST), _decompose_hangul(folded))
        .otherwise(folded)
    )


def tokenize_normalized(normalized: Column | str) -> Column:
    """Words of normalized text in order, repeats kept; NULL text has no words.

    Pass a column that already exists: the argument appears several times in the expression.
    """
    normalized = F.col(normalized) if isinstance(normalized, str) else normalized
    text = F.coalesce(normalized, F.lit(""))
    return F.when(
        is_ascii(text), F.regexp_extract_all(text, F.lit(ASCII_WORD), F.lit(0))
    ).otherwise(F.regexp_extract_all(text, F.lit(UNICODE_WORD), F.lit(0)))


def with_tokens(frame, text: str = "text", tokens: str = "tokens"):
    """The frame with an array column of words made from a text column."""
    return frame.withColumn(tokens, normalize(text)).withColumn(tokens, tokenize_normalized(tokens))
