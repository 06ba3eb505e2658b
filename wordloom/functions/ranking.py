"""BM25 as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default tuning, and the digits a score is rounded to.
K1 = 1.5
B = 0.75
SCORE_DIGITS = 3


def inverse_document_frequency(total_documents: Column, document_count: Column) -> Column:
    """``ln((N - df + 0.5) / (df + 0.5))``: below zero for words in more than half of the texts."""
    return F.log((total_documents - document_count + 0.5) / (document_count + 0.5))


def bm25(
    term_frequency: Column,
    document_count: Column,
    words_total: Column,
    total_documents: Column,
    average_document_length: Column,
    k1: float = K1,
    b: float = B,
) -> Column:
    """Rounded score of one word or phrase in one text; NULL where a part of it is unknown."""
    length = F.lit(1) - F.lit(b) + F.lit(b) * words_total / average_document_length
    saturation = term_frequency * (F.lit(k1) + 1) / (term_frequency + F.lit(k1) * length)
    frequency = inverse_document_frequency(total_documents, document_count)
    return F.round(frequency * saturation, SCORE_DIGITS)
