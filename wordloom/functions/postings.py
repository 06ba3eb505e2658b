"""Grouping a text's words inside its row, so that building postings needs no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words_with_positions(tokens: str) -> Column:
    """``array<struct<word, position>>`` in (word, position) order, positions from 0."""
    return F.sort_array(
        F.transform(tokens, lambda word, i: F.struct(word.alias("word"), i.alias("position")))
    )


def run_starts(ordered: str) -> Column:
    """1-based places in a ``words_with_positions`` array where another word begins."""

    def begins(place: Column) -> Column:
        return (place == 1) | (F.get(ordered, place - 1).word != F.get(ordered, place - 2).word)

    size = F.size(ordered)
    return F.when(size == 0, F.array().cast("array<int>")).otherwise(
        F.filter(F.sequence(F.lit(1), size), begins)
    )


def runs(ordered: str, starts: str) -> Column:
    """``array<struct<word, positions>>``: every distinct word with its ascending positions."""

    def run(start: Column, i: Column) -> Column:
        following = F.coalesce(F.get(starts, i + 1), F.size(ordered) + 1)
        pairs = F.slice(ordered, start, following - start)
        return F.struct(
            F.get(ordered, start - 1).word.alias("word"),
            F.transform(pairs, lambda pair: pair.position).alias("positions"),
        )

    return F.transform(starts, run)


def phrase_occurrences(slots: Column | str, lists: Column | str) -> Column:
    """How often the words of ``slots`` stand next to each other in that order.

    ``lists`` is ``array<struct<hash, positions>>``.  The positions of slot ``i`` move ``i`` places to the
    left; the starts common to all slots are the occurrences.  Overlapping ones count; a slot whose word
    is missing makes the result 0.  An empty slot asks for nothing: the pair before it has its word.
    """
    slots = F.col(slots) if isinstance(slots, str) else slots
    lists = F.col(lists) if isinstance(lists, str) else lists
    placed = F.transform(slots, lambda word, i: F.struct(word.alias("word"), i.alias("place")))
    placed = F.filter(placed, lambda slot: slot.word != "")

    def starts_of(slot: Column) -> Column:
        found = F.get(F.filter(lists, lambda entry: entry.hash == slot.word), F.lit(0)).positions
        return F.transform(found, lambda position: position - slot.place)

    shifted = F.transform(placed, starts_of)
    common = F.aggregate(
        F.slice(shifted, 2, F.greatest(F.size(slots) - 1, F.lit(0))),
        F.get(shifted, F.lit(0)),
        F.array_intersect,
    )
    return F.greatest(F.coalesce(F.size(common), F.lit(0)), F.lit(0))
