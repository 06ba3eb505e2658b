"""Line dedup by content-defined chunks of lines.

A hash rolls over the hashes of every two lines in a row, blank lines left out.  Where it occurs at one place
only in all documents, nothing repeats, and a chunk ends between the two lines; where it occurs elsewhere too,
they belong to one chunk.  Boundaries so depend on nothing but the two lines beside them, and a passage of two
or more lines is cut alike wherever it stands, with its first and last line.  Every two lines of a chunk that
stand at an earlier place too (smaller id, then text hash, then place in the document) are removed, with the
blank lines between them.  So of a passage the first place stays, unless it is itself part of an earlier one;
every removed line is left somewhere.

Hashes only nominate lines: the bytes of all that share a hash are compared, and where they differ, places are
ordered anew by bytes.

A null text has no lines and stays null; a text without repeated lines stays as it is; a single repeated line
stays.  Documents that are equal keep one copy of their repeated lines between them; rows with the same id and
text are one document and lose the same lines.  Of lines repeated in a row, the first stays.  A null id comes
first.  Blank are lines of spaces, tabs and carriage returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.session import written

# Hashes at more than a HOT_SHARE-th of all places, and FEW, are broadcast: fewer than HOT_SHARE of some 100 bytes.
HOT_SHARE = 50_000
FEW = 100
BLANK = " \t\r"


def _hash_of(line: Column) -> Column:
    return F.xxhash64(line)


def _full_lines(lines: Column) -> Column:
    """``array<struct<place, hash>>`` of the lines that are not blank."""
    numbered = F.transform(
        lines,
        lambda line, place: F.struct(
            place.alias("place"), F.when(F.trim(line, F.lit(BLANK)) != "", _hash_of(line)).alias("hash")
        ),
    )
    return F.filter(numbered, lambda line: line.hash.isNotNull())


def _pairs(full: Column) -> Column:
    """``array<struct<place, lines, hash>>`` of every two lines in a row: the first one's place, how many lines
    they are with the blank ones between them, and the rolling hash."""
    n = F.greatest(F.size(full) - 1, F.lit(0))
    return F.zip_with(
        F.slice(full, F.lit(1), n),
        F.slice(full, F.lit(2), n),
        lambda one, two: F.struct(
            one.place.alias("place"),
            (two.place - one.place + 1).alias("lines"),
            F.xxhash64(one.hash, two.hash).alias("hash"),
        ),
    )


def _node() -> Column:
    return F.coalesce(F.md5("text"), F.lit("")).alias("node")


def _places(documents: DataFrame) -> DataFrame:
    """``doc_id, node, place, lines, hash`` of every two lines in a row; ``node`` is the md5 of the text."""
    # One step at a time, so that no expression is computed again for each of its uses.
    full = documents.filter("text IS NOT NULL").select(
        "doc_id", _node(), _full_lines(F.split("text", "\n")).alias("full")
    )
    return full.select("doc_id", "node", F.inline(_pairs(F.col("full"))))


def _here() -> Column:
    return F.struct("doc_id", "node", "place")


def _nominated(places: DataFrame) -> DataFrame:
    """The places whose hash occurs at other places too, with ``again``: whether there is an earlier one."""
    by_hash = written(
        places.groupBy("hash")
        .agg(F.min(_here()).alias("first"), F.max(_here()).alias("last"), F.count(F.lit(1)).alias("n"))
        .filter(~F.col("first").eqNullSafe(F.col("last")))
        .select("hash", "first", "n"),
        "repeated_lines",
    )
    # Fewer than HOT_SHARE hashes can each have more than that share of all places.
    share = places.count() // HOT_SHARE
    hot = by_hash.filter(F.col("n") > share + FEW).drop("n")
    others = by_hash.filter(F.col("n") <= share + FEW).drop("n")
    hot_rows = places.join(F.broadcast(hot), "hash")
    other_rows = places.join(F.broadcast(hot.select("hash")), "hash", "left_anti").join(others, "hash")
    return hot_rows.unionByName(other_rows).select(
        "doc_id", "node", "place", "lines", "hash", (~_here().eqNullSafe(F.col("first"))).alias("again")
    )


def _by_document(nominated: DataFrame) -> DataFrame:
    """``own_id, own_node, spans``: the nominated places of each document in order."""
    return nominated.groupBy(F.col("doc_id").alias("own_id"), F.col("node").alias("own_node")).agg(
        F.sort_array(F.collect_set(F.struct("place", "lines", "hash", "again"))).alias("spans")
    )


def _same_document() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("node") == F.col("own_node"))


def _without_clashes(met: DataFrame) -> DataFrame:
    """``met`` with ``again`` set by bytes where lines that differ share a hash."""

    def with_bytes(span: Column) -> Column:
        last = F.get("lines", span.place + span.lines - 1)
        return F.struct(
            span.place.alias("place"),
            span.hash.alias("hash"),
            F.concat(F.get("lines", span.place), F.lit("\n"), last).alias("chunk"),
        )

    compared = met.filter("spans IS NOT NULL").select("doc_id", "node", F.inline(F.transform("spans", with_bytes)))
    clashes = written(
        compared.groupBy("hash")
        .agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
        .filter("least <> most")
        .select("hash"),
        "clashing_lines",
    )
    if clashes.isEmpty():
        return met
    clashing = compared.join(clashes, "hash", "left_semi")
    first = clashing.groupBy("chunk").agg(F.min(_here()).alias("first"))
    changed = (
        clashing.join(first, "chunk")
        .groupBy(F.col("doc_id").alias("own_id"), F.col("node").alias("own_node"))
        .agg(
            F.collect_set("place").alias("clashing"),
            F.collect_set(F.when(~_here().eqNullSafe(F.col("first")), F.col("place"))).alias("later"),
        )
    )
    return met.join(changed, _same_document(), "left").select(
        "doc_id", "node", "text", "lines",
        F.when(
            F.col("clashing").isNotNull(),
            F.transform(
                "spans",
                lambda span: span.withField(
                    "again",
                    F.when(F.array_contains("clashing", span.place), F.array_contains("later", span.place))
                    .otherwise(span.again),
                ),
            ),
        ).otherwise(F.col("spans")).alias("spans"),
    )


def without_repeated_chunks(documents: DataFrame) -> DataFrame:
    """``doc_id, text, n_lines, removed_chunks, removed_lines`` of every document.

    A removed chunk is a run of removed lines of which every two in a row stand at an earlier place.
    """
    wanted = written(_by_document(_nominated(written(_places(documents), "line_pairs"))), "line_places")
    # Whole texts meet their places once; what follows reads this table.
    met = written(
        documents.select("doc_id", "text", _node()).join(wanted, _same_document(), "left")
        .select("doc_id", "node", "text", "spans"),
        "texts_with_places",
    ).withColumn("lines", F.split("text", "\n"))
    gone = F.filter("spans", lambda span: span.again)
    found = _without_clashes(met).withColumn("gone", F.when(F.exists("spans", lambda span: span.again), gone))
    places = F.array_distinct(
        F.flatten(F.transform("gone", lambda span: F.sequence(span.place, span.place + span.lines - 1)))
    )
    # Two lines go on with a chunk if they begin where the two before them end.
    ends = F.transform("gone", lambda span: span.place + span.lines - 1)
    starts = F.transform("gone", lambda span: span.place)
    found = found.withColumns({"places": places, "begins": F.size(F.array_except(starts, ends))})
    # Places that stay are a difference of two sets of numbers; lines are picked by them.
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("places"))
    left = F.array_join(F.transform(stay, lambda place: F.get("lines", place)), "\n")
    return found.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.col("begins")).cast("long").alias("removed_chunks"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("places")).cast("long").alias("removed_lines"),
    )
