"""Consecutive numbers for the rows of a table of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wordloom.session import written

# A partition holds at most 2^33 rows in the ids Spark gives out.
_ROWS_BITS = 33


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(field.dataType) for field in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def numbered(frame: DataFrame, order: Sequence[str], number: str, start: int = 0) -> DataFrame:
    """Rows with consecutive numbers in the order of ``order``, NULLs first; no global window.

    Rows are cut into ranges and counted per range.  The ranges are written once: if they were computed
    again, Spark might cut them in another way.  Rows that are equal in ``order`` are ordered by a hash of
    their other columns; rows that are equal in all share their numbers in any way, which shows in no
    result, so they are spread over ranges too.

    Spark cuts ranges by a sample that the driver holds.  It has the columns of ``order`` and three numbers
    of each row sampled; what the other columns hold never gets there.
    """
    others = [field for field in frame.schema.fields if field.name not in order]
    hashed = [F.col(f"`{field.name}`") for field in others if _hashable(field.dataType)]
    # Two hashes with different beginnings; a null does not change a hash, so it is one more value.
    nulls = [column.isNull() for column in hashed]
    ties = {
        "__hash": F.xxhash64(F.lit(1), *hashed, *nulls),
        "__more": F.xxhash64(F.lit(2), *hashed, *nulls),
        "__spread": F.xxhash64(F.monotonically_increasing_id()),
    }
    keys = [F.col(f"`{name}`") for name in [*order, *ties]]
    ranges = written(
        frame.withColumns(ties)
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop(*ties)
        .withColumn(number, F.monotonically_increasing_id()),
        "numbered",
    )
    part = F.shiftright(number, _ROWS_BITS)
    # One row per partition, so the only window without a key stays as small as their number.
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        ranges.groupBy(part.alias("__part"))
        .agg(F.count(F.lit(1)).alias("__rows"))
        .select("__part", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"))
    )
    place = F.col("__before") + F.col(number).bitwiseAND(2**_ROWS_BITS - 1) + start
    return (
        ranges.withColumn("__part", part)
        .join(F.broadcast(parts), "__part")
        .select(*[f"`{name}`" for name in frame.columns], place.alias(number))
    )
