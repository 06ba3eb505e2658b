"""What the jobs need from the session: a shared folder, and the size limits behind every broadcast."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# At most this many rows are broadcast, counted before each broadcast (around 100 bytes a row).
BROADCAST_ROWS = 500_000

# At most this many word hashes or text ids become literals of a scan filter.
LITERALS = 200

# At most this many rows (a megabyte or two) are kept in the plan itself instead of in the shared folder.
LOCAL_ROWS = 10_000

# Rows sent to Python at once hold about so many bytes.
ARROW_BYTES = 8 << 20


def arrow_bounded(spark: SparkSession) -> None:
    """Bound Arrow batches by size, as texts may be very long; a setting of the session's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, str(2**31 - 1)):
        spark.conf.set(key, str(ARROW_BYTES))


@contextmanager
def smaller_partitions(spark: SparkSession, times: int) -> Iterator[None]:
    """Rows rebalanced by what runs inside come in partitions so many times smaller than the session asks for."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    asked = spark.conf.get(key)
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(asked)
    spark.conf.set(key, str(max(size // times, 1)))
    try:
        yield
    finally:
        spark.conf.set(key, asked)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one if none is named and all runs in one JVM."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="wordloom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def durable(frame: DataFrame) -> DataFrame:
    """The frame computed once and kept in the shared folder, where it outlives lost executors."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def written(frame: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The frame computed once, as a table in the shared folder; ``by`` names a column to have a folder for each value."""
    path = new_shared_path(frame.sparkSession, name)
    (frame.write.partitionBy(by) if by else frame.write).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def settled_rows(frame: DataFrame, rows: int = LOCAL_ROWS) -> tuple[DataFrame, bool]:
    """The frame computed once, and whether it is part of the plan: up to ``rows`` rows are, more are ``durable``."""
    table = frame.limit(rows + 1).toArrow()
    if table.num_rows > rows:
        return durable(frame), False
    return frame.sparkSession.createDataFrame(table, frame.schema), True


def settled(frame: DataFrame, rows: int = LOCAL_ROWS) -> DataFrame:
    """The frame computed once: up to ``rows`` rows become part of the plan, more are ``durable``."""
    return settled_rows(frame, rows)[0]


def spread(frame: DataFrame, column: str) -> DataFrame:
    """The frame over all cores of the cluster, if it comes in fewer parts than these.

    Only a small or unsplittable input is moved; counting its parts reads nothing but ``column``.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    parts = frame.select(column, F.spark_partition_id().alias("part")).agg(F.count_distinct("part"))
    return frame if parts.first()[0] >= cores else frame.repartition(cores)


def is_one_of(column: str, literals) -> str:
    """A condition with few values; each is an equality of its own, which prunes files and row groups.

    Spark turns a long ``IN`` into the span of its values, which for hashes is everything.
    """
    return " OR ".join(f"{column} = {literal}" for literal in literals) or "false"


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def no_rows(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return one_row(spark, schema).limit(0)


def one_row(spark: SparkSession, schema: str | T.StructType, **values) -> DataFrame:
    """A row of literals; columns without a value are NULL."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return spark.range(0, 1, 1, 1).select(
        [F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )
