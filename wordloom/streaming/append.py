"""Texts that arrive over time, appended to a stored index."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from wordloom.sources.index import append_index, remove, text_batches


def stream_index(
    texts: DataFrame, index_path: str, checkpoint: str, on_duplicate: str = "skip", **trigger
) -> StreamingQuery:
    """Index a stream of texts (``text_id``, ``text``), one index batch per micro-batch.

    The checkpoint decides which input a batch has, and a batch that runs again after a failure replaces its
    own first attempt, so every text is indexed once.  By default the query ends when all input present
    is indexed; give ``processingTime="1 minute"`` to keep it running.  Refresh the document frequency when
    the new words are to count.

    With ``on_duplicate="skip"`` the first text of an id is taken, of those in one micro-batch any.  The ids that
    the stream has seen are Spark's state, which the checkpoint keeps, so a micro-batch looks at no batch of the
    stream itself, however many there are; only batches that others had written when the stream was started are
    looked at.  For more ids than fit into memory use the state store of RocksDB
    (``spark.sql.streaming.stateStore.providerClass``).  ``"error"`` looks at all batches each time.
    """

    # A checkpoint is one stream: its batches keep their names when they run again, and never take the
    # name of a batch of another stream.
    stream = hashlib.md5(checkpoint.encode()).hexdigest()
    spark = texts.sparkSession
    texts, others = texts.select("text_id", "text"), None
    if on_duplicate == "skip":
        texts = texts.dropDuplicates(["text_id"])
        names = text_batches(spark, index_path)
        others = [name for name in names if not name.startswith(f"{stream}-")]

    def append(batch: DataFrame, batch_id: int) -> None:
        # A micro-batch reads its files and meets the state again in every job over it, and its session runs without
        # adaptive execution, which cuts the bins of postings into as many files as there are tasks.  So it is stored
        # once and indexed by the session of the caller.
        name = f"{stream}-{batch_id}"
        kept = f"{index_path}/incoming/{name}"
        batch.write.mode("overwrite").parquet(kept)
        append_index(spark.read.schema(batch.schema).parquet(kept), index_path, name, on_duplicate, others)
        remove(spark, kept)

    return (
        texts.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
