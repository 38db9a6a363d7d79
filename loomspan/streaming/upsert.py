"""Streaming upsert: each micro-batch of new rows is merged into a corpus of change files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans import store


def merge_stream(new: DataFrame, corpus: str, checkpoint: str, today: str, buckets: int = 64, compact_after: int = 8, keep: int = 2) -> StreamingQuery:
    """Merge every micro-batch into the store ``corpus`` (or the plain table ``corpus/v=0``, which becomes a store first).

    A batch reads and writes the buckets of its keys alone. One that is run again after a failure was either committed, and is
    skipped, or was not, and overwrites its own files: recovery gives the same corpus.
    """
    store.opened(new.sparkSession, corpus, buckets)

    def step(batch: DataFrame, number: int) -> None:
        store.upsert(batch.sparkSession, corpus, batch, today, source=checkpoint, batch=number, compact_after=compact_after, keep=keep)

    return new.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, corpus: str) -> DataFrame:
    store.opened(spark, corpus)
    return store.read(spark, corpus)
