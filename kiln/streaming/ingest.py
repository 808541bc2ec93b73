"""Streaming ingest: JSON lines arriving in a folder are added to a stored index, each id once, also over restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kiln.operators.store import Store
from kiln.sources.readers import ARTICLE

#: How long an id is remembered by the stream. Repeats that come later are found in the index itself.
REMEMBERED_MS = 24 * 3600 * 1000


def first_of_id(columns: list[str], ttl_ms: int):
    """Lets the first row of each id pass; an id is state until its time to live is over."""

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new = not state.exists
        state.update((True,))
        state.setTimeoutDuration(ttl_ms)
        for frame in rows:
            if new and len(frame):
                new = False
                yield frame.iloc[:1][columns]

    return run


def stream_documents(spark: SparkSession, folder: str, ttl_ms: int = REMEMBERED_MS) -> DataFrame:
    """Articles of files in folder with an id, the first of each; ids are remembered until none came for ttl_ms, so state
    is bounded by what comes in that time."""
    stream = spark.readStream.schema(ARTICLE).json(folder).where("id is not null")
    return stream.groupBy("id").applyInPandasWithState(first_of_id(ARTICLE.fieldNames(), ttl_ms), ARTICLE, "seen boolean", "update", GroupStateTimeout.ProcessingTimeTimeout)


def ingest(stream: DataFrame, store: Store, checkpoint: str, id_col: str = "id", text_col: str | tuple[str, ...] = ("title", "content", "text"), source: str = "stream", merge_at: int = 8) -> StreamingQuery:
    """Each micro-batch is one version of the stored index; at merge_at small segments they are merged.

    The manifest of a version holds the number of the last batch of `source` that it has. A batch that is repeated after a
    failure, committed or not, is there once: before its manifest nothing of it is in the index, after it the repetition
    changes nothing. The index is opened anew from storage, so a query that goes on after a restart loses no batch.
    """

    def add(batch: DataFrame, number: int) -> None:
        here = Store.open(batch.sparkSession, store.path)
        batch = batch.persist()
        try:
            at, _ = here.add(batch, id_col, text_col, batch=(source, number))
        finally:
            batch.unpersist()
        if len(at.segments) >= merge_at:
            here.merge()

    # Ids are forgotten when data comes; batches without any, only to see whether time has passed, would go on for ever.
    key, conf = "spark.sql.streaming.noDataMicroBatches.enabled", stream.sparkSession.conf
    before = conf.get(key)
    conf.set(key, "false")
    try:
        return _started(stream, add, checkpoint)
    finally:
        conf.set(key, before)


def _started(stream: DataFrame, add, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
