"""Quads from a stream into a store, and windowed counts over a stream.

The core has no stream of its own to read; any Structured Streaming source with
columns s, p, o, c serves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quadlake.functions.terms import legal_quad
from quadlake.store import QuadStore


def ingest(stream: DataFrame, store: QuadStore, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Add every micro-batch to the store in one commit.

    A batch that is run again after a failure adds nothing new, because quads
    are a set. Rows that are no quads are passed over.
    """

    def add(batch: DataFrame, _: int) -> None:
        with store.connect() as c:
            c.add_all(batch.select("s", "p", "o", "c").where(F.coalesce(legal_quad(), F.lit(False))))

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows the watermark has dropped, over the batches whose progress is kept."""
    return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)


def newest_rates(updates: DataFrame) -> DataFrame:
    """The table of rates after a stream in update mode whose batches were kept
    with their number (batch): the newest row of every window and predicate."""
    return updates.groupBy("start", "end", "p").agg(F.max_by("n", "batch").alias("n"))


def predicate_rates(stream: DataFrame, time: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows per predicate and window of event time; rows later than ``late``
    behind the newest are dropped by the watermark (see late_rows). In update mode
    a window leaves the state once it is that old. Also works on a table."""
    rows = stream.withColumn("_t", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("_t", late) if stream.isStreaming else rows
    return rows.groupBy(F.window("_t", window).alias("w"), "p").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "p", "n")
