"""Streams: counters, deduplication and keyed state as Structured Streaming plans.

State is bounded by watermarks. Limiters and job machines, which need a key's
events in order, are in ``ordered``; sinks of one row a key, for which a batch that
is run again changes nothing, in ``keyed``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.streaming.ordered import LATENESS, STATE_STORE



def timed(events: DataFrame, ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """``events`` with a watermark; times without a zone are read in the session's."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def tumbling_counts(events: DataFrame, key: Sequence[str], ts: str = "ts", width: str = "1 minute", lateness: str = LATENESS) -> DataFrame:
    """(key, start, n): events per key and clock window; windows close when the watermark has passed."""
    counted = timed(events, ts, lateness).groupBy(F.window(ts, width).alias("w"), *key).agg(F.count("*").alias("n"))
    return counted.select(*key, F.col("w.start").alias("start"), "n")


def sliding_stats(events: DataFrame, key: Sequence[str], value: str, ts: str = "ts", width: str = "10 minutes", step: str = "5 minutes", lateness: str = LATENESS) -> DataFrame:
    """An extension: count and mean per sliding window."""
    rows = timed(events, ts, lateness).groupBy(F.window(ts, width, step).alias("w"), *key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return rows.select(*key, F.col("w.start").alias("start"), "n", "mean")


def session_windows(events: DataFrame, key: Sequence[str], ts: str = "ts", gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """An extension: sessions of events with no longer gap between them."""
    rows = timed(events, ts, lateness).groupBy(F.session_window(ts, gap).alias("w"), *key).agg(F.count("*").alias("n"))
    return rows.select(*key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def first_by_key(rows: DataFrame, keys: Sequence[str], ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """The first row of each key within the watermark; later repeats are dropped."""
    return timed(rows, ts, lateness).dropDuplicatesWithinWatermark(list(keys))


def last_by_key(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The last row of each key so far, for update mode."""
    names = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*names), order).alias("r")).select(*key, "r.*")


def memory_upserts(rows: DataFrame, key: Sequence[str] = ("session_id", "key")) -> DataFrame:
    """Keyed memory for update mode: last value, best confidence, whether ever confirmed."""
    return rows.groupBy(*key).agg(F.max_by("value", "updated_at").alias("value"), F.max("confidence").alias("confidence"), F.bool_or("confirmed").alias("confirmed"))


def run_available(stream: DataFrame, checkpoint: str, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None, path: str | None = None, large_state: bool = False, **options: Any) -> None:
    """Take all that is there now, then stop: the form of queue workers, clean-up loops and batched embedding.

    ``large_state``: keep state beside the heap, as the operators of ``ordered``
    need; the session's own setting is as before when the stream has started.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).options(**options)
    writer = writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", path)
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    if large_state:
        conf.set(name, STATE_STORE)
    try:
        query = writer.start()
    finally:
        if large_state and before is None:
            conf.unset(name)
        elif large_state:
            conf.set(name, before)
    query.awaitTermination()
