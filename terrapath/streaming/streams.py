"""Structured Streaming forms: query answers, download progress, windows and sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import textsearch

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
#: Seconds without progress after which a download counts as stalled (a fixed value).
STALL_SECONDS = 8


def event_stream(spark: SparkSession, path: str, files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def answer_queries(queries: DataFrame, names: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Every micro-batch of typed queries (query) joined with the names; ``write`` takes the answers."""

    def batch(df: DataFrame, number: int) -> None:
        write(textsearch.best_matches(names, df.filter(F.length("query") >= 3)), number)

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, length: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Events per window and type; what comes later than the watermark is left out."""
    w = F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events per user and session: a session ends where the gap is as long."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("w.start", "w.end", "user_id", "n")


def without_repeats(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def progress(events: DataFrame, total: float | None = None, failure: str | None = None, stall_seconds: float = STALL_SECONDS) -> DataFrame:
    """(user_id, done, status) per download and batch: the greatest value so far, no more than ``total``.

    A download is complete at its total, failed by an event of the type ``failure``, and stalled after some seconds of
    silence; each of these ends it, and a later event begins anew.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, status = state.get[0] if state.exists else 0.0, "running"
        if state.hasTimedOut:
            status = "stalled"
        else:
            for b in batches:
                done = max(done, float(b["value"].max()))
                status = "failed" if failure is not None and (b["event_type"] == failure).any() else status
            if total is not None and done >= total:
                done, status = total, "complete" if status == "running" else status
        if status == "running":
            state.update((done,))
            state.setTimeoutDuration(int(stall_seconds * 1000))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"user_id": [key[0]], "done": [done], "status": [status]})

    keyed = events.select("user_id", "value", "event_type")
    return keyed.groupBy("user_id").applyInPandasWithState(update, "user_id long, done double, status string", "done double", "update", GroupStateTimeout.ProcessingTimeTimeout)
