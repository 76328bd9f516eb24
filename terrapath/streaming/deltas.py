"""The reduced stream of nodes as a stateful stream: a reference is sent only where it differs from the row before of its search."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROWS = "search_id long, pos long, ref long"
OUT = "search_id long, pos long, ref long, first boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Within it, streams that start keep their state in RocksDB, which states with timers need; afterwards the session is as before."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class LastReference(StatefulProcessor):
    """Keeps each search's last reference. A search that is silent for ``quiet_ms`` is forgotten; what comes later begins anew."""

    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ref long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001  Spark's names
        batch = pd.concat(list(rows)).sort_values("pos", kind="stable")
        refs = batch["ref"].astype("Int64").reset_index(drop=True)
        before = refs.shift(1)
        began = not self.last.exists()
        if not began:
            kept = self.last.get()[0]
            before.iloc[0] = pd.NA if kept is None else kept
        same = (refs == before).fillna(False) | (refs.isna() & before.isna())
        if began:
            same.iloc[0] = False
        last = refs.iloc[-1]
        self.last.update((None if pd.isna(last) else int(last),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        first = [began and i == 0 for i in range(len(batch))]
        yield pd.DataFrame({"search_id": [key[0]] * len(batch), "pos": batch["pos"].to_numpy(), "ref": refs.mask(same), "first": first})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def delta_stream(rows: DataFrame, quiet_seconds: float = 3_600.0) -> DataFrame:
    """(search_id, pos, ref, first) of a stream ``rows`` (search_id, pos, ref): ref is null where it equals that of the search's row before.

    Positions of a search grow from batch to batch; inside a batch rows come in any order, and a batch's rows of one search are held together. The rows that
    come out don't depend on how the stream is cut into batches. A ref that is null stays null. Start the query within ``state_on_disk``.
    """
    return rows.groupBy("search_id").transformWithStateInPandas(LastReference(int(quiet_seconds * 1000)), OUT, "append", "processingTime")
