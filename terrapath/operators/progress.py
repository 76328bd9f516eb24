"""Jobs, downloads and events: status, progress, throttling and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STALE_MINUTES = 10
STEP_PERCENT = 5


def _ordered(by: str) -> Window:
    return Window.partitionBy(by).orderBy("ts", "event_id")


def reconcile(jobs: DataFrame, now: Column) -> DataFrame:
    """A pending job without an update for ten minutes has failed."""
    stale = (F.col("status") == "pending") & (F.col("updated_at") < now - F.expr(f"INTERVAL {STALE_MINUTES} MINUTES"))
    return jobs.withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def settle(jobs: DataFrame, wanted: DataFrame, stored: DataFrame, job: str, keys: list[str], now: Column) -> DataFrame:
    """``jobs`` with what they want, what of it is stored (never more than that), and their status.

    A pending job is complete when all it wants is stored, whoever stored it; else it has failed if it is stale. A job that
    wants nothing is complete.
    """
    have = wanted.select(job, *keys).distinct().join(stored.select(*keys).distinct().withColumn("here", F.lit(1)), keys, "left")
    counts = have.groupBy(job).agg(F.count("*").alias("n_wanted"), F.count("here").alias("n_stored"))
    joined = jobs.join(counts, job, "left").fillna(0, ["n_wanted", "n_stored"])
    full = (F.col("status") == "pending") & (F.col("n_stored") >= F.col("n_wanted"))
    return reconcile(joined.withColumn("status", F.when(full, "complete").otherwise(F.col("status"))), now)


def latest(events: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """The last row per key: one partial aggregate instead of a sort of each key's rows."""
    last = events.groupBy(by).agg(F.max_by(F.struct(*columns), F.struct("ts", "event_id")).alias("last"))
    return last.select(by, *(F.col(f"last.{c}").alias(c) for c in columns))


def running_max(events: DataFrame, by: str, value: str) -> DataFrame:
    return events.withColumn("so_far", F.max(value).over(_ordered(by).rowsBetween(Window.unboundedPreceding, 0)))


def clamped_progress(events: DataFrame, by: str) -> DataFrame:
    """``events`` (by, ts, event_id, total, records, bytes, bytes_total) with ``done``: what is done by then, never less than before and never more than the total.

    It is the greatest of the records, of the total's share that the bytes make up, and of what was done before; a row of unknown total bytes counts one more
    than before instead of the share. ``total`` is one number per download; without one it is 1.

    A row of unknown bytes adds 1 to what was done, so what is done less the number of such rows so far is a running maximum, and
    the clamp may come last: two windows instead of a fold over the rows of a download.
    """
    w = _ordered(by).rowsBetween(Window.unboundedPreceding, 0)
    known = F.coalesce(F.col("bytes_total") > 0, F.lit(False))
    total = F.greatest(F.coalesce(F.col("total"), F.lit(1)), F.lit(0)).cast("long")
    share = F.when(known, F.floor(total * F.coalesce(F.col("bytes"), F.lit(0)) / F.col("bytes_total") + 0.5)).otherwise(0)
    at = events.withColumn("__u", F.sum(F.when(known, 0).otherwise(1)).over(w))
    most = F.max(F.greatest(F.coalesce(F.col("records").cast("long"), F.lit(0)), share.cast("long")) - F.col("__u")).over(w)
    return at.withColumn("__m", most).withColumn("done", F.least(total, F.greatest(F.col("__m"), F.lit(0)) + F.col("__u")).cast("long")).drop("__u", "__m")


def step_changes(events: DataFrame, by: str, percent: str) -> DataFrame:
    """Rows at which the running percentage enters a new step of five."""
    df = running_max(events, by, percent).withColumn("step", F.floor(F.col("so_far") / STEP_PERCENT).cast("int"))
    return df.withColumn("before", F.lag("step").over(_ordered(by))).filter("before is null or step > before").drop("before")


def throttle(events: DataFrame, by: str, gap_seconds: float) -> DataFrame:
    """Rows that come at least so long after the row before."""
    before = F.lag("ts").over(_ordered(by))
    return events.withColumn("gap", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1e6).filter(F.col("gap").isNull() | (F.col("gap") >= gap_seconds)).drop("gap")


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``changes`` over ``current``: a full outer join that takes the new row where there is one."""
    a, b = current.alias("a"), changes.withColumn("_new", F.lit(True)).alias("b")
    joined = a.join(b, key, "full_outer")
    return joined.select(key, *(F.when(F.col("_new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in current.columns if c != key))


def delete(current: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return current.join(keys.select(key).distinct(), key, "left_anti")
