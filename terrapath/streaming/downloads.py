"""Downloads as a stream of events: records, tiles and their status, written so that a batch may come twice or break off anywhere.

What a batch adds is a set of partial aggregates (least request, last start, last error, counts), which combine in any order. A batch writes them
to folders of its own number and then puts down a mark; only marked batches are read. So a batch that broke off is overwritten when it comes again, one
that comes again after its mark is left out, and no table is ever seen without the others. ``compact`` combines the batches so far into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.progress import STALE_MINUTES
from ..operators.tiles import LEAST_BLOB

#: kind is one of request (with urls and grid), height_map, sites (n of them), tile (url, bytes), error, retry.
EVENTS = "event_id long, ts timestamp, download_id long, kind string, urls array<string>, grid double, url string, bytes long, n long, error string"
_AT = "struct<ts:timestamp,event_id:bigint>"
_RECORD = f"download_id long, requested struct<at:{_AT},grid:double>, started {_AT}, failed struct<at:{_AT},error:string>, attempts long, height_map boolean, sites struct<at:{_AT},n:bigint>, updated timestamp"
TABLES = {"records": _RECORD, "wanted": "download_id long, url string", "tiles": f"download_id long, url string, stored struct<at:{_AT},bytes:bigint>"}


def partials(events: DataFrame) -> dict[str, DataFrame]:
    """What ``events`` add to each table; an event that is there twice counts once."""
    e = events.dropDuplicates(["event_id"]).withColumn("at", F.struct("ts", "event_id"))

    def when(value: Column, *kinds: str) -> Column:
        return F.when(F.col("kind").isin(*kinds), value)

    records = e.groupBy("download_id").agg(
        F.min(when(F.struct("at", "grid"), "request")).alias("requested"), F.max(when(F.col("at"), "request", "retry")).alias("started"), F.max(when(F.struct("at", "error"), "error")).alias("failed"),
        F.count(when(F.lit(1), "request", "retry")).alias("attempts"), F.max(F.col("kind") == "height_map").alias("height_map"), F.max(when(F.struct("at", "n"), "sites")).alias("sites"), F.max("ts").alias("updated"),
    )
    wanted = e.filter("kind = 'request'").select("download_id", F.explode("urls").alias("url")).distinct()
    sound = e.filter(F.col("kind").eqNullSafe("tile") & (F.col("bytes") >= LEAST_BLOB))
    tiles = sound.groupBy("download_id", "url").agg(F.max(F.struct("at", "bytes")).alias("stored"))
    return {"records": records, "wanted": wanted, "tiles": tiles}


def combined(parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Partial aggregates of several batches as one."""
    records = parts["records"].groupBy("download_id").agg(
        F.min("requested").alias("requested"), *(F.max(c).alias(c) for c in ("started", "failed")), F.sum("attempts").alias("attempts"), *(F.max(c).alias(c) for c in ("height_map", "sites", "updated"))
    )
    tiles = parts["tiles"].groupBy("download_id", "url").agg(F.max("stored").alias("stored"))
    return {"records": records, "wanted": parts["wanted"].distinct(), "tiles": tiles}


def statuses(tables: dict[str, DataFrame], now: Column) -> DataFrame:
    """(download_id, status, attempts, n_wanted, n_stored, n_bytes, n_sites, last_error) of every download.

    An error after the last start (the request or a retry) fails it. It is complete when height map, sites and all tiles that it wants are stored, by whichever attempt;
    a tile of under 1,000 bytes isn't. Else it is pending, and fails when nothing has come for ten minutes.
    """
    stored = tables["wanted"].join(tables["tiles"], ["download_id", "url"], "left")
    counts = stored.groupBy("download_id").agg(F.count("*").alias("n_wanted"), F.count("stored").alias("n_stored"), F.sum("stored.bytes").alias("n_bytes"))
    r = tables["records"].join(counts, "download_id", "left").fillna(0, ["n_wanted", "n_stored", "n_bytes"])
    failed = F.coalesce(F.col("failed.at") > F.col("started"), F.col("failed").isNotNull())
    full = F.col("requested").isNotNull() & F.col("height_map") & F.col("sites").isNotNull() & (F.col("n_stored") >= F.col("n_wanted"))
    stale = F.col("updated") < now - F.expr(f"INTERVAL {STALE_MINUTES} MINUTES")
    status = F.when(failed, "failed").when(full, "complete").when(stale, "failed").otherwise("pending")
    error = F.when(failed, F.col("failed.error")).when(~full & stale, "stalled")
    return r.select("download_id", status.alias("status"), "attempts", "n_wanted", "n_stored", "n_bytes", F.coalesce("sites.n", F.lit(0)).alias("n_sites"), error.alias("last_error"))


class Store:
    """The tables of all batches below one path of a file system that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _marks(self) -> list[tuple[int, bool]]:
        """Marked batches and whether each holds all before it."""
        top = self.hadoop.Path(f"{self.path}/marks")
        names = [f.getPath().getName() for f in self.fs.listStatus(top)] if self.fs.exists(top) else []
        return sorted((int(n.split("-")[0]), n.endswith("-whole")) for n in names if n[0].isdigit())

    def _mark(self, number: int, whole: bool) -> None:
        self.fs.create(self.hadoop.Path(f"{self.path}/marks/{number:012d}-{'whole' if whole else 'part'}"), True).close()

    def last(self) -> int:
        return max((n for n, _ in self._marks()), default=-1)

    def _folder(self, name: str, number: int, whole: bool) -> str:
        return f"{self.path}/{name}/{number:012d}-{'whole' if whole else 'part'}"

    def tables(self) -> dict[str, DataFrame]:
        """The tables as of the last marked batch."""
        marks = self._marks()
        base = max((n for n, whole in marks if whole), default=-1)
        used = [(n, whole) for n, whole in marks if whole and n == base or not whole and n > base]

        def read(name: str, schema: str) -> DataFrame:
            return self.spark.read.schema(schema).parquet(*(self._folder(name, *m) for m in used)) if used else self.spark.createDataFrame([], schema)

        return combined({name: read(name, schema) for name, schema in TABLES.items()})

    def add(self, events: DataFrame, number: int) -> bool:
        """Adds a batch, unless one of this number or a later one is marked already. Events of batches before aren't to come again under another number."""
        if number <= self.last():
            return False
        parts = partials(events)
        for name in TABLES:
            self._write(parts[name], name, number, False)
        self._mark(number, False)
        return True

    def _write(self, table: DataFrame, name: str, number: int, whole: bool) -> None:
        table.write.mode("overwrite").parquet(self._folder(name, number, whole))

    def compact(self) -> None:
        """Combines the batches so far, so that a read takes one folder a table and those of later batches."""
        number = self.last()
        if number < 0 or (number, True) in self._marks():
            return
        whole = self.tables()
        for name in TABLES:
            self._write(whole[name], name, number, True)
        self._mark(number, True)


def follow(events: DataFrame, store: Store, checkpoint: str, compact_every: int = 50) -> StreamingQuery:
    """A stream of events into the store; every so many batches they are combined."""

    def batch(df: DataFrame, number: int) -> None:
        store.add(df, number)
        if number % compact_every == compact_every - 1:
            store.compact()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
