"""Streams with state of their own: downloads that survive repeats and crashes, deltas that don't depend on the cut."""

import datetime
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from terrapath.streaming import deltas, downloads

NOW = datetime.datetime(2024, 1, 2)


def events(seed=1, n=400):
    r, at = random.Random(seed), datetime.datetime(2024, 1, 1, 12)
    rows = []
    for k in range(n):
        at += datetime.timedelta(seconds=r.choice([0, 5, 60, 300]))
        d, kind = r.randrange(25), r.choice(["request", "height_map", "sites", "tile", "tile", "tile", "tile", "error", "retry", "other"])
        urls = [f"t{i}" for i in range(r.randrange(4))] if kind == "request" else None
        rows.append((k, at, d, kind, urls, 50.0, f"t{r.randrange(4)}" if kind == "tile" else None, r.choice([10, 1_000, 5_000, None]), r.randrange(9), f"e{k}" if kind == "error" else None))
    return rows


def brute(rows, now=NOW):
    out = {}
    for d in {r[2] for r in rows}:
        mine = sorted((r for r in rows if r[2] == d), key=lambda r: (r[1], r[0]))
        wanted = {u for r in mine if r[3] == "request" for u in r[4]}
        tiles = {r[6]: r[7] for r in mine if r[3] == "tile" and (r[7] or 0) >= 1_000}
        failed, error = False, None
        for r in mine:
            if r[3] in ("request", "retry"):
                failed = False
            if r[3] == "error":
                failed, error = True, r[9]
        kinds = [r[3] for r in mine]
        full = "request" in kinds and "height_map" in kinds and "sites" in kinds and wanted <= set(tiles)
        stale = mine[-1][1] < now - datetime.timedelta(minutes=10)
        status = "failed" if failed else "complete" if full else "failed" if stale else "pending"
        sites = [r[8] for r in mine if r[3] == "sites"]
        out[d] = (status, kinds.count("request") + kinds.count("retry"), len(wanted), len(wanted & set(tiles)), sum(b for u, b in tiles.items() if u in wanted), sites[-1] if sites else 0, error if failed else None if full or not stale else "stalled")
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, downloads.EVENTS).repartition(2)


def found(store, now=NOW):
    return {r[0]: tuple(r)[1:] for r in downloads.statuses(store.tables(), F.lit(now).cast("timestamp")).collect()}


@pytest.fixture
def store(spark, tmp_path):
    return downloads.Store(spark, str(tmp_path / "store"))


def test_statuses_of_one_batch(spark):
    rows = events()
    got = {r[0]: tuple(r)[1:] for r in downloads.statuses(downloads.combined(downloads.partials(frame(spark, rows + rows[:30]))), F.lit(NOW).cast("timestamp")).collect()}
    assert got == brute(rows) and {v[0] for v in got.values()} == {"failed", "complete"}
    soon = rows[-1][1] + datetime.timedelta(minutes=1)
    got = {r[0]: tuple(r)[1:] for r in downloads.statuses(downloads.combined(downloads.partials(frame(spark, rows))), F.lit(soon).cast("timestamp")).collect()}
    assert got == brute(rows, soon) and "pending" in {v[0] for v in got.values()}


def test_batches_that_come_twice_or_late_change_nothing(spark, store):
    rows = events(2, 200)
    cuts = [rows[:70], rows[70:75], [], rows[75:]]
    for k, part in enumerate(cuts):
        assert store.add(frame(spark, part), k)
        assert not store.add(frame(spark, part), k)
        if k == 2:
            assert not store.add(frame(spark, cuts[0]), 0)
            store.compact()
            store.compact()
            assert not store.add(frame(spark, part), k)
    assert found(store) == brute(rows)


@pytest.mark.parametrize("broken", ["wanted", "mark"])
def test_a_crash_between_two_writes(spark, store, monkeypatch, broken):
    rows = events(3, 120)
    assert store.add(frame(spark, rows[:60]), 0)
    write, mark = store._write, store._mark

    def crash(*args):
        raise OSError("gone")

    if broken == "mark":
        monkeypatch.setattr(store, "_mark", crash)
    else:
        monkeypatch.setattr(store, "_write", lambda t, name, *rest: crash() if name == broken else write(t, name, *rest))
    with pytest.raises(OSError):
        store.add(frame(spark, rows[60:]), 1)
    assert found(store) == brute(rows[:60])  # nothing of the batch is seen
    monkeypatch.setattr(store, "_write", write)
    monkeypatch.setattr(store, "_mark", mark)
    assert store.add(frame(spark, rows[60:]), 1)
    assert found(store) == brute(rows)


def test_the_stream_replays_its_last_batch(spark, store, tmp_path):
    rows = events(4, 120)
    for k in range(3):
        frame(spark, rows[40 * k : 40 * k + 40]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.01)
    stream = lambda: spark.readStream.schema(downloads.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    downloads.follow(stream(), store, str(tmp_path / "checkpoint"), compact_every=2).awaitTermination()
    assert found(store) == brute(rows) and store.last() == 2
    for name in ("2", ".2.crc"):  # as if the driver had gone before the batch was committed
        os.remove(tmp_path / "checkpoint" / "commits" / name)
    downloads.follow(stream(), store, str(tmp_path / "checkpoint")).awaitTermination()
    assert found(store) == brute(rows) and store.last() == 2


def node_rows(seed, n=300):
    r, at = random.Random(seed), dict.fromkeys(range(5), 0)
    rows = []
    for _ in range(n):
        s = r.randrange(5)
        at[s] += r.randint(1, 3)
        rows.append((s, at[s], r.choice([1, 1, 1, 2, None])))
    return rows


def reduced(rows):
    out, last = [], {}
    for s, pos, ref in rows:
        out.append((s, pos, None if s in last and last[s] == ref else ref, s not in last))
        last[s] = ref
    return sorted(out, key=str)


@pytest.fixture
def ends_with_its_data(spark):
    """Else a stream with timers goes on for them when its data are through."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


@pytest.mark.usefixtures("ends_with_its_data")
@pytest.mark.parametrize("cuts", [3])
def test_deltas_do_not_depend_on_the_cut(spark, tmp_path, cuts):
    rows = node_rows(cuts)
    ends = sorted(random.Random(cuts).sample(range(1, len(rows)), cuts - 1)) + [len(rows)]
    begin = 0
    for end in ends:
        part = rows[begin:end]
        random.Random(end).shuffle(part)
        spark.createDataFrame(part, deltas.ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        begin = end
        time.sleep(0.01)
    stream = spark.readStream.schema(deltas.ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with deltas.state_on_disk(spark):
        deltas.delta_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str) == reduced(rows)


@pytest.mark.usefixtures("ends_with_its_data")
def test_a_silent_search_is_forgotten(spark, tmp_path):
    def put(rows):
        spark.createDataFrame(rows, deltas.ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put([(1, 1, 7), (1, 2, 7)])
    stream = spark.readStream.schema(deltas.ROWS).parquet(str(tmp_path / "in"))
    with deltas.state_on_disk(spark):
        for rows in (None, [(2, 1, 9)], [(1, 3, 7)]):  # the second batch finds the first's search silent
            if rows:
                time.sleep(1.2)
                put(rows)
            deltas.delta_stream(stream, 1.0).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination(60)
    got = {(r["search_id"], r["pos"]): (r["ref"], r["first"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 1): (7, True), (1, 2): (None, False), (2, 1): (9, True), (1, 3): (7, True)}
