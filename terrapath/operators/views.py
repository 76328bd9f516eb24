"""Map views of a session: which need a search of their own, and which the places found before answer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial import EDGES as _EDGES
from .spatial import box_counts

#: Least zoom at which places are shown, and the number of places from which an answer isn't used for a smaller view (fixed values).
LEAST_ZOOM, MANY = 10, 100
_DECIDED = "session string, box_id long, action string, from_box long"


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted views, one after the other: the last search of the session is all that is kept, also from batch to batch."""
    session, loaded, shown = object(), None, 0
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("session", "box_id", "zoom", "n", *_EDGES)]
        out: list[tuple[str, int | None]] = []
        for of, box, zoom, n, s, w, north, e in zip(*cols, strict=True):
            if of != session:
                session, loaded, shown = of, None, 0
            if zoom is None or zoom < LEAST_ZOOM:
                shown = 0
                out.append(("hide", None))
                continue
            inside = loaded is not None and None not in (s, w, north, e) and loaded[1] <= s and loaded[2] <= w and loaded[3] >= north and loaded[4] >= e
            if inside and 0 < shown < MANY:
                out.append(("reuse", loaded[0]))
                continue
            loaded, shown = (None if None in (s, w, north, e) else (box, s, w, north, e)), n
            out.append(("search", box))
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array([a for a, _ in out], pa.string()), pa.array([f for _, f in out], pa.int64())], names=["session", "box_id", "action", "from_box"]
        )


def plan_views(views: DataFrame, sites: DataFrame) -> DataFrame:
    """(session, box_id, action, from_box): what each view (session, ts, box_id, zoom, south, west, north, east) does.

    Below zoom 10, or without a zoom, the places are hidden. A view inside the last one that was searched for is answered by it (``reuse``), where that found
    at least one and fewer than a hundred places and nothing was hidden since; else it is searched for. A view that lacks an edge holds nothing and lies in
    nothing. Views of a session are taken in the order of (ts, box_id); ids tell views apart, and those without a session are one.

    The places of all views are counted by one box join of distinct views. A session is then read in order by one task, which keeps one view of it at a time.
    """
    box = views.select(*(F.col(x).cast("double").alias(x) for x in _EDGES))
    counts = box_counts(box.dropna(), sites)
    named = views.select(F.coalesce(F.col("session").cast("string"), F.lit("")).alias("session"), "ts", F.col("zoom").cast("int").alias("zoom"), *(F.col(c).cast(t).alias(c) for c, t in (("box_id", "long"), *((x, "double") for x in _EDGES))))
    counted = named.join(counts, list(_EDGES), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counted.repartition("session").sortWithinPartitions("session", "ts", "box_id").mapInArrow(_decide, _DECIDED)
