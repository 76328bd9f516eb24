"""JSON documents that are made in pieces: no task holds a whole one, however many items it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from ..operators.spatial import EDGES, boxes_join
from ..shared import written

#: Cells along a side of the block whose nodes make up a piece.
BLOCK = 16
#: Places of an answer: default and greatest number (fixed values).
PLACES, MOST_PLACES = 200, 10_000
#: Bytes of texts that a reader of pieces holds at once.
GROUP_BYTES = 16 * 2**20
_TAIL = 2**31 - 1
_NULLS = {"ignoreNullFields": "false"}


def in_pieces(metas: DataFrame, items: DataFrame, key: str, name: str) -> DataFrame:
    """(key, piece, text): a document's texts, joined in the order of their pieces, are its JSON object, in which ``name`` is the array of its items.

    ``metas`` has a row per document: the key, and as other columns the object's members. ``items`` has (key, piece, pos, item): the caller's pieces
    bound how many items one holds, ``item`` is JSON, and the array is in the order of (piece, pos), pieces being numbers from 0. Items of a key
    without ``metas`` are left out; a document without items has an empty array.
    """
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]), ",")
    return _around(metas, items.groupBy(key, F.col("piece").cast("int").alias("piece")).agg(listed.alias("text")), key, [key], name)


def _around(metas: DataFrame, texts: DataFrame, key: str, by: list[str], name: str) -> DataFrame:
    """(key, piece, text): the documents of ``metas`` around ``texts`` (the columns ``by``, piece, text), which those of equal ``by`` share.

    Texts and the documents' beginnings are written, so that what makes them runs once; a text is moved once for all documents that share it.
    """
    members = F.to_json(F.struct(*(F.col(f"`{c}`") for c in metas.columns if c not in (key, *by))), _NULLS)
    opened = F.when(F.length(members) > 2, F.concat(F.substring(members, F.lit(1), F.length(members) - 1), F.lit(","))).otherwise("{")
    heads = written(metas.select(*dict.fromkeys((key, *by)), F.concat(opened, F.lit(f'"{name}":[')).alias("text")), "heads")
    made = written(texts, "pieces", GROUP_BYTES)
    first = made.groupBy(*by).agg(F.min("piece").alias("first"))
    documents = heads.drop("text").join(first.hint("merge"), by)
    comma = F.when(F.col("piece") > F.col("first"), ",").otherwise("")
    body = made.join(documents.hint("merge"), by).select(key, "piece", F.concat(comma, "text").alias("text"))
    ends = F.array(F.struct(F.lit(-1).alias("piece"), "text"), F.struct(F.lit(_TAIL).alias("piece"), F.lit("]}").alias("text")))
    return heads.select(key, F.explode(ends).alias("x")).select(key, "x.piece", "x.text").unionByName(body)


def write_pieces(pieces: DataFrame, key: str, path: str) -> None:
    """The documents as files of text whose names are in the order of the keys: a line per piece, those of a document following each other."""
    pieces.repartitionByRange(key, "piece").sortWithinPartitions(key, "piece").select("text").write.mode("overwrite").text(path)


def _pair(a, b) -> Column:
    return F.array(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def cone_pieces(metas: DataFrame, nodes: DataFrame) -> DataFrame:
    """(request_id, piece, text): the cone of each request, as ``requests.cones`` gives it, with metadata and nodes.

    A node has its index, whole metres of height and distance (both cut), the reference's index or null, and whole metres above ground. Nodes
    become text after they were gathered to pieces, once for all requests of a search.
    """
    search = ["batch", "search_id"]
    members = metas.select(
        "request_id", *search, "cell_size", "min_cell_size", F.col("angular_resolution"), _pair("south", "north").alias("lat"), _pair("west", "east").alias("lon"),
        _pair("start_r", "start_c").alias("start_ix"), _pair("rows", "cols").alias("grid_shape"), "start_height",
    )
    whole = F.col("height").cast("int")
    block = F.floor(F.col("r") / BLOCK) * 32_768 + F.floor(F.col("c") / BLOCK)
    listed = F.array_sort(F.collect_list(F.struct("r", "c", whole.alias("height"), F.col("dist").cast("int").alias("dist"), "ref_r", "ref_c", (whole - F.col("ground").cast("int")).alias("agl"))))

    def node(x: Column) -> Column:
        reference = F.when(x["ref_r"].isNotNull(), _pair(x["ref_r"], x["ref_c"]))
        return F.struct(_pair(x["r"], x["c"]).alias("index"), x["height"].alias("height"), x["dist"].alias("distance"), reference.alias("reference"), x["agl"].alias("agl"))

    text = F.btrim(F.to_json(F.transform(listed, node), _NULLS), F.lit("[]"))  # the nodes without the array's brackets
    return _around(members, nodes.groupBy(*search, block.cast("int").alias("piece")).agg(text.alias("text")), "request_id", search, "nodes")


def height_map_pieces(metas: DataFrame, heights: DataFrame) -> DataFrame:
    """(request_id, piece, text): each grid of ``requests.grid_metadata`` with its ``heights`` (request_id, r, c, h), a piece per row; null where a cell has no height."""
    members = metas.select(
        "request_id", "cell_size", "min_cell_size", _pair("south", "north").alias("lat"), _pair("west", "east").alias("lon"), _pair("start_r", "start_c").alias("start_ix"),
        _pair("rows", "cols").alias("grid_shape"), "start_height",
    )
    known = heights.groupBy("request_id", "r").agg(F.map_from_entries(F.collect_list(F.struct("c", "h"))).alias("of"))  # a row of a grid
    rows = metas.select("request_id", "cols", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r")).join(known, ["request_id", "r"], "left")
    line = F.to_json(F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda c: F.try_element_at("of", c)))
    return in_pieces(members, rows.select("request_id", F.col("r").alias("piece"), F.lit(0).alias("pos"), line.alias("item")), "request_id", "heights")


def place_documents(boxes: DataFrame, sites: DataFrame, limit: int | None = None) -> DataFrame:
    """(box_id, places): a JSON array of the sites (id, name, lon, lat, kind) in each box, nearest to its middle first.

    At most ``limit`` of them, which is held within 1 and 10,000, so a document is of a bounded size. A box without sites has an empty array.
    """
    most = max(1, min(MOST_PLACES, PLACES if limit is None else limit))
    metres = haversine_m((F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2, "lon", "lat")
    # Of the sites of one place no box shows more than the first ones; boxes of equal edges share a document.
    first = sites.withColumn("k", F.row_number().over(Window.partitionBy("lon", "lat").orderBy("id"))).filter(F.col("k") <= most).select("id", "name", "lon", "lat", "kind")
    near = boxes_join(boxes.select(*EDGES).distinct(), first).withColumn("metres", metres)
    kept = near.withColumn("k", F.row_number().over(Window.partitionBy(*EDGES).orderBy("metres", "id"))).filter(F.col("k") <= most)
    centre = _pair(F.round("lon", 3).cast("decimal(9,3)"), F.round("lat", 3).cast("decimal(9,3)"))
    place = F.struct("name", centre.alias("center"), F.col("kind").alias("additional_info"))
    listed = kept.groupBy(*EDGES).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("k", place.alias("p")))), lambda x: x["p"]), _NULLS).alias("places"))
    return boxes.select("box_id", *EDGES).distinct().join(listed, list(EDGES), "left").select("box_id", F.coalesce("places", F.lit("[]")).alias("places"))


def stats_document(stores: dict[str, DataFrame], counters: dict[str, DataFrame]) -> DataFrame:
    """(stats): one JSON object with ``<name>_cache_size`` and ``<name>_bytes`` of each store (its column ``size``), and ``num_<name>``, the rows of each counter."""
    sums = [df.agg(F.count("*").alias(f"{n}_cache_size"), F.coalesce(F.sum(F.col("size").cast("long")), F.lit(0).cast("long")).alias(f"{n}_bytes")) for n, df in stores.items()]
    sums += [df.agg(F.count("*").alias(f"num_{n}")) for n, df in counters.items()]
    one = sums[0]
    for s in sums[1:]:
        one = one.crossJoin(s)  # one row each
    return one.select(F.to_json(F.struct(*(F.col(c) for c in one.columns))).alias("stats"))
