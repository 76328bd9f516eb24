"""The size of the blocks changes nothing."""

import pytest

from terrapath.llm import decontam

from .conftest import frame, messy_rows


@pytest.mark.parametrize("max_block", [40, 2_000])
def test_blocks_scan_repeated_rows_and_ids_each(spark, max_block):
    rows = messy_rows()
    words = [" ".join(decontam.words_of(t)[k].decode() for k in range(25)) for _, t, *_ in rows if len(decontam.words_of(t)) >= 25][:5]
    rows += [(None, words[0], "en", "web", 0), (None, words[1], "en", "web", 0), (None, words[0], "en", "web", 0), (None, None, "en", "web", 0), (2, words[2], "en", "web", 0)]
    bench = spark.createDataFrame([*((f"i{k}", w) for k, w in enumerate(words)), ("tie", "TIE tie"), ("none", None)], "item_id string, text string")
    whole, parts = (
        sorted(map(repr, decontam.scan(frame(spark, rows), bench, max_block=b).select("doc_id", "n_words", "n_hit", "items", "spans").collect()))
        for b in (decontam.MAX_BLOCK_BYTES, max_block)
    )
    assert len(whole) == len(rows) and whole == parts
    assert sum("items=['i" in x or "items=['tie" in x for x in whole) > 8


def test_blocks_are_bounded_by_windows(spark):
    text = " ".join(f"w{i}" for i in range(500))
    bench = spark.createDataFrame([("a", text), ("b", text)], "item_id string, text string")
    blocks = list(decontam._blocks(bench, "item_id", decontam.WINDOW, 100 * (decontam.WINDOW_BYTES + decontam.ITEM_BYTES)))
    sizes = [sum(len(keys) for keys, _, _ in b.by_length.values()) for b, _ in blocks]
    assert sum(sizes) == 491 and len(sizes) == 5 == blocks[0][1] and max(sizes) < 200
    assert all(b.owners == [["a", "b"]] for b, _ in blocks)


def test_a_window_of_many_items_is_dealt_to_blocks(spark):
    shared = "one two three four five six seven eight nine ten"
    items = [(f"i{k:04}", f"{shared} w{k % 7}") for k in range(3_000)] + [(None, shared), ("i0000", shared)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    held = [len(set(own)) for b, _ in decontam._blocks(bench, "item_id", decontam.WINDOW, 4_000, most_items=100) for own in b.owners]
    assert len(held) > 20 and max(held) < 400
    docs = frame(spark, [(1, f"x {shared} y", "en", "web", 0), (2, "nothing here", "en", "web", 0), (3, None, "en", "web", 0)])
    whole, parts = ({r["doc_id"]: r for r in decontam.scan(docs, bench, max_block=b).collect()} for b in (decontam.MAX_BLOCK_BYTES, 4_000))
    assert whole == parts and [tuple(whole[k][1:3]) for k in (1, 2, 3)] == [(12, 10), (2, 0), (0, 0)]
    assert whole[1]["items"] == sorted(["None", *(f"i{k:04}" for k in range(3_000))])


def test_both_halves_of_a_row_key_stand_alone(spark):
    rows = spark.range(300).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    keys = rows.select(decontam.wide_key(rows).alias("k"), "text").collect()
    follows = spark.createDataFrame([(r["k"]["a"], r["k"]["b"]) for r in keys], "a long, b long").selectExpr("xxhash64(a) = b AS x", "xxhash64(1L, a) = b AS y", "a = b AS z").filter("x or y or z")
    assert follows.isEmpty() and len({r["k"]["b"] for r in keys}) == 300
