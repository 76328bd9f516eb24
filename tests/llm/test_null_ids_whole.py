"""Without ids, the operators that judge each row by its text give what they give with ids."""

from itertools import groupby

from terrapath.llm import byte_bpe, sharding, suffixes, token_store, unigram

from .conftest import frame
from .test_null_ids import as_rows, prose


def pairs(with_ids):
    shared = prose(3, 120)
    texts = [shared, shared, f"{prose(1)} {shared} {prose(2)}", prose(4), None, "", "one", "one", prose(5) + " ௧ꟛ's"]
    return [(k if with_ids else None, t) for k, t in enumerate(texts)]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_rows_without_ids_count_encode_and_lose_spans_alike(spark):
    named, nameless = (frame(spark, as_rows(pairs(x))) for x in (True, False))
    for apply, columns in (
        (unigram.count, ("n_chars", "n_tokens")),
        (lambda d: byte_bpe.digest(byte_bpe.encode(d)), ("n_tokens", "ids_sha256", "decoded_sha256")),
        (lambda d: suffixes.digest(suffixes.remove_repeats(d)), ("n_bytes", "n_removed", "n_spans", "kept_sha256")),
    ):
        want = rows_of(apply(named), *columns)
        assert rows_of(apply(nameless), *columns) == want and len(want) == 9
        assert {r["doc_id"] for r in apply(nameless).collect()} == {None}


def test_the_token_store_and_shards_hold_every_row_without_ids(spark):
    named, nameless = (frame(spark, as_rows(pairs(x))) for x in (True, False))
    found = token_store.round_trip(nameless).collect()
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in found) == sorted((r["n_tokens"], r["ids_crc32"]) for r in token_store.round_trip(named).collect())
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):  # no document is empty, as each ends with an id
        assert r["start"] == at
        at += r["n_tokens"]
    shards = sharding.shard(nameless).collect()
    assert sorted(((r["size"], r["text_crc32"]) for r in shards), key=str) == rows_of(sharding.shard(named), "size", "text_crc32")
    for _, mine in groupby(sorted(shards, key=lambda r: (r["shard"], r["slot"])), lambda r: r["shard"]):
        slots = [r["slot"] for r in mine]
        assert slots == list(range(len(slots)))
