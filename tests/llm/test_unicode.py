"""The split into pieces equals the library's for every code point; two hashes of a text are two."""

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from terrapath.llm import byte_bpe, sharding, suffixes, url_rules

from .conftest import frame


def test_every_code_point_splits_as_in_the_library(spark):
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    pattern = byte_bpe.split_pattern(spark, public_tokenizers.PATTERN)
    for shape in ("a{}'s1 ", "1{}2\n{} "):
        texts = ["".join(shape.replace("{}", c) + "|" for c in points[k : k + 5_000]) for k in range(0, len(points), 5_000)]
        rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("pieces")).collect()
        for r in rows:
            assert r["pieces"] == _cut(texts[r["k"]])


def _cut(text):
    """The pieces of the public pattern, by hand, with the library's classes."""
    letters, numbers, white = (byte_bpe.library_class(x) for x in (r"\p{L}", r"\p{N}", r"\s"))
    kind = ["L" if (p := ord(c)) in letters else "N" if p in numbers else "S" if p in white else "O" for c in text]
    out, i, n = [], 0, len(text)
    while i < n:
        short = next((x for x in ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d") if text.startswith(x, i)), None)
        if short:
            out.append(short)
            i += len(short)
            continue
        j = i + 1 if text[i] == " " and i + 1 < n and kind[i + 1] != "S" else i
        if kind[j] != "S":
            k = j
            while k < n and kind[k] == kind[j]:
                k += 1
        else:
            k = i
            while k < n and kind[k] == "S":
                k += 1
            if k < n and k - i > 1:
                k -= 1  # the last white space belongs to what follows
        out.append(text[i:k])
        i = k
    return out


def test_new_letters_are_encoded_as_in_the_library(spark):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(byte_bpe.default_ranks()), special_tokens={})
    newer = [c for c in map(chr, [0x0870, 0x1DF00, 0x1E290, 0xA7DB, 0xA7D0, 0x11F02, 0x323AF, 0x1D2C0, 0x11F50, 0x1E4F0])]
    texts = [f"a{c}'s1 {c}{c} x{c}y{c}1{c}" for c in newer] + ["௧ꟛ's"]
    rows = byte_bpe.encode(frame(spark, [(k, t, "en", "web", 1) for k, t in enumerate(texts)])).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], np.uint32).tolist() for r in rows} == {k: library.encode_ordinary(t) for k, t in enumerate(texts)}


def test_the_second_hash_does_not_follow_from_the_first(spark):
    """Of hashes chained in one order the second is a function of the first; in the other order it isn't."""
    texts = spark.createDataFrame([(k, f"text {k}") for k in range(50)], "doc_id long, text string")
    sides = [texts.select("text", *(h.alias(n) for h, n in zip(url_rules.key_hashes(F.col("text")), "ab", strict=True)))]
    sides.append(suffixes._keyed(texts).select(F.col("raw").cast("string").alias("text"), F.col("k1").alias("a"), F.col("k2").alias("b")))
    sides.append(sharding.described(texts.withColumns({"lang": F.lit("x"), "source": F.lit("y")})).join(texts, "doc_id").select("text", F.col("g1").alias("a"), F.col("g2").alias("b")))
    for side in sides:
        rows = side.select("a", "b", F.xxhash64("text", F.lit(1)).alias("after"), F.xxhash64(F.lit(1), "text").alias("before")).collect()
        assert len(rows) == 50 and all(r["b"] == r["before"] != r["after"] for r in rows)
