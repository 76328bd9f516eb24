"""Documents with everything that goes wrong: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pytest

#: Columns that operators use inside.
CLASHING = ("n_words", "kept", "ids", "shard", "slot", "raw", "spans", "node", "h", "found", "present", "text_crc32", "size", "words", "law", "__b")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def messy_rows(seed=0, n=60):
    r = random.Random(seed)
    vocab = ["the", "The", "of", "é", "naïve", "x1", "日本語", "don't", "A-B", "##", "$5", "foo_bar", "...", "🙂", "\u00a0", "\u2003a"] + [f"w{i}" for i in range(60)]
    spaces = [" ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b"]
    copied = " ".join(r.choice(vocab) for _ in range(150))
    rows = []
    for i in range(n):
        t = "".join(r.choice(vocab) + r.choice(spaces) for _ in range(r.choice([0, 1, 4, 30, 80, 200])))
        if i % 7 == 0:
            t = t + copied + t
        if i % 11 == 0:
            t = "line one\nline one\n \nline one\n" + t
        rows.append((i - 3, t, r.choice(["en", "de", None]), r.choice(["web", "books", None]), len(t)))
    texts = [None, "", " \n", "x" * 30_000, "ab " * 4_000, copied, copied, "one", "one", "tie tie tie tie"]
    rows += [(1000 + i, t, "en", "web", None) for i, t in enumerate(texts)]
    return rows + rows[:2]  # repeated rows


@pytest.fixture(scope="session")
def messy(spark):
    return messy_rows(), frame(spark, messy_rows())


def frame(spark, rows):
    return spark.createDataFrame([(*x, *["clash"] * len(CLASHING)) for x in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
