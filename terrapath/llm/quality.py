"""Quality rules whose cutoffs follow the corpus.

Each document gets integer quality rates. For every language and source, a mergeable quantile
sketch of each rate is kept as a table of logarithmic buckets with counts: merging is addition, so
partial sketches of any executor, source or day add up to the same sketch, and a rerun after a
lost executor gives the same cutoffs. A cutoff is an outlier fence above the sketch's upper
quartile; the cutoffs are joined back to the documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, row_key

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: Base rules: a document of fewer words, or with more repeated words in a hundred, fails.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Neighbouring sketch buckets differ by this factor, so a quantile is off by 2 % at most.
GAMMA = 1.02


@dataclass(frozen=True)
class Rate:
    """A rate in thousandths and its fence: upper quartile + spreads * max(interquartile range, least)."""

    name: str
    spreads: int
    least: int


#: The rates that have a fence, with the least spread that counts in a group where most documents agree.
RATES = (
    Rate("symbol_rate", 4, 25),
    Rate("bang_rate", 4, 25),
    Rate("caps_rate", 4, 40),
    Rate("dup_line_rate", 4, 100),
    Rate("word_length", 4, 500),
)
#: Sketches of fewer documents give way to the language's, and those to the whole corpus's.
MIN_GROUP = 100
#: Groups whose fences are broadcast at most.
BROADCAST_GROUPS = 100_000

_STATS = [("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string())] + [
    (n, pa.int64())
    for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps", "n_bangs", "row_key")
]
STATS_DDL = "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n, _ in _STATS[3:])
_CAPS = bytes(range(65, 91))


def repeat_words(words: list) -> int:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    total, end = 0, 0
    for i, w in enumerate(windows):
        if w in often:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def text_stats(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of ``_STATS`` after the keys; null counts as empty."""
    if not text:
        return (0,) * 8
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        len(raw) - len(raw.translate(None, _CAPS)),
        text.count("!"),
    )


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts = [text_stats(x) for x in b.column("text").to_pylist()]
        cols = list(zip(*counts, strict=True)) if counts else [()] * 8
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("lang"), b.column("source"), *(pa.array(c, pa.int64()) for c in cols), b.column("row_key")],
            names=[n for n, _ in _STATS],
        )


def base_stats(docs: DataFrame) -> DataFrame:
    """One row of counts per document, from its whole text, and the key of its row."""
    keys = [F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), row_key(docs, "lang", "source").alias("row_key")]
    return docs.select(*keys).mapInArrow(_stats, STATS_DDL)


def with_rates(stats: DataFrame) -> DataFrame:
    """Adds the integer rates; a document without words or lines has rate 0."""

    def per(n: str, d: str, unit: int):
        return F.when(F.col(d) > 0, F.expr(f"{unit} * {n} div {d}")).otherwise(F.lit(0)).cast("long")

    return stats.withColumns(
        {
            "symbol_rate": per("n_symbols", "n_words", 1000),
            "bang_rate": per("n_bangs", "n_words", 1000),
            "caps_rate": per("n_caps", "word_chars", 1000),
            "dup_line_rate": per("n_dup_lines", "n_lines", 1000),
            "word_length": per("word_chars", "n_words", 1000),
        }
    )


def sketches(rated: DataFrame) -> DataFrame:
    """Quantile sketches (lang, source, rate, bucket, n) of the documents that pass the base rules.

    Value v lies in bucket ceil(ln v / ln GAMMA) + 1, and 0 in bucket 0. Sketches merge by adding n.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rate"), F.col(r.name).alias("v")) for r in RATES)))
    bucket = F.when(F.col("p.v") <= 0, F.lit(0)).otherwise(F.ceil(F.log(F.col("p.v").cast("double")) / F.log(F.lit(GAMMA))) + 1)
    return (
        rated.filter(~F.col("base_failed"))
        .select("lang", "source", pairs.alias("p"))
        .select("lang", "source", "p.rate", bucket.cast("int").alias("bucket"))
        .groupBy("lang", "source", "rate", "bucket")
        .agg(F.count("*").alias("n"))
    )


def merge(sketch: DataFrame, *keys: str) -> DataFrame:
    """Sketches of coarser groups, by adding the counts of the finer ones."""
    return sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_docs, and a fence per rate), null-safe in the keys.

    A sketch has at most about 1,500 buckets, so the windows here stay small whatever the corpus is.
    """
    group = Window.partitionBy(*keys, "rate")
    run = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.col("bucket") == 0, F.lit(0)).otherwise(F.floor(F.pow(F.lit(GAMMA), F.col("bucket") - 1))).cast("long")

    def quantile(percent: int):
        return F.min(F.when(F.col("up_to") * 100 >= F.col("n_docs") * percent, F.col("value")))

    found = (
        sketch.withColumns({"up_to": F.sum("n").over(run), "n_docs": F.sum("n").over(group), "value": value})
        .groupBy(*keys, "rate", "n_docs")
        .agg(quantile(25).alias("low"), quantile(75).alias("high"))
    )
    out = []
    for r in RATES:
        fence = F.col("high") + r.spreads * F.greatest(F.col("high") - F.col("low"), F.lit(r.least))
        out.append(F.max(F.when(F.col("rate") == r.name, fence)).alias(f"{r.name}_fence"))
    return found.groupBy(*keys, "n_docs").agg(*out)


def _judged(docs: DataFrame, min_group: int) -> DataFrame:
    """The rows of ``judge`` with their keys."""
    rated = with_rates(materialize(base_stats(docs), "quality")).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )
    fine = sketches(rated)
    names = [f"{r.name}_fence" for r in RATES]
    levels = [
        (fences(fine, "lang", "source"), ("lang", "source"), "a"),
        (fences(merge(fine, "lang"), "lang"), ("lang",), "b"),
        (fences(merge(fine)), (), "c"),
    ]
    groups = rated.select("lang", "source").distinct()
    for f, keys, tag in levels:
        f = f.select(*(F.col(k).alias(f"{k}_{tag}") for k in keys), F.col("n_docs").alias(f"n_{tag}"), *(F.col(n).alias(f"{n}_{tag}") for n in names))
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"{k}_{tag}"))
        groups = groups.join(F.broadcast(f) if not keys else f, on, "left").drop(*(f"{k}_{tag}" for k in keys))
    chosen = groups.select(
        F.col("lang").alias("g_lang"),
        F.col("source").alias("g_source"),
        *(
            F.when(F.col("n_a") >= min_group, F.col(f"{n}_a")).when(F.col("n_b") >= min_group, F.col(f"{n}_b")).otherwise(F.col(f"{n}_c")).alias(n)
            for n in names
        ),
    )
    # Languages times sources are few; where they aren't, the join is a shuffle.
    chosen = materialize(chosen, "fences")
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_GROUPS else chosen
    on = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    outlier = F.lit(False)
    for r in RATES:
        outlier = outlier | F.coalesce(F.col(r.name) > F.col(f"{r.name}_fence"), F.lit(False))
    return (
        rated.join(chosen, on, "left")
        .withColumn("kept", ~F.col("base_failed") & ~outlier)
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "row_key", *(r.name for r in RATES), *names)
    )


def judge(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Counts, fences and verdict of every document of ``docs`` (doc_id, text, lang, source, ...).

    Null or empty text: all counts 0, base_failed. Null language or source: a group of its own.
    Repeated rows are judged each; ties cannot arise, as a fence is a value and equal rates fare alike.
    An empty table gives an empty result; other columns are not read. ``kept`` is false where the base
    rules fail or a rate lies above its fence: that of the language and source where ``min_group``
    documents passed the base rules there, else that of the language, else that of the corpus.
    """
    return _judged(docs, min_group).drop("row_key")


def keep_good(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """The documents that ``judge`` keeps, with the columns of ``docs``; rows of repeated or null ids are told apart."""
    good = _judged(docs, min_group).filter("kept").select(F.col("row_key").alias("__kept"))
    return docs.join(good, row_key(docs, "lang", "source") == F.col("__kept"), "left_semi")
