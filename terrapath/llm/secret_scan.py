"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression yields a Boolean query of trigrams that every match must hold. The
index lists, for each trigram of those queries, the documents whose lower-cased text holds it. The
postings are intersected per document, the documents that satisfy a rule's query are verified with
the rule's expression, and rules without a mandatory trigram scan every text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping; those whose group is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE_RULES = (
    Rule("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("code_host", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("payment", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("map_service", r"AIza[0-9A-Za-z_-]{35}"),
)
RULES = BASE_RULES + MORE_RULES
MASK = "[SECRET]"
#: Alternatives that are told apart while a query is derived; beyond them a part counts as anything.
MAX_STRINGS = 32

#: A query is a set of trigram sets: one of them must be wholly present. None: no trigram is mandatory.
Query = frozenset[frozenset[str]] | None


def trigram_query(pattern: str) -> Query:
    """The weakest trigram query that the lower-cased form of every match of ``pattern`` satisfies."""
    literal, query = _walk(list(_parser.parse(pattern)))
    return _both(query, _strings_query(literal)) if literal is not None else query


def _strings_query(strings: frozenset[str]) -> Query:
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return _shorter(sets)


def _shorter(sets: set[frozenset[str]]) -> Query:
    """Drops the sets that contain another one; an empty set asks for nothing."""
    if not sets or frozenset() in sets:
        return None
    return frozenset(s for s in sets if not any(t < s for t in sets))


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return _shorter({x | y for x in a for y in b}) if len(a) * len(b) <= MAX_STRINGS else max(a, b, key=lambda q: min(map(len, q)))


def _one(token: tuple) -> tuple[frozenset[str] | None, Query]:
    """The strings of one element (None: too many) and the query of what it holds besides."""
    kind, value = token
    if kind is op.LITERAL:
        return frozenset({chr(value).lower()}), None
    if kind is op.IN and all(k is op.LITERAL for k, _ in value) and len(value) <= 8:
        return frozenset(chr(v).lower() for _, v in value), None
    if kind is op.SUBPATTERN:
        return _walk(list(value[3]))
    if kind is op.BRANCH:
        parts = [_walk(list(x)) for x in value[1]]
        if all(s is not None for s, _ in parts):
            union = frozenset().union(*(s for s, _ in parts))
            if len(union) <= MAX_STRINGS and all(q is None for _, q in parts):
                return union, None
        queries = [_both(q, _strings_query(s)) if s is not None else q for s, q in parts]
        return None, None if None in queries else _shorter({x for q in queries for x in q})
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, inner = value
        strings, query = _walk(list(inner))
        if strings is not None and query is None and (low, high) == (0, 1):
            return strings | {""}, None
        if not low:
            return None, None
        return None, _both(query, _strings_query(strings)) if strings is not None else query
    if kind is op.AT:
        return frozenset({""}), None
    return None, None


def _walk(tokens: list[tuple]) -> tuple[frozenset[str] | None, Query]:
    """Strings of a whole sequence where they are few, else None and its query."""
    run: frozenset[str] = frozenset({""})
    query: Query = None
    whole = True
    for t in tokens:
        strings, inner = _one(t)
        query = _both(query, inner)
        if strings is not None and inner is None and len(run) * len(strings) <= MAX_STRINGS:
            run = frozenset(a + b for a in run for b in strings)
            continue
        query = _both(query, _strings_query(run))
        whole = False
        run = strings if strings is not None and inner is None else frozenset({""})
    if whole and query is None:
        return run, None
    return None, _both(query, _strings_query(run))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))


def postings(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """The inverted index: (trigram, doc_id, h), h being the text's hash so that a repeated id keeps its texts apart."""
    known = F.array(*map(F.lit, trigrams)) if trigrams else F.array().cast("array<string>")
    low = _keyed(docs).withColumn("low", F.lower("text"))
    return low.select(F.explode(F.filter(known, lambda t: F.contains(F.col("low"), t))).alias("trigram"), "doc_id", "h")


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(doc_id, h, kinds): postings intersected per document, and the rules whose query holds."""
    holds = [
        F.when(reduce(lambda a, b: a | b, (F.size(F.array_intersect("present", F.array(*map(F.lit, sorted(s))))) == len(s) for s in q)), F.lit(kind))
        for kind, q in queries.items()
        if q is not None
    ]
    met = index.groupBy("doc_id", "h").agg(F.collect_set("trigram").alias("present"))
    return met.select("doc_id", "h", F.array_compact(F.array(*holds)).alias("kinds")).filter(F.size("kinds") > 0)


def match_spans(text: Column, rule: Rule, place: int) -> Column:
    """array<struct<start, place, end, kind>> of a rule's matches, in code points.

    Starts are running sums of the lengths of what lies between the matches and of the matches.
    """
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    between = F.split(text, rule.pattern, -1)
    kind = "array<struct<start:int,place:int,end:int,kind:string>>"
    sizes = F.zip_with(F.zip_with(F.transform(whole, F.length), F.transform(F.slice(between, 1, F.size(whole)), F.length), lambda m, b: F.struct(m.alias("m"), b.alias("b"))), F.transform(value, F.length), lambda x, v: F.struct(x["m"].alias("m"), x["b"].alias("b"), v.alias("v")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["b"]
        end = start + x["m"]
        span = F.array(F.struct(start.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(x["v"] >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    return F.when(F.regexp_like(text, pattern), F.aggregate(sizes, begin, step, lambda a: a["out"])).otherwise(F.array().cast(kind))


def _scanned_pattern(rule: Rule) -> Rule:
    """Where the whole match is a run of one class, the least length can stand in the expression itself."""
    if rule.group == 0 and rule.least and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern):
        return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least},}}")
    return rule


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, text, found) of every row; found holds all spans in the order of start, then rule.

    A null text counts as empty, and a null id is an id. Repeated rows are scanned each; an empty table gives an empty result;
    other columns are not read. Offsets are code points, the end exclusive.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    trigrams = sorted({t for q in queries.values() if q for s in q for t in s})
    keyed = _keyed(docs)
    found = []
    if trigrams:
        index = materialize(postings(docs, trigrams), "postings")
        met = candidates(index, queries).select(F.col("doc_id").alias("met_id"), F.col("h").alias("met_h"), "kinds")
        keyed = keyed.join(met, F.col("doc_id").eqNullSafe(F.col("met_id")) & (F.col("h") == F.col("met_h")), "left")
    for i, r in enumerate(rules):
        spans = match_spans(F.col("text"), _scanned_pattern(r), i)
        if queries[r.kind] is not None:
            none = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")
            spans = F.when(F.array_contains("kinds", r.kind), spans).otherwise(none)
        found.append(spans)
    return keyed.select("doc_id", "text", F.array_sort(F.concat(*found)).alias("found"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """The digest columns of ``scan``'s rows."""
    base = F.filter("found", lambda s: s["place"] < len(BASE_RULES))
    counts = [F.size(F.filter(F.col("found")["kind"], lambda k: k == r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES]
    return scanned.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """``text`` with each run of overlapping spans replaced by ``mask``."""

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        return F.when(s["start"] >= acc["at"], F.struct(fresh.alias("out"), s["end"].alias("at"))).otherwise(
            F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
        )

    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(spans, begin, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def mask_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with every secret masked and ``n_chars`` brought up to date; no row goes.

    Rows are told apart by id (which may be null) and text; a null text stays null.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hit = scan(docs, rules).filter(F.size("found") > 0).dropDuplicates(["doc_id", "text"]).select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__h"), F.col("found").alias("__found"))
    joined = docs.join(hit, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__h")), "left")
    new = F.when(F.col("__found").isNull(), F.col("text")).otherwise(masked(F.col("text"), F.col("__found")))
    out = joined.withColumn("text", new).drop("__id", "__h", "__found")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
