"""Cleaning of place dumps: categories, names, centres and context labels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import numbered

#: Keys of a name map, the best first (fixed values).
NAME_KEYS = ("name", "name:de", "name:old", "name:en", "name:alt", "name:it", "name:fr", "name:reg")


def counts(df: DataFrame, by: str | Column, name: str = "n") -> DataFrame:
    """Rows per value, the most frequent first."""
    return df.groupBy(by).agg(F.count("*").alias(name)).orderBy(F.desc(name))


def second_level(category: Column) -> Column:
    """The first two parts of a dotted category."""
    return F.array_join(F.slice(F.split(category, r"\."), 1, 2), ".")


def last_segment(category: Column) -> Column:
    return F.element_at(F.split(category, r"\."), -1)


def matches_any(categories: Column, patterns: Sequence[str]) -> Column:
    """Whether any category equals a pattern or, for ``x.*``, begins with ``x`` (the dot is not asked for)."""
    exact = [p for p in patterns if not p.endswith(".*")]
    starts = [p[:-2] for p in patterns if p.endswith(".*")]
    return F.exists(categories, lambda c: reduce(lambda a, b: a | b, [c.startswith(s) for s in starts], c.isin(exact) if exact else F.lit(False)))


def without_rare(df: DataFrame, categories: str, id_col: str) -> DataFrame:
    """Rows none of whose categories occurs only once in the table (an anti join on the exploded list)."""
    long = df.select(id_col, F.explode(categories).alias("category"))
    rare = long.groupBy("category").agg(F.count("*").alias("n")).filter("n = 1").select("category")
    hit = long.join(rare, "category", "left_semi").select(id_col).distinct()
    return df.join(hit, id_col, "left_anti")


def frequent(df: DataFrame, column: str, more_than: int) -> DataFrame:
    """Rows whose value of ``column`` occurs more than so often; null values go."""
    n = df.groupBy(column).agg(F.count("*").alias("category_count"))
    return df.join(n.filter(F.col("category_count") > more_than), column)


def seldom(df: DataFrame, column: str, fewer_than: int) -> DataFrame:
    """Rows whose value of ``column`` occurs fewer than so often."""
    n = df.groupBy(column).agg(F.count("*").alias("name_count"))
    return df.join(n.filter(F.col("name_count") < fewer_than), column)


def best_name(names: Column, keys: Sequence[str] = NAME_KEYS) -> Column:
    """The first name that the map has in the order of ``keys``; empty without any."""
    return F.coalesce(*(F.try_element_at(names, F.lit(k)) for k in keys), F.lit(""))


def context_label(address: Column, country_code: Column, countries: dict[str, str], region: Column) -> Column:
    """State, else the country's name, else the region of the dump."""
    known = F.create_map(*(F.lit(x) for kv in countries.items() for x in kv)) if countries else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(address, F.lit("state:en")), F.try_element_at(known, country_code), region)


def replaced(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other, then trimmed."""
    return F.trim(reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text))


def centre(points: Column, compat_parts: Column | None = None) -> Column:
    """Mean of [x, y] points; with ``compat_parts`` the sum is divided by that number instead."""
    total = F.aggregate(points, F.array(F.lit(0.0), F.lit(0.0)), lambda a, p: F.array(a[0] + p[0], a[1] + p[1]))
    n = F.size(points) if compat_parts is None else compat_parts
    return F.transform(total, lambda x: x / n)


def lon_lat(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: F.trim(x).cast("float"))


def dictionary(df: DataFrame, value: str, position: str) -> DataFrame:
    """(value, ix): distinct values numbered by where each is first seen; positions are all different."""
    return numbered(df.groupBy(value).agg(F.min(position).alias("first")), ["first"], "ix").select(value, F.col("ix").cast("long").alias("ix"))
