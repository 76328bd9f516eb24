"""Parameters, keys and text distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import _c

#: The edit distance allowed for a query is its bytes over this, within the bounds (fixed values).
BYTES_AN_EDIT, LEAST_EDITS, MOST_EDITS = 4, 2, 255


def request_value(name: str, default: float, low: float, high: float) -> Column:
    """A request's number: its default where missing, clamped, rounded to four places."""
    return F.round(F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(_c(name), F.lit(default)))), 4)


def snapped(value, step: float) -> Column:
    """The multiple of ``step`` nearest to a value."""
    return F.round(_c(value) / step) * step


def allowed_edits(query) -> Column:
    return F.greatest(F.lit(LEAST_EDITS), F.least(F.lit(MOST_EDITS), F.floor(F.octet_length(_c(query)) / BYTES_AN_EDIT))).cast("int")


def prefix_distance(query, name) -> Column:
    """The least edit distance between a query and any prefix of a name."""
    q, n = _c(query), _c(name)
    lengths = F.sequence(F.lit(0), F.length(n))
    return F.array_min(F.transform(lengths, lambda i: F.levenshtein(q, F.substring(n, F.lit(1), i))))


def share_url(pairs: dict[str, Column]) -> Column:
    """``a=1&b=2`` of the parameters that have a value."""
    return F.concat_ws("&", *(F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string")))) for k, v in pairs.items()))


#: Letters of the second part of a download's id, and their number (fixed values).
ID_LETTERS, ID_LENGTH = "0123456789abcdefghijklmnopqrstuvwxyz", 6


def download_id(at, *of) -> Column:
    """``milliseconds-letters``: six letters or digits drawn by the columns ``of``, so that a task that is run again gives the same id."""
    drawn = F.pmod(F.xxhash64(F.lit("download"), *map(_c, of)), F.lit(len(ID_LETTERS) ** ID_LENGTH))
    letters = F.lpad(F.lower(F.conv(drawn.cast("string"), 10, len(ID_LETTERS))), ID_LENGTH, "0")
    return F.concat_ws("-", F.unix_millis(_c(at)).cast("string"), letters)
