"""Version numbers as sortable expressions.

A version's key is a struct that compares as versions do: its numbers (up to ``PARTS``, missing
ones are 0), then releases above pre-releases, then the pre-release's identifiers in order
(numbers by value and below words).  ``v1.2``, ``1.2`` and ``1.2.0`` have equal keys; build
data after ``+`` don't count.  A text that doesn't begin with a number has a null key.

A range is a comma-separated list of comparisons (``>=1.2,<2``; a bare version is ``==``);
its bounds are a lower and an upper key, and the ranges of any number of users have a common
version only if the greatest lower bound lies below the least upper one -- one
aggregation, no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = 4
_SHAPE = r"^\s*[vV]?(\d{1,15}(?:\.\d{1,15})*)[-._]?([0-9A-Za-z.\-]*)"


def version_key(version: Column) -> Column:
    numbers = F.split(F.nullif(F.regexp_extract(version, _SHAPE, 1), F.lit("")), r"\.")
    tail = F.lower(F.regexp_extract(version, _SHAPE, 2))
    ids = F.transform(F.split(tail, r"[.\-]|(?<=[a-z])(?=\d)|(?<=\d)(?=[a-z])"), lambda x: F.struct(
        (~x.rlike(r"^\d{1,15}$")).cast("int").alias("word"), F.coalesce(F.when(x.rlike(r"^\d{1,15}$"), x).cast("long"), F.lit(0)).alias("number"),
        F.when(~x.rlike(r"^\d{1,15}$"), x).alias("name")))
    parts = [F.coalesce(F.get(numbers, F.lit(i)).cast("long"), F.lit(0)).alias(f"n{i}") for i in range(PARTS)]
    key = F.struct(*parts, (tail == "").cast("int").alias("release"), F.when(tail != "", ids).alias("pre"))
    return F.when(numbers.isNotNull(), key)


def range_bounds(text: Column) -> Column:
    """``struct(low, low_open, high, high_open)`` of a range's comparisons; null bounds are open ends."""
    tests = F.transform(F.filter(F.split(text, ","), lambda x: F.trim(x) != ""), lambda x: F.struct(
        F.regexp_extract(x, r"^\s*(>=|<=|==|=|>|<|~>)?", 1).alias("op"), version_key(F.regexp_replace(x, r"^\s*(>=|<=|==|=|>|<|~>)\s*", "")).alias("key")))
    lows = F.transform(F.filter(tests, lambda t: ~t["op"].isin("<", "<=")), lambda t: F.struct(t["key"].alias("key"), (t["op"] == ">").cast("int").alias("open")))
    highs = F.transform(F.filter(tests, lambda t: t["op"].isin("<", "<=", "==", "=", "")), lambda t: F.struct(t["key"].alias("key"), (-(t["op"] == "<").cast("int")).alias("open")))
    low, high = F.array_max(lows), F.array_min(highs)
    return F.struct(low["key"].alias("low"), (low["open"] == 1).alias("low_open"), high["key"].alias("high"), (high["open"] == -1).alias("high_open"))


def have_common(low: Column, low_open: Column, high: Column, high_open: Column) -> Column:
    """Whether a version lies between the bounds (null: no bound)."""
    return F.coalesce((low < high) | ((low == high) & ~low_open & ~high_open), F.lit(True))
