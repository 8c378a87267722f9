"""Sets of locations: sorted arrays of struct<start, end> (end exclusive) of one source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIND = "array<struct<start: int, end: int>>"


def location(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def selection(locations: Column) -> Column:
    """The set of an array of locations, by start, then by end."""
    return F.array_sort(F.array_distinct(locations))


def add(chosen: Column, one: Column) -> Column:
    return F.array_sort(F.array_union(chosen, F.array(one)))


def contains(chosen: Column, one: Column) -> Column:
    return F.array_contains(chosen, one)


def delete(chosen: Column, one: Column) -> Column:
    return F.array_except(chosen, F.array(one))


def ceiling(chosen: Column, one: Column) -> Column:
    """The least location not before one; null if there is none."""
    return F.array_min(F.filter(chosen, lambda x: x >= one))


def floor(chosen: Column, one: Column) -> Column:
    """The greatest location not after one; null if there is none."""
    return F.array_max(F.filter(chosen, lambda x: x <= one))


def first(chosen: Column) -> Column:
    return F.array_min(chosen)


def last(chosen: Column) -> Column:
    return F.array_max(chosen)


def size(chosen: Column) -> Column:
    return F.size(chosen)


def is_empty(chosen: Column) -> Column:
    return F.size(chosen) == 0


def intersects(a: Column, b: Column) -> Column:
    """Locations that are in both, exactly."""
    return F.array_sort(F.array_intersect(a, b))


def union(a: Column, b: Column) -> Column:
    """The union of sets that share nothing; of others, only the first location of a."""
    return F.when(F.size(F.array_intersect(a, b)) > 0, F.array(first(a))).otherwise(F.array_sort(F.array_union(a, b)))


def location_covers(a: Column, b: Column) -> Column:
    return (a["start"] <= b["start"]) & (b["end"] <= a["end"])


def hull(chosen: Column) -> Column:
    """The first location if it covers the last, or the other way round; else from the first's start to the last's end."""
    a, b = first(chosen), last(chosen)
    return F.when(location_covers(a, b), a).when(location_covers(b, a), b).otherwise(location(a["start"], b["end"]))


def covers(chosen: Column, one: Column) -> Column:
    return location_covers(hull(chosen), one)


def code(chosen: Column, content: Column) -> Column:
    """The text that the hull spans; null for an empty set."""
    span = hull(chosen)
    return F.when(F.size(chosen) > 0, F.substr(content, span["start"] + 1, span["end"] - span["start"]))


def rendered(chosen: Column) -> Column:
    return F.array_join(F.transform(chosen, lambda x: F.concat(F.lit("["), x["start"].cast("string"), F.lit(","), x["end"].cast("string"), F.lit(")"))), " ")
