"""Arrays used as sets, delimited values, and three-valued logic over groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_values(c: Column, delimiter: str = r"[;,]") -> Column:
    """'a; b ,,c' -> [a, b, c]: trimmed, blanks dropped, first spelling kept; null gives []."""
    parts = F.transform(F.split(c, delimiter), lambda x: F.trim(x))
    return F.coalesce(F.array_distinct(F.filter(parts, lambda x: x != "")), F.array().cast("array<string>"))


def within(values: Column, vocabulary: list[str]) -> Column:
    """The values of a closed vocabulary, each once, in their order."""
    return F.array_distinct(F.filter(values, lambda x: x.isin(vocabulary)))


def contains_all(values: Column, wanted: Column) -> Column:
    return F.size(F.array_except(wanted, values)) == 0


def capped_union(a: Column, b: Column, cap: int, drop: str | None = None) -> Column:
    """a, then what b adds, at most cap values; ``drop`` is left out."""
    u = F.array_distinct(F.concat(a, b))
    if drop is not None:
        u = F.filter(u, lambda x: x != drop)
    return F.slice(u, 1, cap)


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection over the smaller size; 0 if either is empty."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(0.0)


def three_valued_and(c: Column) -> Column:
    """Aggregate: false if any is false, else unknown (null) if any is, else true."""
    return F.when(F.bool_or(~c), False).when(F.bool_or(c.isNull()), F.lit(None)).otherwise(True)


def three_valued_or(c: Column) -> Column:
    return F.when(F.bool_or(c), True).when(F.bool_or(c.isNull()), F.lit(None)).otherwise(False)


def merge_patch(old: Column, patch: Column) -> Column:
    """Keys of patch replace those of old; a null value in patch replaces too."""
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(F.coalesce(patch, F.create_map().cast("map<string,string>")), k))
    return F.map_concat(kept, F.coalesce(patch, F.create_map().cast("map<string,string>")))
