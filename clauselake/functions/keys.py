"""Key conventions: letter case and surrounding blanks or tabs do not matter; blank refers to nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(c: Column | str) -> Column:
    """Comparable form of a key; NULL when null, empty or only blanks and tabs."""
    c = F.col(c) if isinstance(c, str) else c
    k = F.lower(F.btrim(c.cast("string"), F.lit(" \t")))
    return F.when(k != "", k)


def blank_to_null(c: Column | str) -> Column:
    """'' -> NULL without trimming: a lone space is a value."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(c, F.lit(""))
