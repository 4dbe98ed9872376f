"""Month arithmetic with overflow, and dates read from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def add_months_overflow(d: Column, months: Column) -> Column:
    """The day of the month is kept and runs over into the next: 31 January + 1 month is 2 or 3 March."""
    return F.date_add(F.add_months(F.trunc(d, "MM"), months), F.dayofmonth(d) - 1)


def last_due(first: Column, interval: Column, as_of: Column) -> Column:
    """The latest anniversary of first, every interval months, that is not after as_of; null before the first."""
    between = (F.year(as_of) - F.year(first)) * 12 + F.month(as_of) - F.month(first)
    n = F.floor(between / interval).cast("int")
    due = add_months_overflow(first, n * interval)
    n = F.when(due > as_of, n - 1).otherwise(n)
    return F.when((interval > 0) & (n >= 0), add_months_overflow(first, n * interval))


def next_due(first: Column, interval: Column, as_of: Column) -> Column:
    last = last_due(first, interval, as_of)
    return F.when(interval > 0, F.coalesce(add_months_overflow(last, interval), first))


def interval_months(c: Column) -> Column:
    """'every 5 years' -> 60, 'annually' -> 12, else null."""
    years = F.regexp_extract(c, r"(?i)(\d+)[\s-]*year", 1)
    return F.when(years != "", years.cast("int") * 12).when(c.rlike("(?i)annual"), 12)


_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_DATE = rf"(?:\d{{1,2}}/\d{{1,2}}/\d{{4}}|(?:{_MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}|\d{{1,2}}(?:st|nd|rd|th)?\s+day\s+of\s+(?:{_MONTHS}),?\s+\d{{4}})"


def parse_date(c: Column) -> Column:
    """m/d/yyyy, 'March 5th, 2024' or '5th day of March, 2024'; null outside 1970 to 2100 or if no date."""
    s = F.regexp_replace(F.trim(c), r"(?<=\d)(?:st|nd|rd|th)\b", "")
    s = F.regexp_replace(s, r"(?i)^(\d{1,2})\s+day\s+of\s+([a-z]+),?\s+(\d{4})$", "$2 $1, $3")
    s = F.initcap(F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"([a-z]) (\d{1,2}) (\d{4})$", "$1 $2, $3"))
    d = F.coalesce(F.try_to_timestamp(s, F.lit("M/d/yyyy")), F.try_to_timestamp(s, F.lit("MMMM d, yyyy"))).cast("date")
    return F.when(F.year(d).between(1970, 2100), d)


def date_after(c: Column, leads: list[str]) -> Column:
    """The first date in the text that follows one of the lead phrases (regular expressions), in their order."""
    return F.coalesce(*[parse_date(F.nullif(F.regexp_extract(c, rf"(?i){lead}\s+({_DATE})", 1), F.lit(""))) for lead in leads])


def days_left(d: Column, as_of: Column) -> Column:
    return F.datediff(d, as_of)
