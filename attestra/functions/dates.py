"""ISO 8601 dates, partial dates and durations as text, with arithmetic that never raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.functions.scalars import strip, two_valued

# Fixed formats of dates and durations.
DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
COMPLETE = DAY + r"(?:\z|T(?:[01][0-9]|2[0-3]):[0-5][0-9](?!:[6-9][0-9]))"
SECONDS = DAY + r"T[0-9]{2}:[0-9]{2}:[0-9]{2}"
PARTIAL = r"^(?:[0-9]{4}|[0-9]{4}-(?:0[1-9]|1[0-2])|--(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|[0-9]{4}---(?:0[1-9]|[12][0-9]|3[01])|[0-9]{4}----(?:0[1-9]|[12][0-9]|3[01])|-----T(?:[01][0-9]|2[0-3]).*)$"
PARTIAL_TIME = r"^(?:[01][0-9]|2[0-3])$"
DURATION = r"^P(?:[0-9]+(?:[.,][0-9]+)?W|(?=T?[0-9])(?:[0-9]+(?:[.,][0-9]+)?Y)?(?:[0-9]+(?:[.,][0-9]+)?M)?(?:[0-9]+(?:[.,][0-9]+)?D)?(?:T(?:[0-9]+(?:[.,][0-9]+)?H)?(?:[0-9]+(?:[.,][0-9]+)?M)?(?:[0-9]+(?:[.,][0-9]+)?S)?)?)\z"


def real_day(c: Column) -> Column:
    """Whether the text begins with a day that exists."""
    return two_valued(c.rlike(DAY) & F.substring(c, 1, 10).try_cast("date").isNotNull())


def is_complete(c: Column) -> Column:
    """A day, or a day and at least hours and minutes; what follows the minutes or seconds isn't looked at."""
    return _complete(strip(c))


def _complete(c: Column) -> Column:
    return two_valued(c.rlike(COMPLETE) & F.substring(c, 1, 10).try_cast("date").isNotNull())


def is_incomplete(c: Column) -> Column:
    """Blank, a year, a month, a date with missing parts, or a day with an hour alone or a time with gaps."""
    c = strip(c)
    rest = F.substring(c, 12, 1_000_000)
    gaps = real_day(c) & (F.substring(c, 11, 1) == "T") & (rest.rlike(PARTIAL_TIME) | (rest.contains("-") & rest.contains(":")))
    return two_valued(~_complete(c) & ((c == "") | gaps | c.rlike(PARTIAL)))


def date_key(c: Column) -> Column:
    """yyyymmddHHMMSS of a complete date; a year or month stands for its first instant; else null."""


    def key(c: Column) -> Column:
        part = lambda at, n: F.substring(c, at, n)
        clock = F.concat(part(12, 2), part(15, 2), F.when(c.rlike(SECONDS), part(18, 2)).otherwise(F.lit("00")))
        day = F.concat(part(1, 4), part(6, 2), part(9, 2))
        found = F.when(F.length(c) == 10, F.when(c.rlike(DAY) & c.try_cast("date").isNotNull(), F.concat(day, F.lit("000000"))))
        found = found.when(F.length(c) == 4, F.when(c.rlike(r"^[0-9]{4}\z"), F.concat(c, F.lit("0101000000"))))
        found = found.when(F.length(c) == 7, F.when(c.rlike(r"^[0-9]{4}-(?:0[1-9]|1[0-2])\z"), F.concat(part(1, 4), part(6, 2), F.lit("01000000"))))
        return found.when(_complete(c), F.concat(day, clock)).try_cast("bigint")

    return F.transform(F.array(strip(c)), key)[0]  # the trimmed text is made once


def is_duration(c: Column) -> Column:
    """ISO 8601 duration without a sign, of one component at least; a T with nothing after a date component passes."""
    return two_valued(c.rlike(DURATION))


def study_day(day: Column, reference: Column) -> Column:
    """Days from the reference, 1 on its day and -1 on the day before: there is no day 0. Null without two real days."""
    first = F.when(real_day(reference), F.substring(reference, 1, 10).try_cast("date"))
    that = F.when(real_day(day), F.substring(day, 1, 10).try_cast("date"))
    n = F.datediff(that, first)
    return F.when(n >= 0, n + 1).otherwise(n)
