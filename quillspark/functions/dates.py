"""Date parsing: lenient day-month-year strings found in text, and observation times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MONTH_YEAR = r"(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})"


def lenient_date(c: str | Column) -> Column:
    """dd.mm.yy or dd.mm.yyyy as yyyy-mm-dd if day, month and year are in range; the calendar is not checked."""
    c = F.col(c) if isinstance(c, str) else c
    whole = rf"^\s*{DAY_MONTH_YEAR}\s*$"
    part = lambda i: F.regexp_extract(c, whole, i)
    year = F.when(F.length(part(3)) == 2, F.concat(F.lit("20"), part(3))).otherwise(part(3))
    number = lambda x: F.expr("0") if x is None else x.try_cast("int")
    ok = number(part(1)).between(1, 31) & number(part(2)).between(1, 12) & number(year).between(1900, 2100)
    return F.when(ok, F.concat_ws("-", year, F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")))


def dates_in(c: str | Column) -> Column:
    """Distinct lenient dates of a text, in order of appearance."""
    c = F.col(c) if isinstance(c, str) else c
    found = F.regexp_extract_all(c, F.lit(rf"({DAY_MONTH_YEAR})"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lenient_date), lambda x: x.isNotNull()))


def observation_time(c: str | Column) -> Column:
    """Day of an ISO or day-month-year string with a calendar check, else a timestamp, else null."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    iso = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ].*)?$"
    dmy = r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$"
    part = lambda p, i: F.regexp_extract(c, p, i).try_cast("int")
    made = lambda y, m, d: F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0))
    return (
        F.when(c.rlike(iso), made(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(c.rlike(dmy), made(part(dmy, 3), part(dmy, 2), part(dmy, 1)))
        .otherwise(F.try_to_timestamp(c))
    )
