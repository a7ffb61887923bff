"""Column expressions: fiscal calendar, keys and typed conforming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_KEY = -1


def date_key(d: Column) -> Column:
    """YYYYMMDD as an integer; null stays null."""
    return F.date_format(d, "yyyyMMdd").cast("int")


def fiscal_period(d: Column) -> Column:
    """FY2026-M03: the fiscal year is the calendar year."""
    return F.concat(F.lit("FY"), F.year(d).cast("string"), F.lit("-M"), F.date_format(d, "MM"))


def fiscal_quarter(d: Column) -> Column:
    return F.concat(F.lit("FY"), F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))


def iso_day(d: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(d) + 1


def typed(name: str, kind: str, lenient: bool = False) -> Column:
    """A landed text column with its type; empty text is null.  Text that does not fit is an error, or null if `lenient`."""
    value = F.nullif(F.col(name), F.lit(""))
    return (value.try_cast(kind) if lenient else value.cast(kind)).alias(name)


def or_unknown(key: Column) -> Column:
    return F.coalesce(key, F.lit(UNKNOWN_KEY).cast("long"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is zero."""
    return numerator / F.nullif(denominator, F.lit(0))


def differs(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """True where any named column differs; nulls equal each other."""
    out = F.lit(False)
    for name in left:
        out = out | ~left[name].eqNullSafe(right[name])
    return out
