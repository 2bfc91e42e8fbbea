"""Weeks as dates. No time zone enters: everything is DATE arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_start(day: Column, anchor: str = "tuesday") -> Column:
    """First day of the week holding ``day``.

    With the default anchor a week runs Tuesday to Monday, so a Monday sale
    belongs to the week begun six days before.
    """
    if anchor == "monday":
        return F.trunc(day, "week")
    return F.date_add(F.trunc(F.date_sub(day, 1), "week"), 1)


def whole_weeks(later: Column, earlier: Column) -> Column:
    return F.floor(F.datediff(later, earlier) / F.lit(7)).cast("int")
