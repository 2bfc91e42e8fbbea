"""Lenient parsing: what cannot be read becomes null (dates) or 0 (measures)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NANOS_PER_DAY = 86_400_000_000_000


def lenient_date(column: Column, dtype: T.DataType, formats: Sequence[str] = ()) -> Column:
    """DATE from a date, a timestamp, a string or epoch nanoseconds; null if unreadable."""
    if isinstance(dtype, T.StringType):
        readings = [column.try_cast("timestamp_ntz").cast("date")]
        readings += [F.try_to_timestamp(column, F.lit(f)).cast("date") for f in formats]
        return F.coalesce(*readings)
    if isinstance(dtype, T.IntegralType):
        nanos = column.cast("bigint")
        days = (nanos - F.pmod(nanos, F.lit(NANOS_PER_DAY))) / F.lit(NANOS_PER_DAY)
        return F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))
    return column.cast("date")


def lenient_number(column: Column, dtype: T.DataType) -> Column:
    """DOUBLE, with null, NaN and unreadable text as 0."""
    number = column.try_cast("double")
    if isinstance(dtype, T.StringType):
        # Java reads a trailing d or f as a type suffix; "12d" is not a number here.
        number = F.when(~column.rlike(r"(?i)[0-9.][df]\s*$"), number)
    return F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0))
