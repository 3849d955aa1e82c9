"""Times as whole numbers that no session's time zone changes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_number(time: str | Column) -> Column:
    """Whole days since 1992-01-01, the first day of the tables."""
    return F.datediff((F.col(time) if isinstance(time, str) else time).cast("date"), F.lit("1992-01-01").cast("date")).cast("long")


def seconds(time: str) -> Column:
    """Whole seconds since 1970 of a time without zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({time} as timestamp_ntz))")


def micros(time: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({time} as timestamp_ntz))")
