"""Zone-independent time arithmetic on timestamp columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_seconds(ts) -> Column:
    """Seconds of a wall-clock timestamp, independent of the session time zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    day = F.unix_date(F.to_date(c)).cast("double") * 86400
    return day + F.hour(c) * 3600 + F.minute(c) * 60 + F.extract(F.lit("SECOND"), c).cast("double")


def days_between(later, earlier) -> Column:
    return (clock_seconds(later) - clock_seconds(earlier)) / 86400


# Fixed list of accepted date layouts for mixed-format sources.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy HH:mm", "MM/dd/yyyy", "dd-MMM-yyyy")


def mixed_timestamp(c: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS])
