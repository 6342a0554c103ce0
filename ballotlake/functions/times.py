"""Unix seconds and UTC wall times, free of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _epoch() -> Column:
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")


def utc(seconds: int | Column | None) -> Column:
    """Unix seconds as a UTC wall time; folds to a literal for a plain number."""
    quantity = seconds if isinstance(seconds, Column) else F.lit(seconds).cast("bigint")
    return F.timestamp_add("SECOND", quantity, _epoch())


def first_second_at(ts: Column) -> Column:
    """The smallest whole unix second that is not before ``ts``.

    ``ts <= utc(t)`` holds for a whole ``t`` exactly when this is ``<= t``.
    """
    span = (ts - _epoch()).cast("interval second").cast("decimal(20,6)")
    return F.ceil(span).cast("bigint")
