"""Time helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SECONDS = "yyyy-MM-dd HH:mm:ss"
MILLIS = "yyyy-MM-dd HH:mm:ss.SSS"


def from_millis(col: Column) -> Column:
    """Epoch milliseconds to timestamp."""
    return F.timestamp_millis(col)


def text(col: Column, pattern: str = SECONDS) -> Column:
    """Render a timestamp in the session zone."""
    return F.date_format(col, pattern)


def millis_text(col: Column, pattern: str = SECONDS) -> Column:
    """Render epoch milliseconds in the session zone."""
    return text(from_millis(col), pattern)
