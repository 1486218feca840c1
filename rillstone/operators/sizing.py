"""Checks made before a side is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from rillstone.session import limit

BROADCAST_ROWS = 2_000_000  # setting spark.rillstone.broadcastRows
BROADCAST_BYTES = 256 * 1024 * 1024  # setting spark.rillstone.broadcastBytes

_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def fits_broadcast(df: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> bool:
    """True when an exact count of the rows and bytes of `df` stays below both limits.

    One partially aggregated pass over the side itself; nothing but the two totals reaches the driver.
    """
    spark = df.sparkSession
    max_rows = limit(spark, max_rows, "spark.rillstone.broadcastRows", BROADCAST_ROWS)
    max_bytes = limit(spark, max_bytes, "spark.rillstone.broadcastBytes", BROADCAST_BYTES)
    width = F.lit(0)
    for field in df.schema.fields:
        name = F.col(f"`{field.name}`")
        if isinstance(field.dataType, _FIXED_WIDTH):
            width = width + F.lit(8)
        elif isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(name), F.lit(0)) + F.lit(8)
        else:
            width = width + F.coalesce(F.length(F.to_json(F.struct(name))), F.lit(0))
    total = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width.cast("bigint")).alias("b")).first()
    return total["n"] <= max_rows and (total["b"] or 0) <= max_bytes
