"""Batch sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def write_delimited(df: DataFrame, path: str, separator: str = ",") -> None:
    """Delimited text without header, replacing earlier output."""
    df.write.mode("overwrite").option("sep", separator).csv(path)


def as_tuple(df: DataFrame) -> Column:
    """`(a,b,c)`: a row as one text."""
    return F.concat(F.lit("("), F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in df.columns]), F.lit(")"))


def write_text(df: DataFrame, path: str, line: Column | None = None, max_rows_per_file: int | None = None) -> None:
    """One text line per row; by default the row as a tuple."""
    writer = df.select((as_tuple(df) if line is None else line).alias("value")).write.mode("overwrite")
    if max_rows_per_file:
        writer = writer.option("maxRecordsPerFile", max_rows_per_file)
    writer.text(path)


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str], max_rows_per_file: int | None = None) -> None:
    """Parquet with one folder per key value, replacing earlier output.

    Rows are rebalanced by key, so a folder gets few files and a heavy key is still written by many tasks.
    """
    writer = df.hint("rebalance", *[F.col(k) for k in keys]).write.mode("overwrite").partitionBy(*keys)
    if max_rows_per_file:
        writer = writer.option("maxRecordsPerFile", max_rows_per_file)
    writer.parquet(path)


def show(df: DataFrame, n: int, prefix: str | None = None) -> None:
    """Print the first `n` rows; with a prefix one line per row."""
    if prefix is None:
        df.show(n, truncate=False)
        return
    for row in df.select(as_tuple(df)).take(n):
        print(f"{prefix}> {row[0]}")


def message_options(servers: str, topic: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.retries": "3"}


def messages(df: DataFrame, key: str, line: Column) -> DataFrame:
    """Rows as (key, value) messages."""
    return df.select(F.col(key).cast("string").alias("key"), line.alias("value"))


def write_topic(df: DataFrame, servers: str, topic: str, key: str, line: Column) -> None:
    """Keyed messages to a Kafka topic, acknowledged by all replicas; needs Spark's Kafka connector."""
    messages(df, key, line).write.format("kafka").options(**message_options(servers, topic)).save()
