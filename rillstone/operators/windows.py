"""Time windows: tumbling, sliding and session, for static and streaming input."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rillstone.functions.text import fill
from rillstone.functions.time import MILLIS, SECONDS, text


def windowed(
    df: DataFrame, time: str, size: str, aggs: Sequence[Column], keys: Sequence[str] = (), slide: str | None = None
) -> DataFrame:
    """Aggregates per window and key, with `window_start` and `window_end`.

    Windows are [start, end), aligned to the epoch.  Without `slide` they tumble; without keys there is one
    row per window.  Partial aggregation runs before the shuffle, so neither case gathers raw rows in a task.
    """
    bounds = F.window(time, size, slide) if slide else F.window(time, size)
    out = df.groupBy(bounds.alias("window"), *keys).agg(*aggs)
    return out.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        *[c for c in out.columns if c != "window"],
    )


#: An aggregate of rows, and how aggregates of parts become one.
Mergeable = tuple[Column, Callable[[str], Column]]


def sliding_by_panes(
    df: DataFrame, time: str, size_seconds: int, slide_seconds: int, aggs: Mapping[str, Mergeable], keys: Sequence[str] = ()
) -> DataFrame:
    """Sliding windows from panes: rows are aggregated once per pane and key, and windows from the panes they hold.

    A row isn't copied for each window that it is in: what is copied, and shuffled again, is one row per pane and key.  A pane
    is as long as the greatest common divisor of size and slide.  `aggs` names mergeable aggregates, such as
    `{"total": (F.sum("cents"), F.sum), "n": (F.count(F.lit(1)), F.sum)}`.  On a stream with a watermark both steps are
    stateful: run it with `single_stateful=False`.
    """
    pane = math.gcd(size_seconds, slide_seconds)
    parts = df.groupBy(F.window(time, f"{pane} seconds").alias("_pane"), *keys).agg(*[part.alias(name) for name, (part, _) in aggs.items()])
    # the time of a pane is its last microsecond
    timed = parts.withColumn("_time", F.window_time("_pane"))
    return windowed(
        timed, "_time", f"{size_seconds} seconds", [merge(name).alias(name) for name, (_, merge) in aggs.items()], keys,
        f"{slide_seconds} seconds",
    )


def stamp_arrival(df: DataFrame, name: str = "arrived_at", at: Column | None = None) -> DataFrame:
    """Adds the processing time, constant within a micro-batch; windows over it are processing-time windows.

    `at` replays recorded arrival times instead of the clock, so that the same windows come out again.
    """
    return df.withColumn(name, F.current_timestamp() if at is None else at)


def sessions(df: DataFrame, time: str, gap_seconds: int, keys: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """Batch sessions closed by inactivity longer than the gap: start, last, end, event count and sums.

    Two events exactly one gap apart share a session.  Events of a key are first reduced to slices no longer
    than the gap, all of whose events surely belong together, so what is ordered per key is bounded by the
    covered time over the gap and not by the number of events.
    """
    gap = gap_seconds * 1_000_000
    stamped = df.withColumn("_at", F.unix_micros(F.col(time).cast("timestamp")))
    # events in [k*gap, (k+1)*gap) lie closer together than the gap
    slices = stamped.groupBy(*keys, (F.col("_at") - F.pmod("_at", F.lit(gap))).alias("_slice")).agg(
        F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.count(F.lit(1)).alias("events"),
        *[F.sum(c).alias(c) for c in sums],
    )
    w = Window.partitionBy(*keys).orderBy("_slice")
    opened = (F.col("_first") - F.lag("_last").over(w) > gap) | F.lag("_last").over(w).isNull()
    numbered = slices.withColumn("_open", opened.cast("int")).withColumn("_session", F.sum("_open").over(w))
    return (
        numbered.groupBy(*keys, "_session")
        .agg(
            F.timestamp_micros(F.min("_first")).alias("session_start"),
            F.timestamp_micros(F.max("_last")).alias("last_event"),
            F.timestamp_micros(F.max("_last") + gap).alias("session_end"),
            F.sum("events").alias("events"),
            *[F.sum(c).alias(c) for c in sums],
        )
        .drop("_session")
    )


def streaming_sessions(df: DataFrame, time: str, gap: str, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Session summaries of a stream; with a watermark and append mode a row is emitted on timeout."""
    out = df.groupBy(F.session_window(time, gap).alias("session"), *keys).agg(*aggs)
    return out.select(
        F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"),
        *[c for c in out.columns if c != "session"],
    )


def window_line(key_label: str, key: str, value_label: str, value: str) -> Column:
    """`Store: S1 | Total Sales: 31 | Window: [start → end]`."""
    template = f"{key_label}: {{}} | {value_label}: {{}} | Window: [{{}} → {{}}]"
    return fill(template, key, value, text(F.col("window_start")), text(F.col("window_end")))


def count_sum_line(key: str, count: str, total: str) -> Column:
    """`WindowStart=..., Key=..., Count=..., Sum=...`."""
    return fill("WindowStart={}, Key={}, Count={}, Sum={}", text(F.col("window_start"), SECONDS), key, count, total)


def total_line(time: str, total: str) -> Column:
    """`2024-01-01 00:00:05.000,35`."""
    return fill("{},{}", text(F.col(time), MILLIS), total)
