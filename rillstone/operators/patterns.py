"""Event sequences of a key: strict patterns and life cycles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rillstone.operators.rolling import with_lags
from rillstone.operators.skew import position


def strict_sequence(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    status: str,
    steps: Sequence[str],
    within_seconds: int,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Rows that complete `steps` as consecutive events of their key, first to last within the limit.

    `order` starts with the event time.  Adds `first_time`, the time of the first step.
    """
    depth = len(steps) - 1
    lagged = with_lags(df, keys, order, [status, order[0]], depth, "_before_", rows_per_task)
    hit = F.col(status) == steps[-1]
    for back in range(1, depth + 1):
        hit = hit & (F.col(f"_before_{back}")[status] == steps[depth - back])
    matched = lagged.filter(hit).withColumn("first_time", F.col(f"_before_{depth}")[order[0]])
    span = position(matched, order[0]) - position(matched, "first_time")
    return matched.filter(span <= within_seconds * 1_000_000).select(*df.columns, "first_time")


def life_cycle(
    df: DataFrame, keys: Sequence[str], status: str, time: str, stages: Sequence[str], extra: Sequence[Column] = ()
) -> DataFrame:
    """One row per ride: the first time of every stage (`<stage>_at`) and whether the stages came in order.

    `in_order` is true when the stages reached so far have no gap and rising times.
    """
    times = [F.min(F.when(F.col(status) == s, F.col(time))).alias(f"{s}_at") for s in stages]
    out = df.groupBy(*keys).agg(*times, *extra)
    ok = F.lit(True)
    for earlier, later in zip(stages, stages[1:]):
        reached = F.col(f"{later}_at").isNotNull()
        ok = ok & (~reached | F.coalesce(F.col(f"{earlier}_at") <= F.col(f"{later}_at"), F.lit(False)))
    return out.withColumn("in_order", ok)


def transitions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], status: str, stages: Sequence[str], rows_per_task: int | None = None
) -> DataFrame:
    """Every change of status with the one before it (null for the first) and whether it goes one stage on.

    Repeats of a status and steps back are seen, unlike in `life_cycle`, which keeps the first time of each stage.
    """
    lagged = with_lags(df, keys, order, [status], 1, "_before_", rows_per_task)
    place = lambda c: F.array_position(F.array(*[F.lit(s) for s in stages]), c)
    before = F.col("_before_1")[status]
    step = place(F.col(status)) - F.coalesce(place(before), F.lit(0))
    return lagged.select(*df.columns, before.alias("from_status"), (step == 1).alias("forward"))


def too_long(df: DataFrame, started: str, ended: str, seconds: int) -> DataFrame:
    """Rows whose span between two times is longer than the limit."""
    return df.filter(F.col(ended).cast("timestamp") - F.expr(f"interval {seconds} seconds") > F.col(started).cast("timestamp"))


def mean_wait(df: DataFrame, keys: Sequence[str], asked: str, served: str) -> DataFrame:
    """Number of served rides, their total wait in whole seconds and the mean per key."""
    wait = F.unix_seconds(F.col(served).cast("timestamp")) - F.unix_seconds(F.col(asked).cast("timestamp"))
    return (
        df.filter(F.col(served).isNotNull() & F.col(asked).isNotNull())
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("rides"), F.sum(wait).alias("wait_seconds"))
        .withColumn("mean_wait", F.col("wait_seconds") / F.col("rides"))
    )


def utilisation(df: DataFrame, driver: str, started: str, ended: str, seconds: int) -> DataFrame:
    """Seconds each driver spent on rides and their share of a period of `seconds`."""
    busy = F.unix_seconds(F.col(ended).cast("timestamp")) - F.unix_seconds(F.col(started).cast("timestamp"))
    return (
        df.groupBy(driver)
        .agg(F.sum(busy).alias("busy_seconds"))
        .withColumn("utilisation", F.col("busy_seconds") / F.lit(seconds))
    )


def peak_hours(df: DataFrame, time: str) -> DataFrame:
    """Rows per hour of the day with their rank; at most 24 rows are ranked."""
    hours = df.groupBy(F.hour(F.col(time).cast("timestamp")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return hours.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "hour")))
