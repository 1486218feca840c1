"""Batch windows over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rillstone.operators import windows
from rillstone.operators.windows import windowed
from rillstone.plans.common import EVENTS_SQL, events, shown

_BOUNDS = ("window_start", "window_end")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder, "ts", "user_id", "event_type", "cents")


def window_tumbling_sales(spark: SparkSession, folder: str) -> DataFrame:
    out = windowed(_events(spark, folder), "ts", "1 hour", [F.sum("cents").alias("total")], ["user_id", "event_type"])
    return shown(out, *_BOUNDS)


def window_count_sum(spark: SparkSession, folder: str) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("cents").alias("total")]
    return shown(windowed(_events(spark, folder), "ts", "1 hour", aggs, ["event_type"]), *_BOUNDS)


def window_count_sum_lines(spark: SparkSession, folder: str) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("cents").alias("total")]
    out = windowed(_events(spark, folder), "ts", "1 hour", aggs, ["event_type"])
    return out.select(windows.count_sum_line("event_type", "n", "total").alias("line"))


def window_total_lines(spark: SparkSession, folder: str) -> DataFrame:
    out = windowed(_events(spark, folder), "ts", "1 hour", [F.sum("cents").alias("total")])
    return out.select(windows.total_line("window_end", "total").alias("line"))


def window_all_sum(spark: SparkSession, folder: str) -> DataFrame:
    return shown(windowed(_events(spark, folder), "ts", "1 hour", [F.sum("cents").alias("total")]), *_BOUNDS)


def window_sliding_sum(spark: SparkSession, folder: str) -> DataFrame:
    aggs = [F.sum("cents").alias("total")]
    return shown(windowed(_events(spark, folder), "ts", "2 hours", aggs, ["event_type"], "1 hour"), *_BOUNDS)


def window_sliding_avg(spark: SparkSession, folder: str) -> DataFrame:
    aggs = [(F.sum("cents") / F.count(F.lit(1))).alias("mean_cents")]
    return shown(windowed(_events(spark, folder), "ts", "3 hours", aggs, ["event_type"], "1 hour"), *_BOUNDS)


def window_sliding_panes(spark: SparkSession, folder: str) -> DataFrame:
    """`window_sliding_avg` from one row per hour and kind."""
    aggs = {"n": (F.count(F.lit(1)), F.sum), "total": (F.sum("cents"), F.sum)}
    out = windows.sliding_by_panes(_events(spark, folder), "ts", 3 * 3600, 3600, aggs, ["event_type"])
    return shown(out.select(*_BOUNDS, "event_type", (F.col("total") / F.col("n")).alias("mean_cents")), *_BOUNDS)


def window_session(spark: SparkSession, folder: str) -> DataFrame:
    out = windows.sessions(_events(spark, folder), "ts", 6 * 3600, ["user_id"], ["cents"])
    return shown(out, "session_start", "last_event", "session_end")


QUERIES = {
    f.__name__: f
    for f in (
        window_tumbling_sales, window_count_sum, window_count_sum_lines, window_total_lines, window_all_sum,
        window_sliding_sum, window_sliding_avg, window_sliding_panes, window_session,
    )
}

_T = "'%Y-%m-%d %H:%M:%S'"


def window_sql(size: int, keys: str, aggs: str, where: str = "") -> str:
    """Windows of `size` hours that slide by one hour; epoch-aligned."""
    names = f"{keys}, " if keys else ""
    return f"""
        SELECT strftime(w, {_T}) AS window_start, strftime(w + INTERVAL {size} HOUR, {_T}) AS window_end, {names}{aggs}
        FROM (SELECT e.*, date_trunc('hour', ts) - back * INTERVAL 1 HOUR AS w
              FROM (SELECT *, unnest(range(0, {size})) AS back FROM ({EVENTS_SQL})) e)
        {where} GROUP BY {names}w"""


_SUM = "CAST(sum(cents) AS BIGINT) AS total"
ORACLES = {
    "window_tumbling_sales": window_sql(1, "user_id, event_type", _SUM),
    "window_count_sum": window_sql(1, "event_type", f"count(*) AS n, {_SUM}"),
    "window_count_sum_lines": f"""
        SELECT 'WindowStart=' || window_start || ', Key=' || event_type || ', Count=' || n || ', Sum=' || total AS line
        FROM ({window_sql(1, "event_type", f"count(*) AS n, {_SUM}")})""",
    "window_total_lines": f"SELECT window_end || '.000,' || total AS line FROM ({window_sql(1, '', _SUM)})",
    "window_all_sum": window_sql(1, "", _SUM),
    "window_sliding_sum": window_sql(2, "event_type", _SUM),
    "window_sliding_avg": window_sql(
        3, "event_type", "CAST(sum(cents) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mean_cents"
    ),
    "window_sliding_panes": window_sql(
        3, "event_type", "CAST(sum(cents) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mean_cents"
    ),
    "window_session": f"""
        SELECT user_id, strftime(min(ts), {_T}) AS session_start, strftime(max(ts), {_T}) AS last_event,
               strftime(max(ts) + INTERVAL 6 HOUR, {_T}) AS session_end,
               CAST(count(*) AS BIGINT) AS events, CAST(sum(cents) AS BIGINT) AS cents
        FROM (SELECT *, sum(opened) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
          SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR
                         THEN 0 ELSE 1 END AS opened
          FROM ({EVENTS_SQL})))
        GROUP BY user_id, s""",
}
