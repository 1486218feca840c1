"""Ride life cycles: one ride per user and day, whose stages are the user's first events of four kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rillstone.operators import patterns
from rillstone.operators.joins import lookup_join
from rillstone.plans.common import events, shown
from rillstone.sources.files import table

_STAGES = {"view": "requested", "click": "matched", "signup": "started", "purchase": "completed"}
_TIMES = [f"{s}_at" for s in _STAGES.values()]
_PERIOD = 30 * 86400


def _log(spark: SparkSession, folder: str) -> DataFrame:
    status = None
    for kind, stage in _STAGES.items():
        hit = F.col("event_type") == kind
        status = F.when(hit, stage) if status is None else status.when(hit, stage)
    log = events(spark, folder, "event_id", "user_id", "ts", "event_type").select(
        "event_id", "user_id", F.to_date("ts").cast("string").alias("day"), status.alias("status"), "ts"
    )
    return log.filter("status IS NOT NULL")


def _rides(spark: SparkSession, folder: str) -> DataFrame:
    return patterns.life_cycle(_log(spark, folder), ["user_id", "day"], "status", "ts", list(_STAGES.values()))


def ride_stages(spark: SparkSession, folder: str) -> DataFrame:
    return shown(_rides(spark, folder), *_TIMES)


def ride_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """How often each status follows each other one within a ride, and whether that is one stage on."""
    steps = patterns.transitions(_log(spark, folder), ["user_id", "day"], ["ts", "event_id"], "status", list(_STAGES.values()))
    return steps.groupBy("from_status", "status", "forward").agg(F.count(F.lit(1)).alias("n"))


def ride_wait_by_city(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("city"))
    home = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    rides = lookup_join(_rides(spark, folder).filter("in_order"), home, {"user_id": "c_custkey"}, "inner")
    placed = lookup_join(rides, nation, {"c_nationkey": "n_nationkey"}, "inner")
    return patterns.mean_wait(placed, ["city"], "requested_at", "matched_at")


def driver_utilisation(spark: SparkSession, folder: str) -> DataFrame:
    done = _rides(spark, folder).filter("in_order AND completed_at IS NOT NULL")
    return patterns.utilisation(done, "user_id", "started_at", "completed_at", _PERIOD)


def ride_too_long(spark: SparkSession, folder: str) -> DataFrame:
    late = patterns.too_long(_rides(spark, folder).filter("in_order"), "started_at", "completed_at", 6 * 3600)
    return shown(late.select("user_id", "day", "started_at", "completed_at"), "started_at", "completed_at")


QUERIES = {f.__name__: f for f in (ride_stages, ride_transitions, ride_wait_by_city, driver_utilisation, ride_too_long)}

_RIDES = """
SELECT *, (matched_at IS NULL OR coalesce(requested_at <= matched_at, false))
      AND (started_at IS NULL OR coalesce(matched_at <= started_at, false))
      AND (completed_at IS NULL OR coalesce(started_at <= completed_at, false)) AS in_order
FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day,
             min(ts) FILTER (WHERE event_type = 'view') AS requested_at,
             min(ts) FILTER (WHERE event_type = 'click') AS matched_at,
             min(ts) FILTER (WHERE event_type = 'signup') AS started_at,
             min(ts) FILTER (WHERE event_type = 'purchase') AS completed_at
      FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase') GROUP BY 1, 2)
"""


def _text(*names: str) -> str:
    return ", ".join(f"strftime({n}, '%Y-%m-%d %H:%M:%S') AS {n}" for n in names)


def _span(earlier: str, later: str) -> str:
    return f"CAST(sum(CAST(floor(epoch({later})) AS BIGINT) - CAST(floor(epoch({earlier})) AS BIGINT)) AS BIGINT)"


ORACLES = {
    "ride_stages": f"SELECT user_id, day, {_text(*_TIMES)}, in_order FROM ({_RIDES})",
    "ride_transitions": """
        SELECT from_status, status, list_position(['requested', 'matched', 'started', 'completed'], status)
               - coalesce(list_position(['requested', 'matched', 'started', 'completed'], from_status), 0) = 1 AS forward,
               count(*) AS n
        FROM (SELECT status, lag(status) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS from_status FROM (
          SELECT event_id, user_id, ts, strftime(ts, '%Y-%m-%d') AS day, CASE event_type WHEN 'view' THEN 'requested'
                 WHEN 'click' THEN 'matched' WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'completed' END AS status
          FROM events) WHERE status IS NOT NULL) GROUP BY ALL""",
    "ride_wait_by_city": f"""
        SELECT n_name AS city, count(*) AS rides, {_span("requested_at", "matched_at")} AS wait_seconds,
               CAST({_span("requested_at", "matched_at")} AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mean_wait
        FROM ({_RIDES}) JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey
        WHERE in_order AND matched_at IS NOT NULL AND requested_at IS NOT NULL GROUP BY 1""",
    "driver_utilisation": f"""
        SELECT user_id, {_span("started_at", "completed_at")} AS busy_seconds,
               CAST({_span("started_at", "completed_at")} AS DOUBLE) / CAST({_PERIOD} AS DOUBLE) AS utilisation
        FROM ({_RIDES}) WHERE in_order AND completed_at IS NOT NULL GROUP BY 1""",
    "ride_too_long": f"""
        SELECT user_id, day, {_text("started_at", "completed_at")} FROM ({_RIDES})
        WHERE in_order AND completed_at - started_at > INTERVAL 6 HOUR""",
}
