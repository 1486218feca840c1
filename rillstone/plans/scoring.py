"""Transaction scoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rillstone.operators import fraud
from rillstone.plans.common import EVENTS_SQL, SCORED_INPUT_SQL, events, scored_input
from rillstone.sources.files import table


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return fraud.score(scored_input(table(spark, folder, "orders"), spark, folder))


def fraud_score(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("txn_id", "amount", "score", "is_fraud")


def fraud_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("txn_id", fraud.reason_text().alias("reasons"))


def fraud_flagged(spark: SparkSession, folder: str) -> DataFrame:
    return fraud.flagged(_scored(spark, folder)).select("txn_id", "score")


def fraud_normal(spark: SparkSession, folder: str) -> DataFrame:
    return fraud.normal(_scored(spark, folder)).select("txn_id", "score")


def format_alert(spark: SparkSession, folder: str) -> DataFrame:
    return fraud.flagged(_scored(spark, folder)).select("txn_id", fraud.alert_text().alias("alert"))


def format_normal(spark: SparkSession, folder: str) -> DataFrame:
    return fraud.normal(_scored(spark, folder)).select("txn_id", fraud.normal_text().alias("line"))


def velocity_1min(spark: SparkSession, folder: str) -> DataFrame:
    return fraud.velocity(events(spark, folder, "user_id", "ts"), ["user_id"], "ts", 60, 2)


def velocity_high_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """Several high amounts within a minute."""
    return fraud.high_velocity(events(spark, folder, "user_id", "ts", "cents"), ["user_id"], "ts", "cents", 5000, 60, 2)


def velocity_two_places(spark: SparkSession, folder: str) -> DataFrame:
    """One user in two places within a minute; the kind of event stands for the place."""
    df = events(spark, folder, "event_id", "user_id", "ts", "event_type")
    moved = fraud.place_changes(df, ["user_id"], ["ts", "event_id"], "event_type", 60)
    return moved.select("event_id", "user_id", "event_type", "from_place")


QUERIES = {
    f.__name__: f
    for f in (fraud_score, fraud_reasons, fraud_flagged, fraud_normal, format_alert, format_normal, velocity_1min,
              velocity_high_amounts, velocity_two_places)
}

_SCORED = f"""
SELECT *, score > 35 AS is_fraud FROM (
  SELECT *, least(100,
      CASE WHEN amount > 100000 THEN 35 WHEN amount > 50000 THEN 25 WHEN amount > 20000 THEN 15 ELSE 0 END
    + CASE WHEN amount < 50 THEN 10 ELSE 0 END
    + CASE WHEN source = destination THEN -10 ELSE 10 END
    + CASE WHEN currency NOT IN ('USD','EUR','INR','GBP','JPY','AUD') THEN 8 ELSE 0 END
    + CASE WHEN amount % 1000 = 0 AND amount > 50000 THEN 12 ELSE 0 END) AS score,
    concat_ws(' | ',
      CASE WHEN amount > 100000 THEN 'VERY_HIGH_AMOUNT($' || amount || ')'
           WHEN amount > 50000 THEN 'HIGH_AMOUNT($' || amount || ')'
           WHEN amount > 20000 THEN 'MEDIUM_AMOUNT($' || amount || ')' END,
      CASE WHEN amount < 50 THEN 'VERY_LOW_AMOUNT($' || amount || ')' END,
      CASE WHEN source <> destination THEN 'CROSS_LOCATION(' || source || '->' || destination || ')' END,
      CASE WHEN currency NOT IN ('USD','EUR','INR','GBP','JPY','AUD') THEN 'UNUSUAL_CURRENCY(' || currency || ')' END,
      CASE WHEN amount % 1000 = 0 AND amount > 50000 THEN 'ROUND_AMOUNT_PATTERN' END) AS reasons
  FROM ({SCORED_INPUT_SQL}))
"""
_TIME = "strftime(epoch_ms(ts), '%Y-%m-%d %H:%M:%S')"

ORACLES = {
    "fraud_score": f"SELECT txn_id, amount, score, is_fraud FROM ({_SCORED})",
    "fraud_reasons": f"SELECT txn_id, reasons FROM ({_SCORED})",
    "fraud_flagged": f"SELECT txn_id, score FROM ({_SCORED}) WHERE is_fraud",
    "fraud_normal": f"SELECT txn_id, score FROM ({_SCORED}) WHERE NOT is_fraud",
    "format_alert": f"""
        SELECT txn_id, '🚨 FRAUD DETECTED' || chr(10) || '  TxnID: ' || txn_id || ' | Amount: $' || amount || ' ' || currency
          || ' | Score: ' || printf('%.2f', score / 100.0::DOUBLE) || chr(10)
          || '  Route: ' || source || ' → ' || destination || chr(10) || '  Reasons: ' || reasons || chr(10)
          || '  Time: ' || {_TIME} || chr(10) AS alert
        FROM ({_SCORED}) WHERE is_fraud""",
    "format_normal": f"""
        SELECT txn_id, '✓ NORMAL | TxnID: ' || txn_id || ' | $' || amount || ' ' || currency || ' | ' || source || ' → '
          || destination || ' | Score: ' || printf('%.2f', score / 100.0::DOUBLE) || ' | Time: ' || {_TIME} AS line
        FROM ({_SCORED}) WHERE NOT is_fraud""",
    "velocity_1min": f"""
        SELECT DISTINCT user_id, sec AS second, n_recent FROM (
          SELECT user_id, sec, count(*) OVER (PARTITION BY user_id ORDER BY sec
                 RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS n_recent
          FROM ({EVENTS_SQL})) WHERE n_recent >= 2""",
    "velocity_high_amounts": f"""
        SELECT DISTINCT user_id, sec AS second, n_recent FROM (
          SELECT user_id, sec, count(*) OVER (PARTITION BY user_id ORDER BY sec
                 RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS n_recent
          FROM ({EVENTS_SQL}) WHERE cents > 5000) WHERE n_recent >= 2""",
    "velocity_two_places": """
        SELECT event_id, user_id, event_type, from_place FROM (
          SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_place,
                 lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_ts FROM events)
        WHERE from_place <> event_type AND ts - from_ts <= INTERVAL 60 SECOND""",
}
