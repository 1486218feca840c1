"""Rolling aggregates per user, in event order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rillstone.operators import aggregates, rolling as r
from rillstone.plans.common import EVENTS_SQL, events

_ORDER = ["ts", "event_id"]
_RECORD = ["event_id", "event_type", "cents"]


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder, "event_id", "ts", "user_id", "event_type", "cents")


def _roll(spark: SparkSession, folder: str, *aggs: r.Rolling) -> DataFrame:
    return r.roll(_events(spark, folder), ["user_id"], _ORDER, *aggs)


def _field_only(agg: r.Rolling):
    """The aggregated field with the other fields of the key's first record."""
    def query(spark: SparkSession, folder: str) -> DataFrame:
        out = _roll(spark, folder, agg, r.rolling_first("event_type", "first_type"))
        return out.select("event_id", "user_id", "first_type", F.col(agg.name).alias("cents"))

    return query


def _record(agg: r.Rolling):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        kept = r.record_of(agg.name)
        out = _roll(spark, folder, agg)
        return out.select(
            "event_id", "user_id", kept["event_id"].alias("kept_id"), kept["event_type"].alias("kept_type"),
            kept["cents"].alias("kept_cents"),
        )

    return query


def rolling_avg(spark: SparkSession, folder: str) -> DataFrame:
    out = _roll(spark, folder, r.rolling_sum("cents", "total"), r.rolling_count("n"))
    return out.select("event_id", "user_id", (F.col("total") / F.col("n")).alias("mean_cents"))


def final_aggs(spark: SparkSession, folder: str) -> DataFrame:
    out = aggregates.final_state(_events(spark, folder), ["user_id"], "cents", _ORDER, ["event_id"])
    firsts: list[Column] = [F.col(c)["event_id"].alias(c) for c in ("min_first", "min_last", "max_first", "max_last")]
    return out.select("user_id", "n", "total", "smallest", "largest", "mean", *firsts)


def accumulator(spark: SparkSession, folder: str) -> DataFrame:
    """Count, sum and sum of squares by a user-defined accumulator."""
    whole = events(spark, folder, "event_type", F.floor("value").alias("total"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.groupby("event_type", as_index=False, dropna=False)[["n", "total", "squares"]].sum()

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return merge(pdf.assign(n=1, squares=pdf["total"] ** 2))

    schema = "event_type string, n bigint, total bigint, squares bigint"
    return aggregates.accumulate(whole, ["event_type"], schema, add, merge)


QUERIES = {
    "accumulator": accumulator,
    "rolling_sum": _field_only(r.rolling_sum("cents", "_sum")),
    "rolling_min": _field_only(r.rolling_min("cents", "_min")),
    "rolling_max": _field_only(r.rolling_max("cents", "_max")),
    "rolling_min_by": _record(r.rolling_min_by("cents", _RECORD, "_rec")),
    "rolling_min_by_last": _record(r.rolling_min_by("cents", _RECORD, "_rec", last=True)),
    "rolling_max_by": _record(r.rolling_max_by("cents", _RECORD, "_rec")),
    "rolling_max_by_last": _record(r.rolling_max_by("cents", _RECORD, "_rec", last=True)),
    "rolling_avg": rolling_avg,
    "final_aggs": final_aggs,
}

_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


def _field_sql(fn: str) -> str:
    return f"""
        SELECT event_id, user_id, first_value(event_type) {_W} AS first_type,
               CAST({fn}(cents) {_W} AS BIGINT) AS cents
        FROM ({EVENTS_SQL})"""


def _record_sql(fn: str, sign: str) -> str:
    """The extreme of one number made of the value and the signed event id, which follows event order."""
    code = f"cents * 1000000000000 {sign} event_id"
    return f"""
        SELECT a.event_id, a.user_id, k.event_id AS kept_id, k.event_type AS kept_type, k.cents AS kept_cents
        FROM (SELECT *, {fn}({code}) {_W} AS best FROM ({EVENTS_SQL})) a
        JOIN ({EVENTS_SQL}) k ON k.user_id = a.user_id AND a.best = k.cents * 1000000000000 {sign} k.event_id"""


ORACLES = {
    "accumulator": """
        SELECT event_type, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS total,
               CAST(sum(floor(value) * floor(value)) AS BIGINT) AS squares
        FROM events GROUP BY 1""",
    "rolling_sum": _field_sql("sum"),
    "rolling_min": _field_sql("min"),
    "rolling_max": _field_sql("max"),
    "rolling_min_by": _record_sql("min", "+"),
    "rolling_min_by_last": _record_sql("min", "-"),
    "rolling_max_by": _record_sql("max", "-"),
    "rolling_max_by_last": _record_sql("max", "+"),
    "rolling_avg": f"""
        SELECT event_id, user_id, CAST(sum(cents) {_W} AS DOUBLE) / CAST(count(*) {_W} AS DOUBLE) AS mean_cents
        FROM ({EVENTS_SQL})""",
    "final_aggs": f"""
        SELECT user_id, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total, min(cents) AS smallest, max(cents) AS largest,
               CAST(sum(cents) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mean,
               arg_min(event_id, cents * 1000000000000 + event_id) AS min_first,
               arg_min(event_id, cents * 1000000000000 - event_id) AS min_last,
               arg_max(event_id, cents * 1000000000000 - event_id) AS max_first,
               arg_max(event_id, cents * 1000000000000 + event_id) AS max_last
        FROM ({EVENTS_SQL}) GROUP BY 1""",
}
