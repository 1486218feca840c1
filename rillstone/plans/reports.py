"""Iteration, sequence patterns and trip reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rillstone.operators import aggregates, iterate, patterns
from rillstone.plans.common import cents, events, shown
from rillstone.sources.files import table

_STEPS = ["error", "error", "error", "purchase"]


def _numbers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey")


def iterate_counter(spark: SparkSession, folder: str) -> DataFrame:
    out = iterate.count_up(_numbers(spark, folder), F.col("c_custkey") % 11, 10, 12)
    return out.select("c_custkey", F.col("state.value").alias("value"), F.col("state.rounds").alias("rounds"))


def iterate_to_ten(spark: SparkSession, folder: str) -> DataFrame:
    return iterate.steps_to(_numbers(spark, folder), F.col("c_custkey") % 11, 10, 11)


def _suppliers(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers in a tree: number n was brought in by number n / 3, number 0 by nobody."""
    supplier = table(spark, folder, "supplier")
    return supplier.select("s_suppkey", F.floor(F.col("s_suppkey") / 3).cast("bigint").alias("via"), cents("s_acctbal").alias("cents"))


def iterate_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Steps from each supplier to the root and the balances on the way, by a loop over joins with the table itself."""
    rows = _suppliers(spark, folder)
    above = rows.select(F.col("s_suppkey").alias("at"), F.col("via").alias("next"), F.col("cents").alias("more"))

    def step(active: DataFrame) -> DataFrame:
        met = active.join(above, "at")
        return met.select("s_suppkey", F.col("next").alias("at"), (F.col("steps") + 1).alias("steps"), (F.col("cents") + F.col("more")).alias("cents"))

    begun = rows.select("s_suppkey", F.col("via").alias("at"), F.lit(1).alias("steps"), "cents").where("s_suppkey > 0")
    finished, _ = iterate.iterate_frame(begun.where("at > 0"), step, F.col("at") == 0, 40)
    return finished.unionByName(begun.where("at = 0")).select("s_suppkey", "steps", "cents")


def iterate_recursive(spark: SparkSession, folder: str) -> DataFrame:
    """`iterate_tree` as recursive SQL."""
    loop = iterate.recurse(
        spark, "s_suppkey, at, steps, cents",
        "SELECT s_suppkey, via, 1, cents FROM {suppliers} WHERE s_suppkey > 0",
        "SELECT l.s_suppkey, s.via, l.steps + 1, l.cents + s.cents FROM loop l JOIN {suppliers} s ON l.at = s.s_suppkey WHERE l.at > 0",
        40, suppliers=_suppliers(spark, folder),
    )
    return loop.where("at = 0").select("s_suppkey", "steps", "cents")


def iterate_converge(spark: SparkSession, folder: str) -> DataFrame:
    out = iterate.converge(_numbers(spark, folder), F.col("c_custkey") % 101, 0.9, 5.0, 0.1, 10)
    return out.select(
        "c_custkey", F.round(F.col("state.value") * 1000000).cast("bigint").alias("value_millionths"),
        F.col("state.rounds").alias("rounds"), F.col("state.done").alias("converged"),
    )


def pattern_fail_then_success(spark: SparkSession, folder: str) -> DataFrame:
    df = events(spark, folder, "event_id", "user_id", "ts", "event_type")
    found = patterns.strict_sequence(df, ["user_id"], ["ts", "event_id"], "event_type", _STEPS, 3 * 86400)
    return shown(found.select("event_id", "user_id", "first_time", "ts"), "first_time", "ts")


def peak_hours(spark: SparkSession, folder: str) -> DataFrame:
    return patterns.peak_hours(events(spark, folder, "ts"), "ts")


def _trips(spark: SparkSession, folder: str) -> DataFrame:
    """Ongoing trips: a line is a trip, its supplier the driver, the supplier's nation the pickup place."""
    return table(spark, folder, "lineitem").filter(F.col("l_linestatus") == "O").select(
        "l_suppkey", (F.col("l_partkey") % 25).cast("bigint").alias("_to"), F.col("l_quantity").cast("bigint").alias("passengers")
    )


def _per_driver(spark: SparkSession, folder: str) -> DataFrame:
    """People and trips per supplier with the supplier's columns: the trips are summed before anything is joined."""
    summed = _trips(spark, folder).groupBy("l_suppkey").agg(F.sum("passengers").alias("passengers"), F.count(F.lit(1)).alias("trips"))
    supplier = table(spark, folder, "supplier").select("s_suppkey", F.col("s_name").alias("driver"), "s_nationkey")
    return summed.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))


def _named_place(df: DataFrame, spark: SparkSession, folder: str, key: str, name: str) -> DataFrame:
    nation = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias(name))
    return df.join(nation, F.col(key) == F.col("n_nationkey"))


def top_destination(spark: SparkSession, folder: str) -> DataFrame:
    """The place that most people travel to."""
    summed = _trips(spark, folder).groupBy("_to").agg(F.sum("passengers").alias("passengers"))
    named = _named_place(summed, spark, folder, "_to", "destination")
    return aggregates.largest(named.select("destination", "passengers"), "destination", "passengers")


def avg_per_pickup(spark: SparkSession, folder: str) -> DataFrame:
    places = _per_driver(spark, folder).groupBy("s_nationkey").agg(F.sum("passengers").alias("passengers"), F.sum("trips").alias("trips"))
    named = _named_place(places, spark, folder, "s_nationkey", "pickup")
    return aggregates.merged_ratio(named, ["pickup"], "passengers", "trips")


def avg_per_driver(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.merged_ratio(_per_driver(spark, folder), ["driver"], "passengers", "trips")


QUERIES = {
    f.__name__: f
    for f in (
        iterate_counter, iterate_to_ten, iterate_converge, iterate_tree, iterate_recursive, pattern_fail_then_success, peak_hours, top_destination,
        avg_per_pickup, avg_per_driver,
    )
}

_TRIPS = """
SELECT s_name AS driver, p.n_name AS pickup, d.n_name AS destination, CAST(l_quantity AS BIGINT) AS passengers
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation p ON s_nationkey = p.n_nationkey
JOIN nation d ON l_partkey % 25 = d.n_nationkey WHERE l_linestatus = 'O'
"""
_RATIO = """CAST(sum(passengers) AS BIGINT) AS passengers, count(*) AS trips,
            CAST(sum(passengers) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS average"""


def _lag(column: str, n: int) -> str:
    return f"lag({column}, {n}) OVER (PARTITION BY user_id ORDER BY ts, event_id)"


_TREE = """
    WITH RECURSIVE sup AS (SELECT s_suppkey, s_suppkey // 3 AS via, CAST(round(s_acctbal * 100) AS BIGINT) AS cents FROM supplier),
    loop(s_suppkey, via, steps, cents) AS (
        SELECT s_suppkey, via, 1, cents FROM sup WHERE s_suppkey > 0
        UNION ALL SELECT l.s_suppkey, r.via, l.steps + 1, l.cents + r.cents FROM loop l JOIN sup r ON l.via = r.s_suppkey WHERE l.via > 0)
    SELECT s_suppkey, steps, cents FROM loop WHERE via = 0"""

ORACLES = {
    "iterate_tree": _TREE,
    "iterate_recursive": _TREE,
    "iterate_counter": """
        SELECT c_custkey, greatest(c_custkey % 11 + 1, 10) AS value,
               CAST(greatest(c_custkey % 11 + 1, 10) - c_custkey % 11 AS INTEGER) AS rounds FROM customer""",
    "iterate_to_ten": """
        SELECT c_custkey, CAST(10 AS BIGINT) AS number, CAST(10 - c_custkey % 11 AS INTEGER) AS steps FROM customer""",
    "iterate_converge": """
        WITH RECURSIVE loop(c_custkey, x, rounds, done) AS (
          SELECT c_custkey, CAST(c_custkey % 101 AS DOUBLE), 0, false FROM customer
          UNION ALL
          SELECT c_custkey, x * CAST(0.9 AS DOUBLE) + CAST(5 AS DOUBLE), rounds + 1,
                 abs(x * CAST(0.9 AS DOUBLE) + CAST(5 AS DOUBLE) - x) < CAST(0.1 AS DOUBLE)
          FROM loop WHERE NOT done AND rounds < 10)
        SELECT c_custkey, CAST(round(arg_max(x, rounds) * 1000000) AS BIGINT) AS value_millionths,
               max(rounds) AS rounds, bool_or(done) AS converged
        FROM loop GROUP BY 1""",
    "pattern_fail_then_success": f"""
        SELECT event_id, user_id, strftime(first_time, '%Y-%m-%d %H:%M:%S') AS first_time,
               strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM (
          SELECT *, {_lag("event_type", 1)} AS b1, {_lag("event_type", 2)} AS b2, {_lag("event_type", 3)} AS b3,
                 {_lag("ts", 3)} AS first_time FROM events)
        WHERE event_type = 'purchase' AND b1 = 'error' AND b2 = 'error' AND b3 = 'error'
          AND ts - first_time <= INTERVAL 3 DAY""",
    "peak_hours": """
        SELECT hour, n, CAST(row_number() OVER (ORDER BY n DESC, hour) AS INTEGER) AS rank FROM (
          SELECT CAST(extract('hour' FROM ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY 1)""",
    "top_destination": f"""
        SELECT destination, CAST(sum(passengers) AS BIGINT) AS passengers FROM ({_TRIPS})
        GROUP BY 1 ORDER BY passengers DESC, destination LIMIT 1""",
    "avg_per_pickup": f"SELECT pickup, {_RATIO} FROM ({_TRIPS}) GROUP BY 1",
    "avg_per_driver": f"SELECT driver, {_RATIO} FROM ({_TRIPS}) GROUP BY 1",
}
