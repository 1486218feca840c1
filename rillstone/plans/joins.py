"""Join queries: lines whose quantity equals the pack size of their part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rillstone.operators import enrich, joins
from rillstone.operators.inequality import inequality_join
from rillstone.operators.nearest import nearest_join
from rillstone.plans.common import cents, events, shown
from rillstone.sources.files import table

_ON = ["id", "size"]


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), F.col("p_name").alias("name")
    )
    line = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("id"), F.col("l_quantity").cast("int").alias("size"), F.col("l_linestatus").alias("state")
    )
    return part, line


def _named(how: str):
    return lambda spark, folder: joins.named_join(*_sides(spark, folder), _ON, how)


def _hinted(strategy: str):
    return lambda spark, folder: joins.hinted_join(*_sides(spark, folder), _ON, strategy)


def _sql(hint: str):
    condition = "l.id = r.id AND l.size = r.size"
    # the part is the side that may be copied
    return lambda spark, folder: joins.sql_join(*reversed(_sides(spark, folder)), hint, condition, "l.id, l.size, name, state")


def join_theta(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    region = table(spark, folder, "region")
    return joins.theta_join(customer, region, F.col("c_nationkey") < F.col("r_regionkey"))


def join_less(spark: SparkSession, folder: str) -> DataFrame:
    """Customers who owe more than a supplier in debt."""
    customer = table(spark, folder, "customer").select("c_custkey", cents("c_acctbal").alias("owed"))
    supplier = table(spark, folder, "supplier").select("s_suppkey", cents("s_acctbal").alias("balance")).where("balance < 0")
    return inequality_join(customer, supplier, [("owed", "<", "balance")])


def _priced(spark: SparkSession, folder: str, above: int) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ordered"), cents("o_totalprice").alias("low"),
        (cents("o_totalprice") + above).alias("high"),
    )
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("shipped"), cents("l_extendedprice").alias("price")
    )
    return orders, lines


def join_between(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and the lines whose price lies between the order's total and 25 cents more."""
    met = inequality_join(*_priced(spark, folder, 25), [("low", "<=", "price"), ("high", ">=", "price")])
    return met.select("o_orderkey", "low", "l_orderkey", "l_linenumber", "price")


def join_two_inequalities(spark: SparkSession, folder: str) -> DataFrame:
    """Lines up to 60 cents dearer than an order and shipped before it was made."""
    near = [("low", "<", "price"), ("high", ">=", "price"), ("ordered", ">", "shipped")]
    met = inequality_join(*_priced(spark, folder, 60), near)
    return met.select("o_orderkey", "low", "l_orderkey", "l_linenumber", "price")


def sql_hint_nest_loop(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    region = table(spark, folder, "region")
    return joins.sql_join(
        customer, region, "NEST_LOOP", "l.c_nationkey < r.r_regionkey", "c_custkey, c_nationkey, r_regionkey, r_name"
    )


def join_asof(spark: SparkSession, folder: str) -> DataFrame:
    both = events(spark, folder, "event_id", "user_id", "ts", "event_type", "cents")
    bought = both.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts", "cents")
    seen = both.filter(F.col("event_type") == "view").select(
        F.col("event_id").alias("view_id"), "user_id", F.col("ts").alias("view_ts"), F.col("cents").alias("view_cents")
    )
    out = joins.asof_join(
        bought, seen, ["user_id"], ["ts", "event_id"], ["view_ts", "view_id"], ["view_id", "view_ts", "view_cents"],
        inclusive=False,
    )
    return shown(out, "ts", "view_ts")


def join_window(spark: SparkSession, folder: str) -> DataFrame:
    both = events(spark, folder, "user_id", "ts", "event_type", "cents")
    out = joins.window_join(
        both.filter(F.col("event_type") == "click"), both.filter(F.col("event_type") == "purchase"), ["user_id"],
        "ts", "ts", "1 hour", None,
        [F.count(F.lit(1)).alias("clicks"), F.sum("cents").alias("click_cents")],
        [F.count(F.lit(1)).alias("purchases"), F.sum("cents").alias("purchase_cents")],
    )
    return shown(out.withColumn("pairs", F.col("clicks") * F.col("purchases")), "window_start", "window_end")


def join_window_sliding(spark: SparkSession, folder: str) -> DataFrame:
    both = events(spark, folder, "user_id", "ts", "event_type")
    out = joins.window_join(
        both.filter(F.col("event_type") == "click"), both.filter(F.col("event_type") == "purchase"), ["user_id"],
        "ts", "ts", "2 hours", "1 hour", [F.count(F.lit(1)).alias("clicks")], [F.count(F.lit(1)).alias("purchases")],
    )
    return shown(out.withColumn("pairs", F.col("clicks") * F.col("purchases")), "window_start", "window_end")


def order_ship_delay(spark: SparkSession, folder: str) -> DataFrame:
    return enrich.ship_delay(
        table(spark, folder, "orders"), table(spark, folder, "lineitem"),
        "o_orderkey", "o_custkey", "o_orderdate", "l_orderkey", "l_shipdate",
    )


def enrich_spend_by_segment(spark: SparkSession, folder: str) -> DataFrame:
    return enrich.spend_by(
        table(spark, folder, "orders"), "o_custkey", cents("o_totalprice"), table(spark, folder, "customer"),
        "c_custkey", "c_mktsegment",
    )


def _placed(df: DataFrame, key: str, lat: str, lon: str, shift: Column) -> DataFrame:
    """Positions derived from the key; equal keys of two tables lie `shift` degrees apart."""
    return df.select(
        key,
        ((F.col(key) * 7919 % 16001) / 100.0 - 80.0 + shift).alias(lat),
        ((F.col(key) * 104729 % 36007) / 100.0 - 180.0).alias(lon),
    )


def join_nearby(spark: SparkSession, folder: str) -> DataFrame:
    rides = _placed(table(spark, folder, "customer"), "c_custkey", "lat", "lon", (F.col("c_custkey") % 7) * 0.004)
    drivers = _placed(table(spark, folder, "supplier"), "s_suppkey", "driver_lat", "driver_lon", F.lit(0.0))
    near = joins.nearby_join(rides, drivers, ("lat", "lon"), ("driver_lat", "driver_lon"), 2.0)
    return near.select("c_custkey", "s_suppkey", F.round(F.col("distance_km") * 1000).cast("bigint").alias("metres"))


def join_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The driver nearest to each ride, however far away."""
    rides = _placed(table(spark, folder, "customer"), "c_custkey", "lat", "lon", (F.col("c_custkey") % 7) * 0.004)
    drivers = _placed(table(spark, folder, "supplier"), "s_suppkey", "driver_lat", "driver_lon", F.lit(0.0))
    near = nearest_join(rides, drivers, ("lat", "lon"), ("driver_lat", "driver_lon"), "s_suppkey")
    return near.select("c_custkey", "s_suppkey", "metres")


QUERIES = {
    **{f"join_{how}": _named(how) for how in ("inner", "left", "right", "full")},
    **{f"join_hint_{s}": _hinted(s) for s in joins.STRATEGIES},
    **{f"sql_hint_{h.lower()}": _sql(h) for h in ("BROADCAST", "SHUFFLE_HASH")},
    "sql_hint_merge": _sql("SHUFFLE_MERGE"),
    **{
        f.__name__: f
        for f in (
            sql_hint_nest_loop, join_theta, join_less, join_between, join_two_inequalities, join_asof, join_window, join_window_sliding, join_nearby, join_nearest,
            order_ship_delay, enrich_spend_by_segment,
        )
    },
}


def _join_sql(kind: str) -> str:
    return f"""
        SELECT coalesce(p_partkey, l_partkey) AS id, coalesce(p_size, CAST(l_quantity AS INTEGER)) AS size,
               coalesce(p_name, 'NULL') AS name, coalesce(l_linestatus, 'NULL') AS state
        FROM part {kind} JOIN lineitem ON p_partkey = l_partkey AND p_size = CAST(l_quantity AS INTEGER)"""


_THETA = "SELECT c_custkey, c_nationkey, r_regionkey, r_name FROM customer JOIN region ON c_nationkey < r_regionkey"


def _window_sql(size: int, totals: str) -> str:
    side = """SELECT user_id, w, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS c
              FROM (SELECT *, unnest(range(0, {size})) AS back FROM events WHERE event_type = '{kind}') e,
                   LATERAL (SELECT date_trunc('hour', ts) - back * INTERVAL 1 HOUR AS w) GROUP BY 1, 2"""
    return f"""
        SELECT strftime(a.w, '%Y-%m-%d %H:%M:%S') AS window_start,
               strftime(a.w + INTERVAL {size} HOUR, '%Y-%m-%d %H:%M:%S') AS window_end,
               a.user_id, a.n AS clicks, b.n AS purchases, {totals} a.n * b.n AS pairs
        FROM ({side.format(size=size, kind='click')}) a JOIN ({side.format(size=size, kind='purchase')}) b
          ON a.user_id = b.user_id AND a.w = b.w"""


def _priced_sql(condition: str) -> str:
    return f"""
        SELECT o_orderkey, low, l_orderkey, l_linenumber, price
        FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS low FROM orders)
        JOIN (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS price FROM lineitem) ON {condition}"""


ORACLES = {
    "join_less": """
        SELECT c_custkey, owed, s_suppkey, balance
        FROM (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS owed FROM customer)
        JOIN (SELECT s_suppkey, CAST(round(s_acctbal * 100) AS BIGINT) AS balance FROM supplier) ON owed < balance
        WHERE balance < 0""",
    "join_between": _priced_sql("price BETWEEN low AND low + 25"),
    "join_two_inequalities": _priced_sql("price > low AND price <= low + 60 AND o_orderdate > l_shipdate"),
    "join_inner": _join_sql("INNER"),
    "join_left": _join_sql("LEFT"),
    "join_right": _join_sql("RIGHT"),
    "join_full": _join_sql("FULL"),
    **{f"join_hint_{s}": _join_sql("INNER") for s in joins.STRATEGIES},
    **{f"sql_hint_{h}": _join_sql("INNER") for h in ("broadcast", "shuffle_hash", "merge")},
    "sql_hint_nest_loop": _THETA,
    "join_theta": _THETA,
    "join_asof": """
        SELECT p.event_id, p.user_id, strftime(p.ts, '%Y-%m-%d %H:%M:%S') AS ts,
               CAST(round(p.value * 100) AS BIGINT) AS cents, v.event_id AS view_id,
               strftime(v.ts, '%Y-%m-%d %H:%M:%S') AS view_ts, CAST(round(v.value * 100) AS BIGINT) AS view_cents
        FROM (SELECT * FROM events WHERE event_type = 'purchase') p
        ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
          ON p.user_id = v.user_id AND p.ts > v.ts""",
    "join_nearby": """
        SELECT c_custkey, s_suppkey, CAST(round(km * 1000) AS BIGINT) AS metres FROM (
          SELECT c_custkey, s_suppkey, 2 * 6371.0::DOUBLE * asin(sqrt(
              pow(sin(radians(b.lat - a.lat) / 2), 2)
              + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) AS km
          FROM (SELECT c_custkey, (c_custkey * 7919 % 16001) / 100.0::DOUBLE - 80 + (c_custkey % 7) * 0.004::DOUBLE AS lat,
                       (c_custkey * 104729 % 36007) / 100.0::DOUBLE - 180 AS lon FROM customer) a
          JOIN (SELECT s_suppkey, (s_suppkey * 7919 % 16001) / 100.0::DOUBLE - 80 AS lat,
                       (s_suppkey * 104729 % 36007) / 100.0::DOUBLE - 180 AS lon FROM supplier) b
            ON abs(a.lat - b.lat) < 0.02::DOUBLE)
        WHERE km < 2""",
    "join_nearest": """
        SELECT c_custkey, s_suppkey, metres FROM (
          SELECT c_custkey, s_suppkey, metres, row_number() OVER (PARTITION BY c_custkey ORDER BY metres, s_suppkey) AS place FROM (
            SELECT c_custkey, s_suppkey, CAST(round(2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE,
                pow(sin(radians(b.lat - a.lat) / 2), 2)
                + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) * 1000) AS BIGINT) AS metres
            FROM (SELECT c_custkey, (c_custkey * 7919 % 16001) / 100.0::DOUBLE - 80 + (c_custkey % 7) * 0.004::DOUBLE AS lat,
                         (c_custkey * 104729 % 36007) / 100.0::DOUBLE - 180 AS lon FROM customer) a,
                 (SELECT s_suppkey, (s_suppkey * 7919 % 16001) / 100.0::DOUBLE - 80 AS lat,
                         (s_suppkey * 104729 % 36007) / 100.0::DOUBLE - 180 AS lon FROM supplier) b))
        WHERE place = 1""",
    "join_window": _window_sql(1, "a.c AS click_cents, b.c AS purchase_cents,"),
    "join_window_sliding": _window_sql(2, ""),
    "order_ship_delay": """
        SELECT o_custkey, CAST(sum(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS BIGINT) AS days,
               count(*) AS shipments,
               CAST(sum(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS DOUBLE)
                 / CAST(count(*) AS DOUBLE) AS mean_days
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""",
    "enrich_spend_by_segment": """
        SELECT c_mktsegment, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS amount, count(*) AS n
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
}
