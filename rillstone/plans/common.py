"""Inputs and renderings shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rillstone.functions.time import SECONDS, text
from rillstone.operators.joins import lookup_join
from rillstone.operators.sizing import fits_broadcast
from rillstone.sources.files import table

CURRENCIES = ["USD", "EUR", "INR", "GBP", "JPY", "AUD", "CHF", "XAU"]


def cents(column: str) -> Column:
    """Money as whole cents, so that sums do not depend on the order of addition."""
    return F.round(F.col(column) * 100).cast("bigint")


def instant(column: str) -> Column:
    return F.col(column).cast("timestamp")


def events(spark: SparkSession, folder: str, *columns: str | Column) -> DataFrame:
    """The event table with `ts` as an instant and `cents`."""
    return in_cents(table(spark, folder, "events")).select(*columns)


def in_cents(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", instant("ts")).withColumn("cents", cents("value"))


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """Render time columns as text."""
    return df.select(*[text(F.col(c), SECONDS).alias(c) if c in columns else F.col(c) for c in df.columns])


def amounts(orders: DataFrame) -> DataFrame:
    """Orders, static or streaming, as transactions without places: no join, and no order is lost."""
    code = F.element_at(F.array(*[F.lit(c) for c in CURRENCIES]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return orders.select(
        F.concat(F.lit("TXN"), F.col("o_orderkey").cast("string")).alias("txn_id"),
        F.floor("o_totalprice").cast("int").alias("amount"),
        code.alias("currency"),
    )


def scored_input(orders: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Orders, static or streaming, as transactions.

    The source is the customer's nation, the destination and the currency are derived from the order key.
    """
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    code = F.element_at(F.array(*[F.lit(c) for c in CURRENCIES]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    base = orders.select(
        "o_custkey",
        F.concat(F.lit("TXN"), F.col("o_orderkey").cast("string")).alias("txn_id"),
        F.floor("o_totalprice").cast("int").alias("amount"),
        code.alias("currency"),
        (F.col("o_orderkey") % 25).cast("int").alias("_to"),
        F.unix_millis(instant("o_orderdate")).alias("ts"),
    )
    with_source = lookup_join(base, customer, {"o_custkey": "c_custkey"}, "inner")
    small = fits_broadcast(nation)
    place = lambda name: nation.withColumnRenamed("n_name", name)
    named = lookup_join(with_source, place("source"), {"c_nationkey": "n_nationkey"}, "inner", small=small)
    named = lookup_join(named, place("destination"), {"_to": "n_nationkey"}, "inner", small=small)
    return named.select("txn_id", "amount", "currency", "source", "destination", "ts")


# the same transactions for the SQL side
SCORED_INPUT_SQL = """
SELECT 'TXN' || o_orderkey AS txn_id, CAST(floor(o_totalprice) AS INTEGER) AS amount,
       list_element(['USD','EUR','INR','GBP','JPY','AUD','CHF','XAU'], CAST(o_orderkey % 8 + 1 AS BIGINT)) AS currency,
       s.n_name AS source, d.n_name AS destination, epoch_ms(o_orderdate) AS ts
FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation s ON c_nationkey = s.n_nationkey JOIN nation d ON o_orderkey % 25 = d.n_nationkey
"""
EVENTS_SQL = """
SELECT event_id, ts, user_id, event_type, value, props, CAST(round(value * 100) AS BIGINT) AS cents,
       CAST(floor(epoch(ts)) AS BIGINT) AS sec
FROM events
"""
