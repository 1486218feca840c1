"""Enrichment reports: spending per segment and order-to-shipment delay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rillstone.operators.joins import lookup_join


def spend_by(
    facts: DataFrame, key: str, amount: Column, profiles: DataFrame, profile_key: str, group: str, max_rows: int | None = None
) -> DataFrame:
    """Total `amount` per profile attribute.

    Amounts are summed per fact key before the lookup: partial aggregation takes a heavy key apart, and the
    join is one row per key whether the profiles are broadcast or shuffled.
    """
    per_key = facts.groupBy(key).agg(F.sum(amount).alias("amount"), F.count(F.lit(1)).alias("n"))
    known = lookup_join(per_key, profiles.select(profile_key, group), {key: profile_key}, "inner", max_rows=max_rows)
    return known.groupBy(group).agg(F.sum("amount").alias("amount"), F.sum("n").alias("n"))


def ship_delay(
    orders: DataFrame, shipments: DataFrame, order: str, customer: str, ordered: str, shipment_order: str, shipped: str
) -> DataFrame:
    """Days from order to shipment per customer: sum, number of shipments and mean.

    Shipments are reduced per order first: with day numbers, the sum of differences is the sum of ship days
    minus count times order day.
    """
    per_order = shipments.groupBy(F.col(shipment_order).alias(order)).agg(
        F.sum(F.unix_date(F.col(shipped).cast("date")).cast("bigint")).alias("_days"),
        F.count(shipped).alias("_n"),
    )
    joined = orders.select(order, customer, F.unix_date(F.col(ordered).cast("date")).alias("_day")).join(per_order, order)
    return (
        joined.groupBy(customer)
        .agg(F.sum(F.col("_days") - F.col("_n") * F.col("_day")).alias("days"), F.sum("_n").alias("shipments"))
        .withColumn("mean_days", F.col("days") / F.col("shipments"))
    )
