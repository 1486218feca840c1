"""Sinks read back: delimited files, a declared CSV table, text lines and partitioned parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rillstone import sinks
from rillstone.encoded import write_encoded
from rillstone.operators.parsing import TRANSACTION
from rillstone.plans import basics
from rillstone.session import fresh_dir
from rillstone.sources import files

_DDL = ", ".join(f"{n} {t}" for n, t in TRANSACTION.items())


def _written(spark: SparkSession, folder: str, separator: str) -> str:
    path = fresh_dir(spark, "delimited")
    sinks.write_delimited(basics.parse_good(spark, folder), path, separator)
    return path


def sink_delimited(spark: SparkSession, folder: str) -> DataFrame:
    return files.delimited(spark, _written(spark, folder, " "), _DDL, " ")


def table_from_csv(spark: SparkSession, folder: str) -> DataFrame:
    df = files.csv_table(spark, "declared_transactions", _DDL, _written(spark, folder, ","))
    return df.filter(F.col("amount") > 50000).select("txn_id", "amount", "currency")


def sink_text(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_dir(spark, "text")
    sinks.write_text(basics.frequent_buyers(spark, folder), path)
    return files.lines(spark, path).withColumnRenamed("value", "line")


def sink_partitioned(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_dir(spark, "partitioned")
    sinks.write_partitioned(basics.json_anomaly(spark, folder), path, ["k"])
    return spark.read.schema("event_id bigint, user_id bigint, k int").parquet(path)


def sink_encoded(spark: SparkSession, folder: str) -> DataFrame:
    """Rows written by an encoder of our own, all files published together, and read as lines."""
    path = fresh_dir(spark, "encoded")
    write_encoded(basics.json_anomaly(spark, folder), path, "rillstone.encoded.pairs_line")
    return files.lines(spark, path).withColumnRenamed("value", "line")


QUERIES = {f.__name__: f for f in (sink_delimited, table_from_csv, sink_text, sink_partitioned, sink_encoded)}

ORACLES = {
    "sink_delimited": basics.ORACLES["parse_good"],
    "table_from_csv": f"SELECT txn_id, amount, currency FROM ({basics.ORACLES['parse_good']}) WHERE amount > 50000",
    "sink_text": f"SELECT '(' || user_id || ',' || n || ')' AS line FROM ({basics.ORACLES['frequent_buyers']})",
    "sink_encoded": f"""
        SELECT 'event_id=' || event_id || ';user_id=' || user_id || ';k=' || k AS line FROM ({basics.ORACLES['json_anomaly']})""",
    "sink_partitioned": basics.ORACLES["json_anomaly"],
}
