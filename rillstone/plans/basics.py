"""Word counts, parsing, routing and relational queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rillstone.functions.time import text
from rillstone.operators import aggregates, parsing, routing
from rillstone.operators.rolling import roll, rolling_sum
from rillstone.plans.common import CURRENCIES, amounts, events, instant, shown
from rillstone.sources.files import json_fields, table


def word_count(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.word_count(table(spark, folder, "events"), "event_type")


def word_count_filter(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.word_count(table(spark, folder, "events"), "event_type", prefix="e")


def length_parity(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "events").select("event_id", F.length("event_type").alias("size"))
    df = df.select("event_id", (F.col("size") % 2).alias("parity"), F.col("size").cast("bigint").alias("size"))
    return roll(df, ["parity"], ["event_id"], rolling_sum("size", "rolling_size")).drop("size")


def _report_lines(spark: SparkSession, folder: str) -> DataFrame:
    """date,month,priority,status,amount lines; the date is not used by the reader."""
    day = instant("o_orderdate")
    line = F.concat_ws(
        ",", text(day, "dd-MM-yyyy"), text(day, "MMMM"), "o_orderpriority", "o_orderstatus",
        F.floor("o_totalprice").cast("int").cast("string"),
    )
    return table(spark, folder, "orders").select("o_orderkey", line.alias("line"))


def parse_delimited(spark: SparkSession, folder: str) -> DataFrame:
    layout = {"month": (1, "string"), "category": (2, "string"), "product": (3, "string"), "profit": (4, "int")}
    return parsing.pick(_report_lines(spark, folder), "line", layout)


def transaction_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Transaction lines as they arrive: pending orders have no time yet, some amounts are not numbers."""
    key = F.col("o_orderkey")
    amount = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "x").otherwise(
        F.floor("o_totalprice").cast("int").cast("string")
    )
    line = F.concat_ws(
        ",",
        F.concat(F.lit("TXN"), key.cast("string")),
        amount,
        F.element_at(F.array(*[F.lit(c) for c in CURRENCIES]), (key % 8 + 1).cast("int")),
        F.concat(F.lit("N"), (F.col("o_custkey") % 25).cast("string")),
        F.concat(F.lit("N"), (key % 25).cast("string")),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.unix_millis(instant("o_orderdate")).cast("string")),
    )
    return table(spark, folder, "orders").select(line.alias("line"))


def parse_good(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.parse(transaction_lines(spark, folder), "line")


def parse_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.rejects(transaction_lines(spark, folder), "line")


def _transactions(spark: SparkSession, folder: str) -> DataFrame:
    return amounts(table(spark, folder, "orders"))


def table_high_value(spark: SparkSession, folder: str) -> DataFrame:
    return _transactions(spark, folder).filter(F.col("amount") > 50000).select("txn_id", "amount", "currency")


def table_avg_by_currency(spark: SparkSession, folder: str) -> DataFrame:
    return _transactions(spark, folder).groupBy("currency").agg(
        aggregates.truncated_mean("amount").cast("int").alias("avg_amount")
    )


def _by_parity(spark: SparkSession, folder: str) -> DataFrame:
    return routing.parity(table(spark, folder, "events").select("event_id", "event_type"), "event_id")


def split_even(spark: SparkSession, folder: str) -> DataFrame:
    return routing.route(_by_parity(spark, folder), "even")


def split_odd(spark: SparkSession, folder: str) -> DataFrame:
    return routing.route(_by_parity(spark, folder), "odd")


def split_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _by_parity(spark, folder).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def split_three_way(spark: SparkSession, folder: str) -> DataFrame:
    classes = routing.speed_classes(table(spark, folder, "events").select("event_id", "value"), "value")
    return classes.select("event_id", "tag")


def json_anomaly(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "events").select("event_id", "user_id", "props")
    read = json_fields(df, "props", "k int")
    return read.filter((F.col("k") > 90) | (F.col("k") < 5))


def frequent_buyers(spark: SparkSession, folder: str) -> DataFrame:
    bought = table(spark, folder, "events").filter(F.col("event_type") == "purchase")
    return aggregates.frequent(bought, ["user_id"], 3)


def conversion_rate(spark: SparkSession, folder: str) -> DataFrame:
    df = json_fields(table(spark, folder, "events").select("event_type", "props"), "props", "k int")
    return aggregates.conversion(df, ["k"], "event_type", "view", "purchase")


def top5_per_window(spark: SparkSession, folder: str) -> DataFrame:
    viewed = events(spark, folder, "ts", "event_type", "props").filter(F.col("event_type") == "view")
    items = json_fields(viewed.select("ts", "props"), "props", "k int")
    hours = items.select(F.window("ts", "1 hour")["start"].alias("hour"), "k")
    return shown(aggregates.top_groups(hours, ["hour"], ["k"], 5, "views"), "hour")


_LINES_SQL = """
SELECT 'TXN' || o_orderkey || ',' ||
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'x' ELSE CAST(CAST(floor(o_totalprice) AS INTEGER) AS VARCHAR) END
       || ',' || list_element(['USD','EUR','INR','GBP','JPY','AUD','CHF','XAU'], CAST(o_orderkey % 8 + 1 AS BIGINT))
       || ',N' || (o_custkey % 25) || ',N' || (o_orderkey % 25) || ',' ||
       CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(epoch_ms(o_orderdate) AS VARCHAR) END AS line,
       o_orderstatus = 'P' AS short, o_orderpriority = '4-NOT SPECIFIED' AS wordy,
       'TXN' || o_orderkey AS txn_id, CAST(floor(o_totalprice) AS INTEGER) AS amount,
       list_element(['USD','EUR','INR','GBP','JPY','AUD','CHF','XAU'], CAST(o_orderkey % 8 + 1 AS BIGINT)) AS currency,
       'N' || (o_custkey % 25) AS source, 'N' || (o_orderkey % 25) AS destination, epoch_ms(o_orderdate) AS ts
FROM orders
"""
_TXN_SQL = """
SELECT 'TXN' || o_orderkey AS txn_id, CAST(floor(o_totalprice) AS INTEGER) AS amount,
       list_element(['USD','EUR','INR','GBP','JPY','AUD','CHF','XAU'], CAST(o_orderkey % 8 + 1 AS BIGINT)) AS currency
FROM orders
"""

QUERIES = {
    f.__name__: f
    for f in (
        word_count, word_count_filter, length_parity, parse_delimited, parse_good, parse_rejects, table_high_value,
        table_avg_by_currency, split_even, split_odd, split_counts, split_three_way, json_anomaly, frequent_buyers,
        conversion_rate, top5_per_window,
    )
}

ORACLES = {
    "word_count": "SELECT trim(event_type) AS word, count(*) AS n FROM events GROUP BY 1",
    "word_count_filter": "SELECT event_type AS word, count(*) AS n FROM events WHERE event_type LIKE 'e%' GROUP BY 1",
    "length_parity": """
        SELECT event_id, CAST(length(event_type) % 2 AS INTEGER) AS parity,
               CAST(sum(length(event_type)) OVER (PARTITION BY length(event_type) % 2 ORDER BY event_id
                    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS rolling_size
        FROM events""",
    "parse_delimited": """
        SELECT o_orderkey, strftime(o_orderdate, '%B') AS month, o_orderpriority AS category,
               o_orderstatus AS product, CAST(floor(o_totalprice) AS INTEGER) AS profit
        FROM orders""",
    "parse_good": f"""
        SELECT txn_id, amount, currency, source, destination, ts FROM ({_LINES_SQL}) WHERE NOT short AND NOT wordy""",
    "parse_rejects": f"""
        SELECT line, CASE WHEN short THEN 'column count' ELSE 'bad amount' END AS reason
        FROM ({_LINES_SQL}) WHERE short OR wordy""",
    "table_high_value": f"SELECT txn_id, amount, currency FROM ({_TXN_SQL}) WHERE amount > 50000",
    "table_avg_by_currency": f"""
        SELECT currency, CAST(CAST(sum(amount) AS BIGINT) // count(amount) AS INTEGER) AS avg_amount
        FROM ({_TXN_SQL}) GROUP BY 1""",
    "split_even": "SELECT event_id, event_type FROM events WHERE event_id % 2 = 0",
    "split_odd": "SELECT event_id, event_type FROM events WHERE event_id % 2 <> 0",
    "split_counts": """
        SELECT CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS tag, count(*) AS n FROM events GROUP BY 1""",
    "split_three_way": """
        SELECT event_id, CASE WHEN value <= 60 THEN 'normal' WHEN value <= 80 THEN 'minor' ELSE 'major' END AS tag
        FROM events""",
    "json_anomaly": """
        SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
        WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 90
           OR CAST(json_extract_string(props, '$.k') AS INTEGER) < 5""",
    "frequent_buyers": """
        SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) > 3""",
    "conversion_rate": """
        SELECT k, views, purchases, CAST(purchases AS DOUBLE) / CAST(nullif(views, 0) AS DOUBLE) AS rate FROM (
          SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
                 count(*) FILTER (WHERE event_type = 'view') AS views,
                 count(*) FILTER (WHERE event_type = 'purchase') AS purchases
          FROM events GROUP BY 1)""",
    "top5_per_window": """
        SELECT strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, k, views, CAST(rank AS INTEGER) AS rank FROM (
          SELECT hour, k, views, row_number() OVER (PARTITION BY hour ORDER BY views DESC, k) AS rank FROM (
            SELECT date_trunc('hour', ts) AS hour, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
                   count(*) AS views
            FROM events WHERE event_type = 'view' GROUP BY 1, 2)) WHERE rank <= 5""",
}
