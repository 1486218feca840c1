"""Rule-based transaction scoring: one stateless projection, the same on static and streaming input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rillstone.functions.text import fill
from rillstone.functions.time import millis_text
from rillstone.operators.rolling import roll, rolling_sum, with_lags

# Fixed values of the rule set.  Scores are hundredths: whole numbers decide the boundary cases exactly.
AMOUNT_TIERS = [(100000, 35, "VERY_HIGH_AMOUNT"), (50000, 25, "HIGH_AMOUNT"), (20000, 15, "MEDIUM_AMOUNT")]
LOW_AMOUNT, LOW_SCORE, LOW_TEXT = 50, 10, "VERY_LOW_AMOUNT"
SAME_PLACE, OTHER_PLACE, OTHER_PLACE_TEXT = -10, 10, "CROSS_LOCATION"
USUAL_CURRENCIES = ["USD", "EUR", "INR", "GBP", "JPY", "AUD"]
CURRENCY_SCORE, CURRENCY_TEXT = 8, "UNUSUAL_CURRENCY"
ROUND_UNIT, ROUND_ABOVE, ROUND_SCORE, ROUND_TEXT = 1000, 50000, 12, "ROUND_AMOUNT_PATTERN"
TOP_SCORE, FLAG_ABOVE = 100, 35
ALERT = (
    "🚨 FRAUD DETECTED\n  TxnID: {} | Amount: ${} {} | Score: {}\n  Route: {} → {}\n  Reasons: {}\n  Time: {}\n"
)
NORMAL = "✓ NORMAL | TxnID: {} | ${} {} | {} → {} | Score: {} | Time: {}"


def _tagged(text: str, inner: Column) -> Column:
    return F.concat(F.lit(f"{text}("), inner, F.lit(")"))


def score(df: DataFrame) -> DataFrame:
    """Adds `score` (hundredths), `is_fraud` and the `reasons` array to transactions."""
    amount, source, destination, currency = (F.col(c) for c in ("amount", "source", "destination", "currency"))
    dollars = F.concat(F.lit("$"), amount.cast("string"))
    tier_score = tier_text = None
    for above, points, text in AMOUNT_TIERS:
        hit = amount > above
        tier_score = F.when(hit, points) if tier_score is None else tier_score.when(hit, points)
        tier_text = F.when(hit, _tagged(text, dollars)) if tier_text is None else tier_text.when(hit, _tagged(text, dollars))
    low = amount < LOW_AMOUNT
    moved = source != destination
    unusual = ~currency.isin(USUAL_CURRENCIES)
    rounded = (amount % ROUND_UNIT == 0) & (amount > ROUND_ABOVE)
    total = (
        tier_score.otherwise(0)
        + F.when(low, LOW_SCORE).otherwise(0)
        + F.when(moved, OTHER_PLACE).otherwise(SAME_PLACE)
        + F.when(unusual, CURRENCY_SCORE).otherwise(0)
        + F.when(rounded, ROUND_SCORE).otherwise(0)
    )
    reasons = F.array(
        tier_text,
        F.when(low, _tagged(LOW_TEXT, dollars)),
        F.when(moved, _tagged(OTHER_PLACE_TEXT, F.concat(source, F.lit("->"), destination))),
        F.when(unusual, _tagged(CURRENCY_TEXT, currency)),
        F.when(rounded, F.lit(ROUND_TEXT)),
    )
    return (
        df.withColumn("score", F.least(total, F.lit(TOP_SCORE)))
        .withColumn("is_fraud", F.col("score") > FLAG_ABOVE)
        .withColumn("reasons", F.array_compact(reasons))
    )


def flagged(df: DataFrame) -> DataFrame:
    return df.filter("is_fraud")


def normal(df: DataFrame) -> DataFrame:
    return df.filter("NOT is_fraud")


def reason_text(separator: str = " | ") -> Column:
    return F.array_join("reasons", separator)


def score_text() -> Column:
    """The score as a number with two decimals."""
    return (F.col("score") / 100).cast("decimal(5,2)")


def alert_text() -> Column:
    """The multi-line alert of a flagged transaction."""
    return fill(
        ALERT, "txn_id", "amount", "currency", score_text(), "source", "destination", reason_text(),
        millis_text(F.col("ts")),
    )


def normal_text() -> Column:
    """The one-line report of a transaction that is not flagged."""
    return fill(NORMAL, "txn_id", "amount", "currency", "source", "destination", score_text(), millis_text(F.col("ts")))


def velocity(
    df: DataFrame, keys: list[str], time: str, seconds: int, at_least: int, rows_per_task: int | None = None
) -> DataFrame:
    """Seconds in which a key had `at_least` records within the last `seconds`, this second included.

    Records are counted per key and second first.  Each count then enters a running sum and leaves it again
    when its time is over, so a busy key costs no more than its number of distinct seconds.
    """
    stamped = df.select(*keys, F.unix_seconds(F.col(time).cast("timestamp")).alias("second"))
    per_second = stamped.groupBy(*keys, "second").agg(F.count(F.lit(1)).alias("n"))
    change = F.array(
        F.struct(F.col("second"), F.lit(1).alias("arrival"), F.col("n").alias("delta")),
        F.struct((F.col("second") + seconds + 1).alias("second"), F.lit(0).alias("arrival"), (-F.col("n")).alias("delta")),
    )
    changes = per_second.select(*keys, F.inline(change))
    return (
        roll(changes, keys, ["second", "arrival"], rolling_sum("delta", "n_recent"), probe=stamped, rows_per_task=rows_per_task)
        .filter((F.col("arrival") == 1) & (F.col("n_recent") >= at_least))
        .select(*keys, "second", "n_recent")
    )


def high_velocity(
    df: DataFrame, keys: list[str], time: str, amount: str, above: float, seconds: int, at_least: int, rows_per_task: int | None = None
) -> DataFrame:
    """`velocity` of the records whose amount is above a limit."""
    return velocity(df.filter(F.col(amount) > above), keys, time, seconds, at_least, rows_per_task)


def place_changes(
    df: DataFrame, keys: list[str], order: list[str], place: str, seconds: int, rows_per_task: int | None = None
) -> DataFrame:
    """Records in another place than the key's preceding record, at most `seconds` after it.

    `order` starts with the time.  Two records in different places within the limit have such a step between them or
    among the records in between.
    """
    seen = df.filter(F.col(place).isNotNull() & F.col(order[0]).isNotNull())
    lagged = with_lags(seen, keys, order, [place, order[0]], 1, "_before_", rows_per_task)
    before = F.col("_before_1")
    span = F.unix_micros(F.col(order[0]).cast("timestamp")) - F.unix_micros(before[order[0]].cast("timestamp"))
    moved = lagged.filter((before[place] != F.col(place)) & (span <= seconds * 1_000_000))
    return moved.select(*df.columns, before[place].alias("from_place"))
