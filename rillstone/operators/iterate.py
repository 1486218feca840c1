"""Bounded iteration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rillstone.session import stored, use_checkpoints

_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def iterate_rows(
    df: DataFrame,
    start: Column,
    step: Callable[[Column], Column],
    done: Callable[[Column, Column], Column],
    max_rounds: int,
    name: str = "state",
) -> DataFrame:
    """Feeds each row's value back through `step` until `done(before, after)` holds or the rounds are spent.

    Adds `name`, a struct of `value`, `rounds` used and `done`.  Rows do not depend on each other, so the
    whole loop is one expression in one stage.  `step` must keep the type of `start`.
    """
    state = F.struct(start.alias("value"), F.lit(0).alias("rounds"), F.lit(False).alias("done"))

    def turn(s: Column, _: Column) -> Column:
        after = step(s["value"])
        moved = F.struct(
            after.alias("value"), (s["rounds"] + 1).alias("rounds"), done(s["value"], after).alias("done")
        )
        return F.when(s["done"], s).otherwise(moved)

    return df.withColumn(name, F.aggregate(F.sequence(F.lit(1), F.lit(max_rounds)), state, turn))


def count_up(df: DataFrame, start: Column, limit: int, max_rounds: int) -> DataFrame:
    """Adds one at least once and until `limit` is reached."""
    return iterate_rows(df, start, lambda x: x + 1, lambda _, x: x >= limit, max_rounds)


def steps_to(df: DataFrame, start: Column, target: int, max_rounds: int) -> DataFrame:
    """`number` and `steps` of the rows that reach `target` by adding one; a row already there takes none."""
    pair = F.struct(start.cast("bigint").alias("number"), F.lit(0).alias("steps"))

    def step(x: Column) -> Column:
        moved = F.struct((x["number"] + 1).alias("number"), (x["steps"] + 1).alias("steps"))
        return F.when(x["number"] == target, x).otherwise(moved)

    out = iterate_rows(df, pair, step, lambda _, x: x["number"] == target, max_rounds)
    return out.filter(F.col("state.done")).select(*df.columns, "state.value.number", "state.value.steps")


def converge(df: DataFrame, start: Column, factor: float, offset: float, tolerance: float, max_rounds: int) -> DataFrame:
    """`x <- x * factor + offset` until the change is below `tolerance`."""
    return iterate_rows(
        df, start.cast("double"), lambda x: x * factor + offset, lambda a, b: F.abs(b - a) < tolerance, max_rounds
    )


def iterate_frame(
    df: DataFrame, step: Callable[[DataFrame], DataFrame], done: Column, max_rounds: int
) -> tuple[DataFrame, DataFrame]:
    """Loop whose rows interact: (finished rows, rows left after `max_rounds`).

    Every round applies `step` to the active rows and moves those that fulfil `done` to the result.  Each
    round is checkpointed to the shared folder, so a lost executor costs one round.
    """
    use_checkpoints(df.sparkSession)
    active, finished = df, None
    for _ in range(max_rounds):
        moved = step(active).checkpoint()
        out = moved.filter(done)
        finished = out if finished is None else finished.unionByName(out)
        active = moved.filter(~F.coalesce(done, F.lit(False)))
        if active.isEmpty():
            break
    return finished, active


def recurse(spark: SparkSession, columns: str, seed: str, step: str, max_depth: int, **frames: DataFrame) -> DataFrame:
    """Recursive SQL: the rows of `seed` and those that `step`, which reads `loop(columns)`, makes of the rows of the round before.

    Both are SELECTs over `{name}` for each of the frames.  The loop ends when a round makes no rows; one that
    is not done after `max_depth` rounds is an error.  There is no limit on rows.  The result is stored.
    """
    before = spark.conf.get(_ROW_LIMIT, None)
    spark.conf.set(_ROW_LIMIT, "-1")
    try:
        query = f"WITH RECURSIVE loop({columns}) MAX RECURSION LEVEL {max_depth} AS (({seed}) UNION ALL ({step})) SELECT * FROM loop"
        return stored(spark.sql(query, **frames), "recursion")
    finally:
        spark.conf.unset(_ROW_LIMIT) if before is None else spark.conf.set(_ROW_LIMIT, before)
