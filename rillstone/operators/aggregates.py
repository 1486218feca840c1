"""Grouped aggregates and the final state of the rolling ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from rillstone.functions.text import trim_controls
from rillstone.operators.rolling import extreme_record


def word_count(df: DataFrame, line: str, prefix: str | None = None, trim: bool = True) -> DataFrame:
    """Occurrences of each line; a line is the word.  The case-sensitive prefix is tested before trimming."""
    if prefix is not None:
        df = df.filter(F.col(line).startswith(prefix))
    word = trim_controls(F.col(line)) if trim else F.col(line)
    return df.groupBy(word.alias("word")).agg(F.count(F.lit(1)).alias("n"))


def truncated_mean(column: str) -> Column:
    """Average of an integer column as an integer, cut towards zero."""
    return F.expr(f"sum(`{column}`) div nullif(count(`{column}`), 0)")


def final_state(
    df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], record: Sequence[str]
) -> DataFrame:
    """Per key the last emission of every rolling aggregate: count, sum, min, max, mean and extreme records.

    Null values count as rows and nothing else: not in the mean, nor as an extreme.
    """
    def ranked(largest: bool, last: bool) -> Column:
        return extreme_record(df, value, order, record, largest, last)

    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(value).alias("total"),
        F.avg(value).alias("_mean"),
        F.min(value).alias("smallest"),
        F.max(value).alias("largest"),
        F.min(ranked(False, False)).alias("_min_first"),
        F.min(ranked(False, True)).alias("_min_last"),
        F.max(ranked(True, False)).alias("_max_first"),
        F.max(ranked(True, True)).alias("_max_last"),
    )
    records = ("min_first", "min_last", "max_first", "max_last")
    return out.select(
        *keys, "n", "total", "smallest", "largest", F.col("_mean").alias("mean"),
        *[F.col(f"_{r}")["_r"].alias(r) for r in records],
    )


def ratio_report(df: DataFrame, keys: Sequence[str], total: str, rows: str, amount: str) -> DataFrame:
    """Sum of `amount`, number of rows and their quotient per key."""
    return df.groupBy(*keys).agg(
        F.sum(amount).alias(total),
        F.count(F.lit(1)).alias(rows),
        (F.sum(amount) / F.count(F.lit(1))).alias("average"),
    )


def merged_ratio(df: DataFrame, keys: Sequence[str], total: str, rows: str) -> DataFrame:
    """`ratio_report` from partial sums and counts."""
    return df.groupBy(*keys).agg(
        F.sum(total).alias(total), F.sum(rows).alias(rows), (F.sum(total) / F.sum(rows)).alias("average")
    )


def top_groups(df: DataFrame, group: Sequence[str], item: Sequence[str], k: int, count: str = "n") -> DataFrame:
    """The `k` most frequent items of each group; ties go to the smaller item.

    Counting is partially aggregated, and ranking keeps `k` rows per group and task before its shuffle.
    """
    counted = df.groupBy(*group, *item).agg(F.count(F.lit(1)).alias(count))
    w = Window.partitionBy(*group).orderBy(F.desc(count), *item)
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def largest(df: DataFrame, item: str, value: str) -> DataFrame:
    """The one item with the largest sum of `value`; ties go to the smaller item."""
    return df.groupBy(item).agg(F.sum(value).alias(value)).orderBy(F.desc(value), item).limit(1)


def most_frequent(df: DataFrame, item: str, count: str = "n") -> DataFrame:
    """The one item with the most rows; ties go to the smaller item."""
    return df.groupBy(item).agg(F.count(F.lit(1)).alias(count)).orderBy(F.desc(count), item).limit(1)


def frequent(df: DataFrame, keys: Sequence[str], above: int, count: str = "n") -> DataFrame:
    """Keys with more than `above` rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count)).filter(F.col(count) > above)


def conversion(df: DataFrame, keys: Sequence[str], kind: str, seen: str, bought: str) -> DataFrame:
    """Views, purchases and purchases per view; the rate is null without views."""
    return df.groupBy(*keys).agg(
        F.count_if(F.col(kind) == seen).alias("views"),
        F.count_if(F.col(kind) == bought).alias("purchases"),
    ).withColumn("rate", F.col("purchases") / F.nullif(F.col("views"), F.lit(0)))


def accumulate(
    df: DataFrame,
    keys: Sequence[str],
    schema: str,
    add: Callable[[pd.DataFrame], pd.DataFrame],
    merge: Callable[[pd.DataFrame], pd.DataFrame],
    flush_rows: int = 200_000,
) -> DataFrame:
    """A user-defined aggregate for what the built-in ones cannot express.

    `add` turns rows into accumulators and `merge` combines accumulators, both to one row per key with the
    columns of `schema`.  Each task merges its own batches before the shuffle, so a heavy key sends at most a
    few accumulators per task.
    """
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            if len(batch) == 0:
                continue
            fresh = add(batch)
            held = fresh if held is None else merge(pd.concat([held, fresh], ignore_index=True))
            if len(held) > flush_rows:  # too many keys to hold
                yield held
                held = None
        if held is not None:
            yield held

    return df.mapInPandas(partial, schema).groupBy(*keys).applyInPandas(merge, schema)
