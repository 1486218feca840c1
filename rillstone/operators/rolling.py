"""Rolling keyed aggregates: one output row per input row, in an explicit order.

Each aggregate is described by how it looks inside an ordered group, what a whole group leaves behind, and
how that carry joins the values of the next group.  With that, a heavy key is cut into consecutive chunks that
run in parallel and the result is the same as one long window.  Light keys use a plain window: one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from rillstone.operators.skew import HEAVY, Cut, cut_heavy, position, same
from rillstone.session import stored


@dataclass(frozen=True)
class Rolling:
    """A rolling aggregate; `bind` receives the frame and the order columns."""

    name: str
    bind: Callable[[DataFrame, Sequence[str]], "_Bound"]
    wide: bool = False  # the window needs a copy of the record


@dataclass(frozen=True)
class _Bound:
    within: Callable[[WindowSpec], Column]
    total: Column
    fold: Callable[[Column], Column]
    merge: Callable[[Column, Column], Column]


def rolling_sum(column: str, name: str) -> Rolling:
    return Rolling(
        name,
        lambda df, order: _Bound(
            lambda w: F.sum(column).over(w),
            F.sum(column),
            F.sum,
            lambda carry, here: F.coalesce(carry + here, here, carry),
        ),
    )


def rolling_count(name: str) -> Rolling:
    return Rolling(
        name,
        lambda df, order: _Bound(
            lambda w: F.count(F.lit(1)).over(w),
            F.count(F.lit(1)),
            F.sum,
            lambda carry, here: F.coalesce(carry, F.lit(0)) + here,
        ),
    )


def rolling_min(column: str, name: str) -> Rolling:
    return Rolling(
        name, lambda df, order: _Bound(lambda w: F.min(column).over(w), F.min(column), F.min, F.least)
    )


def rolling_max(column: str, name: str) -> Rolling:
    return Rolling(
        name, lambda df, order: _Bound(lambda w: F.max(column).over(w), F.max(column), F.max, F.greatest)
    )


def rolling_first(column: str, name: str) -> Rolling:
    """The value of the key's first record."""

    def bind(df: DataFrame, order: Sequence[str]) -> _Bound:
        tagged = F.struct(*order, F.col(column).alias("_v"))
        return _Bound(
            lambda w: F.first(column).over(w),
            F.min(tagged),
            F.min,
            lambda carry, here: F.when(carry.isNotNull(), carry["_v"]).otherwise(here),
        )

    return Rolling(name, bind)


def rolling_last_known(column: str, name: str) -> Rolling:
    """The latest value that is not null."""

    def bind(df: DataFrame, order: Sequence[str]) -> _Bound:
        tagged = F.when(F.col(column).isNotNull(), F.struct(*order, F.col(column).alias("_v")))
        return _Bound(
            lambda w: F.last(column, ignorenulls=True).over(w),
            F.max(tagged),
            F.max,
            lambda carry, here: F.coalesce(here, carry["_v"]),
        )

    return Rolling(name, bind)


def extreme_record(df: DataFrame, column: str, order: Sequence[str], record: Sequence[str], largest: bool, last: bool) -> Column:
    """A struct whose minimum (or maximum) is the record with the extreme value, ties broken by order."""
    sign = 1 if largest == last else -1
    ranks = [(position(df, o) * sign).alias(f"_p{i}") for i, o in enumerate(order)]
    # a record without a value is no extreme
    return F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("_v"), *ranks, F.struct(*record).alias("_r")))


def rolling_min_by(column: str, record: Sequence[str], name: str, last: bool = False) -> Rolling:
    """Whole record holding the minimum so far; on ties the first one, or the last with `last=True`."""

    def bind(df: DataFrame, order: Sequence[str]) -> _Bound:
        ranked = extreme_record(df, column, order, record, largest=False, last=last)
        return _Bound(lambda w: F.min(ranked).over(w), F.min(ranked), F.min, F.least)

    return Rolling(name, bind, wide=True)


def rolling_max_by(column: str, record: Sequence[str], name: str, last: bool = False) -> Rolling:
    """Whole record holding the maximum so far; on ties the first one, or the last with `last=True`."""

    def bind(df: DataFrame, order: Sequence[str]) -> _Bound:
        ranked = extreme_record(df, column, order, record, largest=True, last=last)
        return _Bound(lambda w: F.max(ranked).over(w), F.max(ranked), F.max, F.greatest)

    return Rolling(name, bind, wide=True)


def record_of(name: str) -> Column:
    """The record kept by `rolling_min_by` / `rolling_max_by`."""
    return F.col(name)["_r"]


def roll(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *aggregates: Rolling,
    probe: DataFrame | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """`df` plus one column per rolling aggregate, per key in `order`.

    `probe` is a cheaper frame with the same keys and first order column for finding heavy keys, e.g. the
    input of an aggregation whose output is rolled.
    """
    bound = [(a.name, a.bind(df, order)) for a in aggregates]
    wide = any(a.wide for a in aggregates)
    cut = cut_heavy(df, keys, order, rows_per_task, probe)
    if cut is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        # shuffle first, so that the copies of the records are made behind the shuffle
        return (df.repartition(*keys) if wide else df).select("*", *[b.within(w).alias(n) for n, b in bound])

    chunked, chunks = cut.frame, cut.chunks
    inside = Window.partitionBy(*keys, *chunks).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(*chunks).rowsBetween(Window.unboundedPreceding, -1)
    totals = chunked.filter(HEAVY).groupBy(*keys, *chunks).agg(*[b.total.alias(n) for n, b in bound])
    # one row per chunk of a heavy key: rows / rows_per_task, times the ranges per task
    carries = totals.select(*keys, *chunks, *[b.fold(F.col(n)).over(before).alias(f"_carry_{n}") for n, b in bound])
    carries = stored(carries, "carries")  # their size is known then, and decides whether they are copied
    here = (chunked.repartition(*keys, *chunks) if wide else chunked).select("*", *[b.within(inside).alias(f"_here_{n}") for n, b in bound])
    return here.join(carries, same(here, carries, [*keys, *chunks]), "left").select(
        *[here[c] for c in df.columns],
        *[b.merge(carries[f"_carry_{n}"], here[f"_here_{n}"]).alias(n) for n, b in bound],
    )


def with_lags(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    depth: int,
    prefix: str = "lag_",
    rows_per_task: int | None = None,
) -> DataFrame:
    """`df` plus `lag_1` .. `lag_<depth>`: structs of `columns` of the preceding rows of the key."""
    value = F.struct(*columns)
    cut = cut_heavy(df, keys, order, rows_per_task)
    if cut is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[F.lag(value, i).over(w).alias(f"{prefix}{i}") for i in range(1, depth + 1)])

    chunked, chunks = cut.frame, cut.chunks
    inside = Window.partitionBy(*keys, *chunks).orderBy(*order)
    backwards = Window.partitionBy(*keys, *chunks).orderBy(*[F.desc(o) for o in order])
    before = Window.partitionBy(*keys).orderBy(*chunks).rowsBetween(-depth, -1)
    tagged = F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], value.alias("_v"))
    tails = (
        chunked.filter(HEAVY)
        .withColumn("_back", F.row_number().over(backwards))
        .filter(F.col("_back") <= depth)
        .groupBy(*keys, *chunks)
        .agg(F.collect_list(tagged).alias("_tail"))  # at most `depth` entries
    )
    halos = tails.select(*keys, *chunks, F.sort_array(F.flatten(F.collect_list("_tail").over(before))).alias("_halo"))
    halos = stored(halos, "halos")
    at = F.row_number().over(inside)
    here = chunked.select(
        "*", at.alias("_at"), *[F.lag(value, i).over(inside).alias(f"_in_{i}") for i in range(1, depth + 1)]
    )
    joined = here.join(halos, same(here, halos, [*keys, *chunks]), "left")
    outside = [F.try_element_at(halos["_halo"], F.least(here["_at"] - (i + 1), F.lit(-1)))["_v"] for i in range(1, depth + 1)]
    return joined.select(
        *[here[c] for c in df.columns],
        *[
            F.when(here["_at"] > i, here[f"_in_{i}"]).otherwise(outside[i - 1]).alias(f"{prefix}{i}")
            for i in range(1, depth + 1)
        ],
    )


def with_preceding(cut: Cut, keys: Sequence[str], order: Sequence[str], depth: int, name: str) -> DataFrame:
    """The rows of `cut`, and for each chunk of a heavy key copies of the key's `depth` rows before it; `name` marks the copies."""
    chunks = cut.chunks
    rest = [c for c in cut.frame.columns if c not in (*keys, *chunks, *order)]
    backwards = Window.partitionBy(*keys, *chunks).orderBy(*[F.desc(o) for o in order])
    before = Window.partitionBy(*keys).orderBy(*chunks).rowsBetween(-depth, -1)
    tails = (
        cut.frame.filter(HEAVY)
        .withColumn("_back", F.row_number().over(backwards))
        .filter(F.col("_back") <= depth)
        .groupBy(*keys, *chunks)
        .agg(F.collect_list(F.struct(*order, *rest)).alias("_tail"))  # at most `depth` entries
    )
    latest = F.slice(F.sort_array(F.flatten(F.collect_list("_tail").over(before)), asc=False), 1, depth)
    copies = tails.select(*keys, *chunks, latest.alias("_halo")).select(*keys, *chunks, F.explode("_halo").alias("_row"))
    copies = copies.select(*keys, *chunks, "_row.*", F.lit(True).alias(name))
    return cut.frame.withColumn(name, F.lit(False)).unionByName(copies)
