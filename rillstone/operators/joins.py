"""Joins: equi, outer with filled gaps, hinted, lookup, theta, as-of, window and interval joins."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rillstone.functions.geo import cell, haversine_km, neighbour_cells
from rillstone.operators.rolling import roll, rolling_last_known
from rillstone.operators.sizing import fits_broadcast
from rillstone.operators.skew import content_hash, grid_slots, heavy_join_keys, rows_limit, same
from rillstone.session import limit

NESTED_ROWS = 10_000  # setting spark.rillstone.nestedRows: rows that a nested loop may copy to each task

MISSING = "NULL"  # fixed value: text an outer join shows for an absent side

# strategy -> (side that carries the hint, Spark hint)
STRATEGIES: dict[str, tuple[str, str] | None] = {
    "broadcast_first": ("left", "broadcast"),
    "broadcast_second": ("right", "broadcast"),
    "shuffle_hash_first": ("left", "shuffle_hash"),
    "shuffle_hash_second": ("right", "shuffle_hash"),
    "merge": ("left", "merge"),
    "auto": None,
}


def _aligned(right: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """`right` with its key columns renamed to the left names."""
    names = {r: l for l, r in on}
    return right.select(*[F.col(c).alias(names.get(c, c)) for c in right.columns])


def _pairs(on: str | Sequence[str] | Mapping[str, str]) -> list[tuple[str, str]]:
    if isinstance(on, str):
        return [(on, on)]
    if isinstance(on, Mapping):
        return list(on.items())
    return [(c, c) for c in on]


def _with_hint(left: DataFrame, right: DataFrame, hint: tuple[str, str] | None) -> tuple[DataFrame, DataFrame]:
    if hint is None:
        return left, right
    side, name = hint
    return (left.hint(name), right) if side == "left" else (left, right.hint(name))


def equi_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str] | Mapping[str, str],
    how: str = "inner",
    hint: tuple[str, str] | None = None,
    rows_per_task: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Join on equal keys; the key columns (left names) come first, then the other columns of both sides.

    Keys with too many rows for one task, on either side and for every join type, are spread over a grid:
    a row goes to one of its own side's slots and is copied to each slot of the other side, so every pair
    meets exactly once.  Streams can't be counted beforehand: there the join is Spark's own.  With `partitions`, static
    sides are dealt to that many tasks, for joins whose pairs say more about their work than their bytes.
    """
    pairs = _pairs(on)
    keys = [l for l, _ in pairs]
    right = _aligned(right, pairs)
    if left.isStreaming or right.isStreaming:
        l, r = _with_hint(left, right, hint)
        return l.join(r, keys, how)
    heavy = heavy_join_keys(left, right, keys, rows_per_task)
    if heavy is None:
        l, r = _with_hint(*_dealt(left, right, keys, partitions), hint)
        return l.join(r, keys, how)
    return _grid_join(left, right, keys, how, hint, heavy, rows_per_task, partitions=partitions)


def _dealt(left: DataFrame, right: DataFrame, keys: Sequence[str], partitions: int | None) -> tuple[DataFrame, DataFrame]:
    return (left.repartition(partitions, *keys), right.repartition(partitions, *keys)) if partitions else (left, right)


def _spread(
    left: DataFrame, right: DataFrame, keys: Sequence[str], heavy: DataFrame | tuple[int, int], rows_per_task: int | None
) -> tuple[DataFrame, DataFrame]:
    """Both sides with their slots `_at_l` and `_at_r`; equal slots and keys are where pairs meet, exactly once.

    `heavy` holds the counts of the heavy keys, or without keys the two row counts.
    """
    most = rows_limit(left, rows_per_task)

    grids, complete = None, F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    if not isinstance(heavy, tuple):
        l, r = grid_slots(F.col("_nl"), F.col("_nr"), most)
        meets = (F.col("_nl") > 0) & (F.col("_nr") > 0) & complete
        # what meets nothing needs no slots but its own side's
        alone = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / most)).cast("bigint")
        grids = heavy.select(
            *keys,
            F.when(meets, l).otherwise(alone("_nl")).alias("_grid_l"),
            F.when(meets, r).otherwise(alone("_nr")).alias("_grid_r"),
            meets.alias("_meets"),
        )

    def sized(df: DataFrame) -> DataFrame:
        """The rows of heavy keys with the slots of both sides."""
        if grids is None:
            l, r = grid_slots(F.lit(heavy[0]), F.lit(heavy[1]), most)
            return df.select("*", l.alias("_grid_l"), r.alias("_grid_r"), F.lit(True).alias("_meets"))
        added = [grids[c] for c in ("_grid_l", "_grid_r", "_meets")]
        return df.join(grids, same(df, grids, keys)).select(*[df[c] for c in df.columns], *added)

    def spread(df: DataFrame, own: str, other: str, flag: str) -> DataFrame:
        # heavy rows are numbered in the order of their content, so a recomputed task repeats its slots, and exact copies
        # of a row, which nothing tells apart, get different ones
        numbered = sized(df).sortWithinPartitions(content_hash(df)).withColumn("_number", F.monotonically_increasing_id())
        slot = F.pmod(F.xxhash64("_number"), F.col(f"_grid_{own}"))
        # copies only where both sides have rows: elsewhere nothing can meet them
        copies = F.when(F.col("_meets"), F.col(f"_grid_{other}")).otherwise(F.lit(1))
        placed = (
            numbered.select(*df.columns, F.col("_meets").alias(flag), slot.alias(f"_at_{own}"), copies.alias("_copies"))
            .withColumn(f"_at_{other}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1)))
            .drop("_copies")
        )
        if grids is None:
            return placed
        zero = F.lit(0).cast("bigint")
        light = df.join(grids, same(df, grids, keys), "left_anti")
        return placed.unionByName(light.select("*", F.lit(False).alias(flag), zero.alias(f"_at_{own}"), zero.alias(f"_at_{other}")))

    return spread(left, "l", "r", "_meets_l"), spread(right, "r", "l", "_meets_r")


def _grid_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str,
    hint: tuple[str, str] | None,
    heavy: DataFrame | tuple[int, int],
    rows_per_task: int | None,
    condition: Column | None = None,
    partitions: int | None = None,
) -> DataFrame:
    at = ["_at_l", "_at_r"]
    l, r = _with_hint(*_dealt(*_spread(left, right, keys, heavy, rows_per_task), [*keys, *at], partitions), hint)
    joined = l.join(r, [*keys, *at], how)
    if condition is not None:
        joined = joined.filter(condition)
    if how != "inner":
        # a copy without a partner in its slot is no missing row when the key exists on both sides
        lonely = F.col("_meets_l").isNull() | F.col("_meets_r").isNull()
        joined = joined.filter(~(F.coalesce("_meets_l", "_meets_r") & lonely))
    return joined.drop(*at, "_meets_l", "_meets_r")


def named_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str] | Mapping[str, str],
    how: str = "inner",
    strategy: str = "auto",
    missing: str = MISSING,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Equi-join whose absent text values read `missing`; `how` is inner, left, right or full."""
    joined = hinted_join(left, right, on, strategy, how, rows_per_task=rows_per_task)
    if how == "inner":
        return joined
    keys = {l for l, _ in _pairs(on)}
    texts = [n for n, t in joined.dtypes if t == "string" and n not in keys]
    return joined.na.fill(missing, subset=texts) if texts else joined


def hinted_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str] | Mapping[str, str],
    strategy: str = "auto",
    how: str = "inner",
    rows_per_task: int | None = None,
    max_rows: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Equi-join with a named strategy.

    A broadcast is made only for a side counted and found small, and only where the join type allows it: the
    side whose unmatched rows are kept cannot be copied.
    """
    hint = STRATEGIES[strategy]
    if hint and hint[1] == "broadcast":
        side = left if hint[0] == "left" else right
        copyable = how in ("inner", "right" if hint[0] == "left" else "left")
        if copyable and not side.isStreaming and fits_broadcast(side, max_rows, max_bytes):
            pairs = _pairs(on)
            l, r = _with_hint(left, _aligned(right, pairs), hint)
            return l.join(r, [k for k, _ in pairs], how)
        warnings.warn(f"{strategy}: that side is too large, streams or must be kept whole; joined without a hint", stacklevel=2)
        hint = None
    return equi_join(left, right, on, how, hint, rows_per_task)


def sql_join(
    left: DataFrame,
    right: DataFrame,
    hint: str,
    condition: str,
    columns: str,
    max_rows: int | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Inner join written in SQL over `l` and `r` with a hint comment.

    `hint` is BROADCAST, SHUFFLE_HASH, SHUFFLE_MERGE or NEST_LOOP.  The two that copy a side are kept only
    while that side is small.  Beyond it BROADCAST becomes a join without a hint and NEST_LOOP a grid of cells, with a
    warning and the same rows; a side is never multiplied into a Cartesian product.
    """
    spelled = {
        "BROADCAST": "BROADCAST(r)",
        "SHUFFLE_HASH": "SHUFFLE_HASH(r)",
        "SHUFFLE_MERGE": "MERGE(l, r)",
        "NEST_LOOP": "BROADCAST(r)",
    }[hint]
    comment = f"/*+ {spelled} */"
    if hint == "NEST_LOOP" and not fits_broadcast(right, _nested_rows(left, max_rows)):
        warnings.warn("NEST_LOOP: the right side is too large to copy; joined in a grid", stacklevel=2)
        left, right = _spread(left, right, [], (left.count(), right.count()), rows_per_task)
        comment, condition = "", f"l._at_l = r._at_l AND l._at_r = r._at_r AND ({condition})"
    elif hint == "BROADCAST" and not fits_broadcast(right, max_rows):
        warnings.warn("BROADCAST: the right side is too large to copy; joined without a hint", stacklevel=2)
        comment = ""
    return left.sparkSession.sql(
        f"SELECT {comment} {columns} FROM {{l}} AS l JOIN {{r}} AS r ON {condition}", l=left, r=right
    )


def _nested_rows(df: DataFrame, max_rows: int | None) -> int:
    return limit(df.sparkSession, max_rows, "spark.rillstone.nestedRows", NESTED_ROWS)


def theta_join(
    left: DataFrame,
    right: DataFrame,
    condition: Column,
    rows_per_task: int | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Inner join on any predicate.  A small right side is broadcast; otherwise rows meet in a grid of cells.

    The grid bounds the rows of either side and the pairs that a task has, whatever the values.
    """
    if fits_broadcast(right, _nested_rows(left, max_rows)):
        return left.join(F.broadcast(right), condition, "inner")
    return _grid_join(left, right, [], "inner", None, (left.count(), right.count()), rows_per_task, condition)


def lookup_join(
    facts: DataFrame,
    dimension: DataFrame,
    on: str | Sequence[str] | Mapping[str, str],
    how: str = "left",
    rows_per_task: int | None = None,
    max_rows: int | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Enrich `facts` (static or streaming) with a static dimension.

    A small dimension is broadcast: no shuffle of the facts.  A large one is joined by key, with heavy fact
    keys spread when the facts are static; a stream leaves the choice to Spark.  `small` passes on the
    outcome of `fits_broadcast` when one dimension is looked up several times.
    """
    pairs = _pairs(on)
    aligned = _aligned(dimension, pairs)
    keys = [l for l, _ in pairs]
    if fits_broadcast(dimension, max_rows) if small is None else small:
        return facts.join(F.broadcast(aligned), keys, how)
    if facts.isStreaming:
        return facts.join(aligned, keys, how)
    return equi_join(facts, aligned, keys, how, rows_per_task=rows_per_task)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_order: Sequence[str],
    right_order: Sequence[str],
    columns: Sequence[str],
    inclusive: bool = True,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Each left row with `columns` of the latest right row of its key (null when there is none).

    Both sides become one ordered sequence per key and the last version known is carried forward: one
    shuffle, no pairs.  With `inclusive`, a version at exactly the left time counts.  The order columns of
    the two sides correspond by position; the first is the time.  Null keys match nothing, a version without a time is
    never known, and a left row without a time knows none.
    """
    right = right.dropna(subset=[*on, right_order[0]])
    order = [f"_o{i}" for i in range(len(left_order))]
    mine = [c for c in left.columns if c not in on]
    rank_left, rank_right = (1, 0) if inclusive else (0, 1)
    seq_left = left.select(
        *on,
        *[F.col(c).alias(o) for c, o in zip(left_order, order)],
        F.lit(rank_left).alias("_side"),
        F.struct(*mine).alias("_row"),
        F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("_version"),
    )
    seq_right = right.select(
        *on,
        *[F.col(c).alias(o) for c, o in zip(right_order, order)],
        F.lit(rank_right).alias("_side"),
        F.lit(None).cast(seq_left.schema["_row"].dataType).alias("_row"),
        F.struct(*columns).alias("_version"),
    )
    both = seq_left.unionByName(seq_right)
    known = roll(both, on, [order[0], "_side", *order[1:]], rolling_last_known("_version", "_known"), rows_per_task=rows_per_task)
    return known.filter(F.col("_side") == rank_left).select(
        *on, *[F.col("_row")[c].alias(c) for c in mine], *[F.col("_known")[c].alias(c) for c in columns]
    )


def window_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    size: str,
    slide: str | None,
    left_aggs: Sequence[Column],
    right_aggs: Sequence[Column],
) -> DataFrame:
    """Sides that share key and window, joined as one row per key and window.

    Each side is aggregated per key and window first, so the join is one to one and a busy key never
    multiplies into all its pairs; their number is the product of the two counts.
    """
    def side(df: DataFrame, time: str, aggs: Sequence[Column]) -> DataFrame:
        return df.groupBy(F.window(time, size, slide).alias("window"), *keys).agg(*aggs)

    joined = side(left, left_time, left_aggs).join(side(right, right_time, right_aggs), ["window", *keys])
    return joined.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        *[c for c in joined.columns if c != "window"],
    )


def interval_join(
    left: DataFrame, right: DataFrame, on: Mapping[str, str], left_time: str, right_time: str, within: str, delay: str
) -> DataFrame:
    """Stream-stream join: the right row comes at or after the left one, at most `within` later.

    Watermarks on both sides and the time bound let Spark drop state that can no longer match.
    """
    l = left.withWatermark(left_time, delay)
    r = right.withWatermark(right_time, delay)
    cond = (r[right_time] >= l[left_time]) & (r[right_time] <= l[left_time] + F.expr(f"interval {within}"))
    for a, b in on.items():
        cond = cond & (l[a] == r[b])
    return l.join(r, cond, "inner")


def nearby_join(
    left: DataFrame,
    right: DataFrame,
    left_at: tuple[str, str],
    right_at: tuple[str, str],
    km: float,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Pairs of points less than `km` apart; the points are (latitude, longitude) columns in degrees.

    Points fall into grid cells wide enough that partners are in the same or a neighbouring cell: the right
    side is copied to its nine neighbours and joined on the cell.  Column names of both sides must differ.
    """
    l = left.withColumn("_cell", cell(F.col(left_at[0]), F.col(left_at[1]), km))
    r = right.withColumn("_cell", F.explode(neighbour_cells(F.col(right_at[0]), F.col(right_at[1]), km)))
    distance = haversine_km(*[F.col(c) for c in (*left_at, *right_at)])
    return (
        equi_join(l, r, "_cell", rows_per_task=rows_per_task)
        .withColumn("distance_km", distance)
        .filter(F.col("distance_km") < km)
        .drop("_cell")
    )
