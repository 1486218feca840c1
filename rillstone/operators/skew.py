"""Splitting heavy keys.

A window or join hashes all rows of a key into one task.  When one key holds a large share of the table that
task decides the run time, whatever the cluster size.  The helpers here find such keys with one partially
aggregated pass and give their rows a second partitioning column:

* `cut_heavy` cuts a heavy key into consecutive ranges of its ordering columns, for ordered work;
* `heavy_join_keys` returns per-key row counts of both sides, for salted joins.

Heavy keys and their ranges are small tables in the shared folder, however many there are, so a recomputed task puts
each row where the lost one did.  Only bucket numbers, `BUCKETS` at most, come to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rillstone.session import limit, stored

ROWS_PER_TASK = 4_000_000  # setting spark.rillstone.rowsPerTask
PAIRS_PER_ROW = 4  # pairs of a join that one task makes, for each row it may hold
RANGES_PER_TASK = 4
BUCKETS = 65_536

HEAVY = "_heavy"
_HIT = "_hit"
_WIDTH = "_width"


def rows_limit(df: DataFrame, rows_per_task: int | None) -> int:
    return limit(df.sparkSession, rows_per_task, "spark.rillstone.rowsPerTask", ROWS_PER_TASK)


def position(df: DataFrame, name: str) -> Column:
    """The ordering column as a long, keeping its order."""
    kind = df.schema[name].dataType
    col = F.col(name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(col.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("bigint")
    if isinstance(kind, T.IntegralType):
        return col.cast("bigint")
    raise TypeError(f"ordering column {name} must be an integer, date or timestamp, not {kind.simpleString()}")


def _has_position(df: DataFrame, name: str) -> bool:
    try:
        position(df, name)
    except TypeError:
        return False
    return True


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType)


def content_hash(df: DataFrame) -> Column:
    """A hash of all columns; those that hold maps, which Spark does not hash, are hashed as JSON."""
    columns = [F.col(f"`{f.name}`") for f in df.schema.fields]
    return F.xxhash64(*[F.to_json(F.struct(c)) if _holds_map(f.dataType) else c for c, f in zip(columns, df.schema.fields)])


def same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Null-safe equality on equally named columns."""
    cond = F.lit(True)
    for name in names:
        cond = cond & left[name].eqNullSafe(right[name])
    return cond


@dataclass(frozen=True)
class ChunkPlan:
    """Ranges of the heavy keys over one ordering column; one small table per refinement level."""

    keys: tuple[str, ...]
    order: str
    chunk: str
    levels: tuple[DataFrame, ...]

    def apply(self, df: DataFrame) -> DataFrame:
        """`df` plus the chunk column: the first position of the row's range, 0 for a light key."""
        return _apply_levels(df, self.keys, self.order, self.chunk, self.levels).drop(_HIT, _WIDTH)

    def apply_marked(self, df: DataFrame) -> DataFrame:
        """Like `apply`, plus `HEAVY`."""
        return _apply_levels(df, self.keys, self.order, self.chunk, self.levels).drop(_WIDTH).withColumnRenamed(_HIT, HEAVY)


def _apply_levels(df: DataFrame, keys: Sequence[str], order: str, chunk: str, levels: Sequence[DataFrame]) -> DataFrame:
    at = position(df, order)
    columns = df.columns
    first = levels[0]
    # floor to the range start; rows without a position come before every range
    start = F.coalesce(at - F.pmod(at - first["_lo"], first["_w"]), first["_lo"] - 1)
    # no hint: the tables of ranges have a known size, by which Spark decides whether to copy them
    out = df.join(first, same(df, first, keys), "left").select(
        *[df[c] for c in columns],
        F.when(first["_w"].isNull(), F.lit(0)).otherwise(start).cast("bigint").alias(chunk),
        first["_w"].isNotNull().alias(_HIT),
        first["_w"].alias(_WIDTH),
    )
    for level in levels[1:]:
        at = position(out, order)
        finer = at - F.pmod(at - out[chunk], level["_w"])
        hit = same(out, level, [*keys, chunk]) & out[_HIT]
        out = out.join(level, hit, "left").select(
            *[out[c] for c in columns],
            F.when(level["_w"].isNull(), out[chunk]).otherwise(F.coalesce(finer, out[chunk])).alias(chunk),
            out[_HIT],
            F.coalesce(level["_w"], out[_WIDTH]).alias(_WIDTH),
        )
    return out


def _bucket(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))


def _in_full_buckets(df: DataFrame, keys: Sequence[str], counts: Sequence[Column], too_many: Column) -> DataFrame | None:
    """The rows whose key may be heavy, or None when no key can be.

    A heavy key fills its hash bucket, and bucket counts are small however many keys there are; keys are
    counted one by one only in the buckets that are full.
    """
    full = df.groupBy(_bucket(keys).alias("_b")).agg(*counts).filter(too_many).select("_b").collect()
    if not full:
        return None
    buckets = df.sparkSession.createDataFrame(full, "_b bigint")
    return df.join(F.broadcast(buckets), _bucket(keys) == F.col("_b"), "left_semi")  # at most BUCKETS rows


def _width(span: Column, n: Column, rows_per_task: int) -> Column:
    """Width of equal ranges over `span` positions, RANGES_PER_TASK of them for each task's rows."""
    ranges = F.ceil(n / rows_per_task) * RANGES_PER_TASK
    return F.greatest(F.lit(1), F.ceil(span / ranges)).cast("bigint")


def plan_chunks(
    df: DataFrame, keys: Sequence[str], order: str, rows_per_task: int | None = None, chunk: str = "_chunk"
) -> ChunkPlan | None:
    """Ranges for every key of `df` with more than `rows_per_task` rows, or None when there is none.

    Equal-width ranges over [min, max] first; a range that is still too full is cut again, so uneven
    distributions end up even too.  Rows that share key and position stay together.
    """
    rows_per_task = rows_limit(df, rows_per_task)
    at = position(df, order)
    suspects = _in_full_buckets(df, keys, [F.count(F.lit(1)).alias("_n")], F.col("_n") > rows_per_task)
    if suspects is None:
        return None
    found = (
        suspects.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_lo"), F.max(at).alias("_hi"))
        .filter((F.col("_n") > rows_per_task) & F.col("_lo").isNotNull())
        .select(*keys, "_lo", _width(F.col("_hi") - F.col("_lo") + 1, F.col("_n"), rows_per_task).alias("_w"))
    )
    levels = [stored(found, "heavy-keys")]
    if levels[0].isEmpty():
        return None
    while True:  # each level is at least RANGES_PER_TASK times finer, so a range ends up light or one position wide
        full = (
            _apply_levels(df.select(*keys, order), keys, order, chunk, levels)
            .filter(F.col(_HIT) & (F.col(_WIDTH) > 1))
            .groupBy(*keys, chunk)
            .agg(F.count(F.lit(1)).alias("_n"), F.max(_WIDTH).alias(_WIDTH))
            .filter(F.col("_n") > rows_per_task)
            .select(*keys, chunk, _width(F.col(_WIDTH), F.col("_n"), rows_per_task).alias("_w"))
        )
        level = stored(full, "heavy-ranges")
        if level.isEmpty():
            break
        levels.append(level)
    return ChunkPlan(tuple(keys), order, chunk, tuple(levels))


@dataclass(frozen=True)
class Cut:
    """A frame whose heavy keys are cut: `chunks` are the added columns, in order of significance."""

    frame: DataFrame
    chunks: tuple[str, ...]


def cut_heavy(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows_per_task: int | None = None,
    probe: DataFrame | None = None,
) -> Cut | None:
    """Cut the heavy keys of `df` along `order`, or None when no key is heavy.

    Rows that share the first position are cut by the next ordering column.  `probe` is a cheaper frame with
    the same keys and leading order columns on which heavy keys are looked for.
    """
    seen = df if probe is None else probe
    seen = seen.select(*keys, *[o for o in order if o in seen.columns])
    chunks: list[str] = []
    for i, name in enumerate(order):
        if name not in seen.columns or (i and not _has_position(seen, name)):
            break
        plan = plan_chunks(seen, [*keys, *chunks], name, rows_per_task, f"_chunk{i}")
        if plan is None:
            break
        df = plan.apply(df) if chunks else plan.apply_marked(df)
        seen = (plan.apply(seen) if chunks else plan.apply_marked(seen).filter(HEAVY).drop(HEAVY))
        chunks.append(f"_chunk{i}")
    return Cut(df, tuple(chunks)) if chunks else None


def heavy_join_keys(
    left: DataFrame, right: DataFrame, on: Sequence[str], rows_per_task: int | None = None
) -> DataFrame | None:
    """Join keys too heavy for one task, by the rows of a side or by their pairs, with the row counts `_nl` and `_nr`."""
    names = list(on)
    rows_per_task = rows_limit(left, rows_per_task)
    both = left.select(*names, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionAll(
        right.select(*names, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    counts = [F.sum("_l").alias("_nl"), F.sum("_r").alias("_nr")]
    pairs = F.col("_nl").cast("double") * F.col("_nr")
    too_many = (F.greatest("_nl", "_nr") > rows_per_task) | (pairs > rows_per_task * PAIRS_PER_ROW)
    suspects = _in_full_buckets(both, names, counts, too_many)
    if suspects is None:
        return None
    found = stored(suspects.groupBy(*names).agg(*counts).filter(too_many), "heavy-join-keys")
    return None if found.isEmpty() else found


def grid_slots(nl: Column, nr: Column, rows_per_task: int) -> tuple[Column, Column]:
    """Slots of both sides, so that a cell holds neither too many rows of a side nor too many pairs."""
    cells = F.ceil(nl.cast("double") * nr / (rows_per_task * PAIRS_PER_ROW)).cast("double")
    of_left = F.least(cells, F.ceil(F.sqrt(cells * nl / F.greatest(nr, F.lit(1)))))
    left = F.greatest(F.lit(1), of_left, F.ceil(nl / rows_per_task))
    right = F.greatest(F.lit(1), F.ceil(cells / left), F.ceil(nr / rows_per_task))
    return left.cast("bigint"), right.cast("bigint")
