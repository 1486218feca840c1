"""Helpers of the operators in this folder: stored intermediate tables and ranks over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstone.session import fresh_dir

WORDS = r"[^\x20\x09-\x0D]+"
#: Items that a fold over an array handles one by one; longer arrays are folded by blocks of so many.
BLOCK = 64


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the cluster's shared folder and read it back: lineage ends there, whichever executor is lost."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def plain(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` with columns c0, c1, ... and the new name of each: nothing an operator adds can clash with them."""
    names = {name: f"c{i}" for i, name in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def row_key(df: DataFrame) -> Column:
    """A hash of all columns, nulls included, to tell apart rows that share an id."""
    fields = sorted(df.schema, key=lambda f: f.name)
    columns = [F.map_entries(f"`{f.name}`") if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in fields]
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


def ranked(df: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """Number all rows from 0 in the given order without bringing them together.

    Rows are dealt into ranges of the order and written; each range is numbered by itself, and the sizes of
    the ranges before it (one number per task) are added.
    """
    dealt = stored(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranked")
    sizes = {row["__range"]: row["count"] for row in dealt.groupBy("__range").count().collect()}
    if not sizes:
        return dealt.withColumn(rank, F.lit(0).cast("long")).drop("__range")
    before, total = {}, 0
    for at in sorted(sizes):
        before[at] = total
        total += sizes[at]
    starts = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn(rank, (inside - 1 + starts[F.col("__range")]).cast("long")).drop("__range")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is evaluated once however often the body or a lambda within it mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blocks(xs: Column, size: int = BLOCK) -> Column:
    """An array as an array of arrays of at most `size` items, in order."""
    numbers = F.when(F.size(xs) > 0, F.sequence(F.lit(0), ((F.size(xs) - 1) / size).cast("int")))
    return F.coalesce(F.transform(numbers, lambda i: F.slice(xs, i * size + 1, F.lit(size))), F.transform(F.slice(xs, 1, 0), lambda x: F.array(x)))


def folded_before(numbers: Column, op: Callable[[Column, Column], Column], zero: int = 0, levels: int = 2) -> Column:
    """array<bigint>: for every item the fold by an associative `op` of the items before it, `zero` for the first.

    A fold that appends to an array copies it at each item.  Here it only does so within blocks of `BLOCK` items, whose own
    folds are folded in the same way, so the time is in proportion to the items.
    """
    begin = F.lit(zero).cast("long")

    def inside(xs: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.expr("CAST(array() AS array<bigint>)").alias("out"))
        step = lambda s, x: F.struct(op(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(xs, state, step, lambda s: s["out"])

    def by_blocks(parts: Column) -> Column:
        wholes = F.transform(parts, lambda xs: F.aggregate(xs, begin, lambda a, x: op(a, x)))
        return let(folded_before(wholes, op, zero, levels - 1), lambda starts: F.flatten(F.zip_with(parts, starts, inside)))

    def chosen(xs: Column) -> Column:
        if not levels:
            return inside(xs, begin)
        return F.when(F.size(xs) <= BLOCK, inside(xs, begin)).otherwise(let(blocks(xs), by_blocks))

    return let(F.transform(numbers, lambda x: x.cast("long")), chosen)


def cuts(text: Column, places: Column) -> Column:
    """The parts of a text at `places`, an array of (start, length) in rising order, from 0 and in code points.

    Finding a place means counting code points from the start, so a block of places is cut out as a whole first.
    """

    def cut(inner: Column, at: Column, p: Column) -> Column:
        return F.substring(inner, (p["start"] - at + 1).cast("int"), p["length"].cast("int"))

    def of_block(ps: Column) -> Column:
        first, last = F.get(ps, F.lit(0))["start"], F.element_at(ps, -1)
        inner = F.substring(text, (first + 1).cast("int"), (last["start"] + last["length"] - first).cast("int"))
        return let(inner, lambda held: F.transform(ps, lambda p: cut(held, first, p)))

    return let(places, lambda ps: F.flatten(F.transform(blocks(ps), of_block)))
