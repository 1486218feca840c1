"""Joins on inequalities, whose work follows their output and not the product of the sides.

Both sides of a predicate are put in one sorted order; a left row's partners are then an interval of positions among
the right rows.  Right rows lie in blocks of consecutive positions, a left row is copied to the blocks of its
interval, and the pairs come from an equality join on the block.  All blocks but the first and last of an interval
hold nothing but partners.

With a second attribute the interval of the first one is taken apart into nodes of a tree over the blocks: every right
row is in one node per level, a left row in the few nodes that make up its interval, where the first predicate holds
for all rows.  Within each node the second predicate is an interval again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rillstone.operators.joins import equi_join
from rillstone.session import stored

BLOCK_ROWS = 64  # what an end of an interval may compare in vain, and the partners that one copy of a left row finds
FAN_OUT = 8
SORTED_ROWS = 500_000  # that a task puts in order
PAIRS = 8_000_000  # that a task compares

Condition = tuple[str, str, str]  # left column, one of < <= > >=, right column

_MIRRORED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
_LEFT, _RIGHT = "_l", "_r"


def inequality_join(
    left: DataFrame,
    right: DataFrame,
    conditions: Sequence[Condition],
    block_rows: int = BLOCK_ROWS,
    fan_out: int = FAN_OUT,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Inner join of static frames on inequalities between their columns, all of which must hold.

    Column names of both sides must differ.  Conditions on one column of a side, such as `between` two columns of the
    other, are one attribute; up to two attributes are ordered, conditions on further ones filter the pairs of these.
    Values of one attribute are compared in their common type.
    Nulls match nothing; NaN is larger than any number and equal to itself, as in Spark's comparisons.
    """
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"columns on both sides: {', '.join(sorted(clash))}")
    if not conditions or any(op not in _MIRRORED for _, op, _ in conditions):
        raise ValueError("conditions are (left column, one of < <= > >=, right column)")
    columns = [*left.columns, *right.columns]
    if len({l for l, _, _ in conditions}) < len({r for _, _, r in conditions}):
        left, right = right, left
        conditions = [(r, _MIRRORED[op], l) for l, op, r in conditions]
    attributes: dict[str, list[Condition]] = {}
    for condition in conditions:
        attributes.setdefault(condition[2], []).append(condition)
    names = list(attributes)
    left, right = _numbered(left, {l for l, _, _ in conditions}), _numbered(right, set(names))
    rows = right.count()
    l, r = _positions(left, right, attributes[names[0]])
    levels = [0]
    if len(names) > 1:
        *spread, levels = _nodes(l, r, rows, block_rows, fan_out)
        # every level in use holds all right rows, in the order of its nodes
        place = F.lit(0).cast("bigint")
        for i, level in enumerate(levels):
            place = F.when(F.col("_level") == level, F.lit(i * rows).cast("bigint")).otherwise(place)
        span = (F.lit(block_rows) * F.pow(F.lit(float(fan_out)), F.col("_level"))).cast("bigint")
        start = place + F.col("_node") * span
        l, r = _positions(*spread, attributes[names[1]], (start, F.least(start + span, place + rows)))
    block = lambda c: F.floor(c / block_rows).cast("bigint")
    l = l.withColumn("_block", F.explode(F.sequence(block(F.col("_from")), block(F.col("_to") - 1))))
    l = stored(l.select(F.col("_row").alias(_LEFT), "_from", "_to", "_block"), "inequality-copies")
    r = r.select(F.col("_row").alias(_RIGHT), F.col("_at"), block(F.col("_at")).alias("_block"))
    copies = l.count()
    tasks = max(_tasks(copies * block_rows, PAIRS), _tasks(copies + len(levels) * rows, SORTED_ROWS))
    met = equi_join(l, r, "_block", rows_per_task=rows_per_task, partitions=tasks).where("_at >= _from AND _at < _to")
    pairs = met.select(F.col(_LEFT)["row"].alias(_LEFT), F.col(_RIGHT)["row"].alias(_RIGHT))
    # positions of the last ordered attribute are exact; blocks at the ends of an interval of the first one are whole
    for name in [*names[:1], *names[2:]] if len(names) > 1 else []:
        for condition in attributes[name]:
            pairs = pairs.where(_holds(condition))
    side = {c: _LEFT if c in left.schema["_row"].dataType["row"].dataType.names else _RIGHT for c in columns}
    return pairs.select(*[F.col(side[c])[c].alias(c) for c in columns])


def _holds(condition: Condition) -> Column:
    l, op, r = F.col(_LEFT)[condition[0]], condition[1], F.col(_RIGHT)[condition[2]]
    return {"<": l < r, "<=": l <= r, ">": l > r, ">=": l >= r}[op]


def _numbered(df: DataFrame, needed: set[str]) -> DataFrame:
    """The rows that can match, as `_row` = (id, row); stored, so that an id stays with its row."""
    rows = df
    for column in sorted(needed):  # dropna would take NaN for null
        rows = rows.where(F.col(f"`{column}`").isNotNull())
    row = F.struct(F.monotonically_increasing_id().alias("id"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    return stored(rows.select(row.alias("_row")), "inequality-side")


def _value(df: DataFrame, column: str) -> Column:
    value = F.col("_row")["row"][column]
    kind = df.schema["_row"].dataType["row"].dataType[column].dataType
    return value + F.lit(0.0).cast(kind) if isinstance(kind, (T.FloatType, T.DoubleType)) else value  # -0.0 becomes 0.0


def _positions(left: DataFrame, right: DataFrame, conditions: Sequence[Condition], node: tuple[Column, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Right rows with `_at`, their position in the order of the conditions' attribute, and left rows with the interval
    `_from` .. `_to` - 1 of the positions that satisfy the conditions.

    With `node`, the first position of a row's node and the one after its last, rows of both sides have `_level` and `_node`,
    which come first in the order, and an interval stays in its node.  Left rows with an empty interval are dropped.  A marker per condition is
    sorted together with the right rows, before or after rows of an equal value as the comparison asks for.
    """
    by = ["_level", "_node"] if node else []
    empty = F.lit(None).cast(left.schema["_row"].dataType)
    markers = []
    for i, (own, op, _) in enumerate(conditions):
        # "<" and ">=" differ in whether the marker counts the right rows of its own value
        after = op in ("<", ">=")
        markers.append(F.struct(_value(left, own).alias("value"), F.lit(2 if after else 0).alias("side"), F.lit(i).alias("condition")))
    marked = left.select(*by, F.explode(F.array(*markers)).alias("_m"), F.col("_row").alias(_LEFT))
    marked = marked.select(*by, "_m.*", _LEFT, F.lit(None).cast(right.schema["_row"].dataType).alias(_RIGHT))
    placed = right.select(
        *by, _value(right, conditions[0][2]).alias("value"), F.lit(1).alias("side"), F.lit(-1).alias("condition"),
        empty.alias(_LEFT), F.col("_row").alias(_RIGHT),
    )
    order = [*by, "value", "side", F.coalesce(F.col(_LEFT)["id"], F.col(_RIGHT)["id"])]
    both = marked.unionByName(placed)
    tasks = _tasks(both.count(), SORTED_ROWS)
    dealt = both.repartitionByRange(tasks, *order).sortWithinPartitions(*order).drop("value")
    fields = T.StructType([*dealt.schema.fields, T.StructField("_task", T.IntegerType()), T.StructField("_inside", T.LongType())])
    dealt = stored(dealt.mapInArrow(_counted, fields), "inequality-order")
    is_right = F.col("side") == 1
    # one number per task; the numbers of the tasks follow the order of the ranges
    sizes = {r["_task"]: r["n"] for r in dealt.groupBy("_task").agg(F.max("_inside").alias("n")).collect()}
    before, total = [], 0
    for t in sorted(sizes):
        before.append((t, total))
        total += sizes[t]
    offsets = dealt.sparkSession.createDataFrame(before, "_task int, _before bigint")
    counted = dealt.join(F.broadcast(offsets), "_task").withColumn("_count", F.col("_before") + F.col("_inside"))
    at = counted.where(is_right).select(*by, F.col(_RIGHT).alias("_row"), (F.col("_count") - 1).alias("_at"))
    low, high = ([node[0]], [node[1]]) if node else ([F.lit(0).cast("bigint")], [F.lit(total).cast("bigint")])
    ends = counted.where(~is_right)
    if len(conditions) == 1:
        found = ends.select(*by, F.col(_LEFT).alias("_row"), F.col("_count").alias("_c0"))
    else:
        keys = [*by, "_id"]
        each = [F.max(F.when(F.col("condition") == i, F.col("_count"))).alias(f"_c{i}") for i in range(len(conditions))]
        met = ends.withColumn("_id", F.col(_LEFT)["id"]).repartition(tasks, *keys)
        found = met.groupBy(*keys).agg(F.first(_LEFT).alias("_row"), *each).drop("_id")
    for i, (_, op, _) in enumerate(conditions):
        (low if op in ("<", "<=") else high).append(F.col(f"_c{i}"))
    bounds = [F.greatest(*low) if len(low) > 1 else low[0], F.least(*high) if len(high) > 1 else high[0]]
    found = found.select(*by, "_row", bounds[0].alias("_from"), bounds[1].alias("_to")).where("_to > _from")
    found = stored(found, "inequality-intervals")
    # left rows lie in the order of their values, and so do their numbers of partners: dealt by these, in no order
    size = found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_to") - F.col("_from")).alias("pairs")).first()
    tasks = max(_tasks(size["n"], SORTED_ROWS), _tasks(size["pairs"] or 0, PAIRS))
    return found.repartition(tasks, *by, F.col("_row")["id"]), at


def _tasks(work: int, of_one: int) -> int:
    return max(1, -(-work // of_one))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows with its number and `_inside`, how many right rows the task has had by then."""
    task, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        inside = n + np.cumsum(batch.column("side").to_numpy() == 1)
        n = int(inside[-1]) if len(inside) else n
        extra = [pa.array(np.full(batch.num_rows, task, "int32")), pa.array(inside.astype("int64"))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "_task", "_inside"])


def _nodes(left: DataFrame, right: DataFrame, rows: int, block_rows: int, fan_out: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """Both sides with `_level` and `_node`, and the levels in use: of a left row the nodes that make up its interval, of a
    right row one on every level that any left row uses.

    The blocks at the ends of an interval count as whole.
    """
    top, size = 1, block_rows
    while size < rows:
        top, size = top + 1, size * fan_out
    low = F.floor(F.col("_from") / block_rows).cast("bigint").alias("_low")
    high = F.floor((F.col("_to") + block_rows - 1) / block_rows).cast("bigint").alias("_high")
    blocks = left.select("_row", low, high)
    l = stored(blocks.select("_row", F.explode(_interval(top, fan_out)).alias("_n")).select("_row", "_n.*"), "inequality-nodes")
    levels = sorted(r["_level"] for r in l.select("_level").distinct().collect()) or [0]
    number = lambda level: F.floor(F.col("_at") / (block_rows * fan_out**level)).cast("bigint")
    own = F.array(*[F.struct(F.lit(i).cast("bigint").alias("_level"), number(i).alias("_node")) for i in levels])
    r = right.select(F.col("_row"), F.explode(own).alias("_n")).select("_row", "_n.*")
    return l, r, levels


def _on_level(nodes: Column, level: int) -> Column:
    return F.transform(nodes, lambda n: F.struct(F.lit(level).cast("bigint").alias("_level"), n.alias("_node")))


def _interval(levels: int, fan_out: int) -> Column:
    """Nodes that make up the blocks `_low` .. `_high` - 1, as (level, node).

    On each level what sticks out of whole parents on either side is taken, and the rest passed up.  The ends on a level
    are the first ones divided by its width, so that the expression has one part of equal size for each level.
    """
    none = F.array().cast("array<bigint>")
    between = lambda a, b: F.when(b > a, F.sequence(a, b - 1)).otherwise(none)
    first = lambda level: F.ceil(F.col("_low") / fan_out**level).cast("bigint")
    last = lambda level: F.floor(F.col("_high") / fan_out**level).cast("bigint")
    parts = []
    for level in range(levels):
        low, high = first(level), last(level)
        up, down = first(level + 1), last(level + 1)
        sides = F.concat(between(low, up * fan_out), between(down * fan_out, high))
        taken = between(low, high) if level == levels - 1 else F.when(up >= down, between(low, high)).otherwise(sides)
        parts.append(_on_level(taken, level))
    return F.concat(*parts)
