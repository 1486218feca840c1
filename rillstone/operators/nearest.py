"""The nearest right point of every left point on the globe, by a grid that is as fine as the points are dense.

Points become vectors on the unit sphere, so there are no poles and no date line, and cells are cubes of an octree.  A
cube with more than `leaf_rows` right points is split; only cubes that hold points exist, and points in exactly one place
are one.  All left points walk down the tree twice, two levels a round.  First each follows one path, always to the cube whose
points are nearest on average, and measures the points of the leaf that it comes to.  Then each keeps the cubes that can still
hold its nearest point: those that begin no farther away than that measured point, or than the nearest of the cubes ends.  These
are a few cubes per point on every level, however dense the points are, so no pairs of a dense cell are ever made, and what
lies beyond is dropped where it is looked at, before any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rillstone.functions.geo import EARTH_KM, haversine_km
from rillstone.operators.joins import equi_join
from rillstone.operators.sizing import fits_broadcast
from rillstone.session import stored

LEAF_ROWS = 64
STEP = 2  # levels of the tree that a round goes down
MAX_DEPTH = 22  # cubes of this depth are three metres wide; the slack allows for two
SLACK = 2e-3 / EARTH_KM  # chords that differ by less than two metres count as equal until the end
WALKERS = 100_000  # left points that a task starts with
PAIRS = 8_000_000  # that a task compares

_AXES = ("x", "y", "z")


def _vector(lat: Column, lon: Column) -> Column:
    la, lo = F.radians(lat), F.radians(lon)
    return F.struct((F.cos(la) * F.cos(lo)).alias("x"), (F.cos(la) * F.sin(lo)).alias("y"), F.sin(la).alias("z"))


def _cube(vector: str, depth: int) -> Column:
    """Cube of the depth that holds a vector: three whole numbers from 0 to 2^depth - 1."""
    top = 2**depth - 1
    at = lambda a: F.least(F.floor((F.col(vector)[a] + 1) / 2 * 2**depth), F.lit(top)).cast("bigint").alias(a)
    return F.struct(*[at(a) for a in _AXES])


def _gaps(depth: int) -> tuple[Column, Column]:
    """Squared distances from the point `_v` to the nearest and the farthest point of the cube `_cube`."""
    near, far = F.lit(0.0), F.lit(0.0)
    width = 2.0 / 2**depth
    for a in _AXES:
        low = F.col("_cube")[a] * width - 1
        below, above = low - F.col("_v")[a], F.col("_v")[a] - (low + width)
        gap = F.greatest(below, above, F.lit(0.0))
        reach = F.greatest(F.abs(below), F.abs(above))
        near, far = near + gap * gap, far + reach * reach
    return near, far


def _square(a: Column, b: Column) -> Column:
    """Squared distance of two vectors."""
    total = F.lit(0.0)
    for axis in _AXES:
        total = total + (a[axis] - b[axis]) * (a[axis] - b[axis])
    return total


def _not_beyond(square: Column) -> Column:
    """Whether something at this squared distance is no farther away than `_best`, a squared distance as well."""
    edge = F.sqrt("_best") + SLACK
    return square <= edge * edge


def _placed(at: Sequence[str]) -> Column:
    lat, lon = (F.col(f"`{c}`").cast("double") for c in at)
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat + lon) < float("inf")), F.lit(False))


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    left_at: tuple[str, str],
    right_at: tuple[str, str],
    right_key: str,
    leaf_rows: int = LEAF_ROWS,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Each left row with the right row nearest to it and `metres`, their distance; points are (latitude, longitude) in degrees.

    Of right rows equally far in whole metres the one with the smallest `right_key` is taken.  Left rows without a
    position, or all if the right side has no positions, have nulls; right rows without one are never found.  Column
    names of both sides must differ.
    """
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"columns on both sides: {', '.join(sorted(clash))}")
    place = lambda at: [F.col(f"`{c}`") for c in at]
    vector = F.when(_placed(left_at), _vector(*place(left_at))).alias("_v")
    rows = stored(left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"), vector, F.monotonically_increasing_id().alias("_id")), "nearest-left")
    one = F.min_by(F.struct(*[F.col(f"`{c}`") for c in right.columns]), F.col(f"`{right_key}`")).alias("_point")
    places = right.where(_placed(right_at)).groupBy(*[c.cast("double").alias(f"_at{i}") for i, c in enumerate(place(right_at))]).agg(one)
    points = stored(places.select("_point", _vector(F.col("_at0"), F.col("_at1")).alias("_u")), "nearest-right")
    tree, held = _tree(points, leaf_rows)
    if held is None:
        near = rows.select("_id", F.lit(None).cast(points.schema["_point"].dataType).alias("_point")).limit(0)
    else:
        here = rows.where("_v IS NOT NULL").select("_id", "_v")
        tasks = _tasks(here.count(), WALKERS)
        reach = _reach(here.repartition(tasks, "_id"), tree, held, leaf_rows, rows_per_task)
        asked = _asked(stored(reach.repartition(tasks, "_id"), "nearest-reach"), tree, rows_per_task)
        pairs = _beside_points(asked, held, leaf_rows, rows_per_task)
        near = pairs.where(_not_beyond(_square(F.col("_u"), F.col("_v")))).select("_id", "_point")
    met = rows.select("_id", "_row").join(near, "_id", "left")
    km = haversine_km(*[F.col("_row")[c] for c in left_at], *[F.col("_point")[c] for c in right_at])
    met = met.withColumn("metres", F.when(F.col("_point").isNotNull(), F.round(km * 1000).cast("bigint")))
    order = F.struct("metres", F.col("_point")[right_key])
    best = met.groupBy("_id").agg(F.first("_row").alias("_row"), F.min_by(F.struct("metres", "_point"), order).alias("_best"))
    return best.select("_row.*", "_best._point.*", F.col("_best.metres").alias("metres"))


def _tasks(work: int, of_one: int) -> int:
    return max(1, -(-work // of_one))


def _root() -> Column:
    return F.struct(*[F.lit(0).cast("bigint").alias(a) for a in _AXES]).alias("_parent")


def _tree(points: DataFrame, leaf_rows: int) -> tuple[list[tuple[int, DataFrame]], DataFrame | None]:
    """For each depth the cubes below those that were too full, as (`_parent`, `_cube`, `_leaf`, `_mid`), and all points
    with `_depth` and `_cube` of their leaf."""
    full, tree, held = points.select("_u", "_point", _root()), [], None
    mid = F.struct(*[F.avg(F.col("_u")[a]).alias(a) for a in _AXES]).alias("_mid")
    for depth in range(STEP, MAX_DEPTH + 1, STEP):
        is_leaf = (F.count(F.lit(1)) <= leaf_rows) | F.lit(depth == MAX_DEPTH)
        cubes = stored(full.groupBy("_parent", _cube("_u", depth).alias("_cube")).agg(is_leaf.alias("_leaf"), mid), "nearest-cubes")
        if cubes.isEmpty():
            break
        tree.append((depth, cubes))
        placed = full.select("_u", "_point", _cube("_u", depth).alias("_cube")).join(cubes.select("_cube", "_leaf"), "_cube")
        placed = stored(placed, "nearest-points")
        full = placed.where("NOT _leaf").select("_u", "_point", F.col("_cube").alias("_parent"))
        leaves = placed.where("_leaf").select(F.lit(depth).alias("_depth"), "_cube", "_u", "_point")
        held = leaves if held is None else held.unionByName(leaves)
    return tree, held


def _beside(walkers: DataFrame, cubes: DataFrame, rows_per_task: int | None) -> DataFrame:
    """Walkers and what lies below their `_parent`."""
    if fits_broadcast(cubes):
        return walkers.join(F.broadcast(cubes), "_parent")
    return equi_join(walkers, cubes, "_parent", rows_per_task=rows_per_task)


def _beside_points(walkers: DataFrame, held: DataFrame, leaf_rows: int, rows_per_task: int | None) -> DataFrame:
    """Walkers and the points of their leaves."""
    tasks = _tasks(walkers.count() * leaf_rows, PAIRS)
    return equi_join(walkers, held, ["_depth", "_cube"], rows_per_task=rows_per_task, partitions=tasks)


def _reach(here: DataFrame, tree: Sequence[tuple[int, DataFrame]], held: DataFrame, leaf_rows: int, rows_per_task: int | None) -> DataFrame:
    """(`_id`, `_v`, `_best`): left points and the squared distance to a right point that is near, mostly not the nearest."""
    walkers, ends = here.select("_id", "_v", _root()), None
    gap = lambda c: _square(c["_mid"], F.col("_v")).alias("gap")
    for depth, cubes in tree:
        below = cubes.groupBy("_parent").agg(F.collect_list(F.struct("_mid", "_cube", "_leaf")).alias("_below"))  # 64 at most
        nearest = F.array_min(F.transform("_below", lambda c: F.struct(gap(c), c["_cube"].alias("_cube"), c["_leaf"].alias("_leaf"))))
        met = _beside(walkers, below, rows_per_task).select("_id", "_v", nearest.alias("_to"))
        met = stored(met.select("_id", "_v", "_to._cube", "_to._leaf"), "nearest-paths")
        walkers = met.where("NOT _leaf").select("_id", "_v", F.col("_cube").alias("_parent"))
        end = met.where("_leaf").select("_id", "_v", F.lit(depth).alias("_depth"), "_cube")
        ends = end if ends is None else ends.unionByName(end)
    pairs = _beside_points(ends, held.drop("_point"), leaf_rows, rows_per_task)
    return pairs.groupBy("_id", "_v").agg(F.min(_square(F.col("_u"), F.col("_v"))).alias("_best"))


def _asked(reach: DataFrame, tree: Sequence[tuple[int, DataFrame]], rows_per_task: int | None) -> DataFrame:
    """The leaves, `_depth` and `_cube`, that can hold the nearest point of a left point."""
    frontier, asked = reach.withColumn("_parent", _root()), None
    for depth, cubes in tree:
        near, far = _gaps(depth)
        met = _beside(frontier, cubes.drop("_mid"), rows_per_task)
        met = met.where(_not_beyond(near)).select("_id", "_v", "_best", "_cube", "_leaf", near.alias("_near"), far.alias("_far"))
        nearest = F.min("_far").over(Window.partitionBy("_id"))
        kept = met.withColumn("_best", F.least("_best", nearest)).where(_not_beyond(F.col("_near")))
        kept = stored(kept.drop("_near", "_far"), "nearest-kept")
        frontier = kept.where("NOT _leaf").select("_id", "_v", "_best", F.col("_cube").alias("_parent"))
        leaves = kept.where("_leaf").select("_id", "_v", "_best", F.lit(depth).alias("_depth"), "_cube")
        asked = leaves if asked is None else asked.unionByName(leaves)
    return stored(asked, "nearest-asked")
