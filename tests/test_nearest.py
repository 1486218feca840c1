"""The nearest point against a comparison of all pairs."""

import math
import random

import pytest

from rillstone.operators import nearest
from rillstone.operators.nearest import nearest_join
from tests.conftest import plan_of

NONE = float("nan")


def _metres(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h))) * 1000


def _sides(seed):
    rng = random.Random(seed)
    anywhere = lambda: (math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180))
    dense = lambda: (48.2 + rng.gauss(0, 3e-3), 16.3 + rng.gauss(0, 3e-3))
    rides = [anywhere() for _ in range(60)] + [dense() for _ in range(30)] + [(90.0, 0.0), (-90.0, 12.0), (10.0, 180.0), (10.0, -180.0), (48.2, 16.3)]
    drivers = [anywhere() for _ in range(40)] + [dense() for _ in range(300)] + [(48.2, 16.3)] * 90 + [(10.0, 179.99), (89.9, 77.0)]
    return rides, drivers


@pytest.mark.parametrize("leaf_rows, rows_per_task", [(8, None), (64, 20)])
def test_the_nearest_is_that_of_all_pairs(spark, leaf_rows, rows_per_task):
    rides, drivers = _sides(3)
    left = [(i, *p, "r") for i, p in enumerate(rides)] + [(900, None, 1.0, "r"), (901, 1.0, None, None), (902, NONE, 1.0, "x")]
    right = [(i, *p) for i, p in enumerate(drivers)] + [(9_000, None, None), (9_001, NONE, 0.0)]
    l = spark.createDataFrame(left, "ride int, lat double, lon double, _cube string")
    r = spark.createDataFrame(right, "driver int, dlat double, dlon double")
    if rows_per_task:
        spark.conf.set("spark.rillstone.broadcastRows", "1")
    try:
        found = nearest_join(l, r, ("lat", "lon"), ("dlat", "dlon"), "driver", leaf_rows, rows_per_task).collect()
    finally:
        spark.conf.unset("spark.rillstone.broadcastRows")
    assert len(found) == len(left)
    for row in found:
        if row["ride"] >= 900:
            assert row["driver"] is None and row["metres"] is None
            continue
        best = min((round(_metres(rides[row["ride"]], p)), i) for i, p in enumerate(drivers))
        assert (row["metres"], row["driver"]) == best


def test_few_cubes_are_kept_where_points_are_dense(spark):
    """Two thousand rides in the midst of two thousand drivers of one street: cubes, not pairs."""
    l = spark.range(2_000).selectExpr("id AS ride", "48 + (id * 7919 % 2003) / 1e6 AS lat", "16 + (id * 104729 % 1999) / 1e6 AS lon")
    r = spark.range(2_000).selectExpr("id AS driver", "48 + (id * 6007 % 2011) / 1e6 AS dlat", "16 + (id * 8009 % 1997) / 1e6 AS dlon")
    found = nearest_join(l, r, ("lat", "lon"), ("dlat", "dlon"), "driver", 8)
    assert "Cartesian" not in plan_of(found) and found.count() == 2_000
    kept = {p.rsplit("/", 1)[0] for p in found.inputFiles() if "nearest-asked" in p}
    assert all(spark.read.parquet(p).count() < 2_000 * 25 for p in kept)


def test_cubes_beyond_a_measured_point_are_dropped(spark, monkeypatch):
    """Sides spread over the globe: on no level does a ride keep more than a few cubes, of any size."""
    kept, sizes = nearest.stored, {}

    def spied(df, name):
        out = kept(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(nearest, "stored", spied)
    l = spark.range(2_000).selectExpr("id AS ride", "id * 7919 % 16001 / 100.0 - 80 AS lat", "id * 104729 % 36007 / 100.0 - 180 AS lon")
    r = spark.range(3_000).selectExpr("id AS driver", "id * 6007 % 15991 / 100.0 - 80 AS dlat", "id * 8009 % 35999 / 100.0 - 180 AS dlon")
    assert nearest_join(l, r, ("lat", "lon"), ("dlat", "dlon"), "driver", 8).count() == 2_000
    assert len(sizes["nearest-kept"]) > 1 and max(sizes["nearest-kept"]) < 2_000 * 6
    assert sizes["nearest-asked"][0] < 2_000 * 6


@pytest.mark.parametrize("rows_per_task", [None, 50])
def test_a_path_that_leads_astray_only_costs_time(spark, rows_per_task):
    """A lone driver and a dense street, with rides between: the measured point is often not the nearest."""
    rng = random.Random(5)
    drivers = [(0.5, 0.5)] + [(1 + rng.random() / 50, 1 + rng.random() / 50) for _ in range(400)] + [(-90.0, 0.0), (0.0, 180.0)]
    rides = [(rng.uniform(0.4, 1.1), rng.uniform(0.4, 1.1)) for _ in range(80)] + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(80)]
    l = spark.createDataFrame([(i, *p) for i, p in enumerate(rides)], "ride int, lat double, lon double")
    r = spark.createDataFrame([(i, *p) for i, p in enumerate(drivers)], "driver int, dlat double, dlon double")
    found = nearest_join(l, r, ("lat", "lon"), ("dlat", "dlon"), "driver", 4, rows_per_task).collect()
    best = [min((round(_metres(ride, p)), i) for i, p in enumerate(drivers)) for ride in rides]
    assert sorted((q["ride"], q["metres"], q["driver"]) for q in found) == [(i, *b) for i, b in enumerate(best)]


def test_empty_sides(spark):
    l = spark.createDataFrame([(1, 2.0, 3.0)], "ride int, lat double, lon double")
    r = spark.createDataFrame([], "driver int, dlat double, dlon double")
    assert [tuple(x) for x in nearest_join(l, r, ("lat", "lon"), ("dlat", "dlon"), "driver").collect()] == [(1, 2.0, 3.0, None, None, None, None)]
    assert nearest_join(r, l, ("dlat", "dlon"), ("lat", "lon"), "ride").collect() == []
    with pytest.raises(ValueError, match="both sides"):
        nearest_join(l, l, ("lat", "lon"), ("lat", "lon"), "ride")
