import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from rillstone.functions.geo import haversine_km
from rillstone.operators import enrich, joins
from tests.conftest import plan_of, rows_of


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "Ada"), (3, "Ben"), (4, "Cleo"), (6, "Dag"), (7, "Eva")], "id int, name string")


@pytest.fixture
def places(spark):
    return spark.createDataFrame([(1, "Ulm"), (2, "Graz"), (4, "Bern"), (5, "Kiel"), (7, "Linz"), (9, "Chur")], "id int, state string")


INNER = {(1, "Ada", "Ulm"), (4, "Cleo", "Bern"), (7, "Eva", "Linz")}
LEFT = {(3, "Ben", "NULL"), (6, "Dag", "NULL")}
RIGHT = {(2, "NULL", "Graz"), (5, "NULL", "Kiel"), (9, "NULL", "Chur")}


@pytest.mark.parametrize("how,want", [("inner", INNER), ("left", INNER | LEFT), ("right", INNER | RIGHT), ("full", INNER | LEFT | RIGHT)])
def test_named_joins(people, places, how, want):
    assert {tuple(r) for r in joins.named_join(people, places, "id", how).collect()} == want


NODES = {
    "broadcast_first": ("BroadcastHashJoin", "BuildLeft"),
    "broadcast_second": ("BroadcastHashJoin", "BuildRight"),
    "shuffle_hash_first": ("ShuffledHashJoin", "BuildLeft"),
    "shuffle_hash_second": ("ShuffledHashJoin", "BuildRight"),
    "merge": ("SortMergeJoin", ""),
}


@pytest.mark.parametrize("strategy", list(joins.STRATEGIES))
def test_strategies_give_one_result_and_their_node(people, places, strategy):
    out = joins.hinted_join(people, places, "id", strategy)
    assert {tuple(r) for r in out.collect()} == INNER
    node, side = NODES.get(strategy, ("Join", ""))
    assert node in plan_of(out) and side in plan_of(out)


def test_a_side_that_is_too_large_is_not_broadcast(people, places):
    out = joins.hinted_join(people, places, "id", "broadcast_first", max_rows=3)
    assert {tuple(r) for r in out.collect()} == INNER
    assert "ResolvedHint" not in out._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("how,node", [("right", "BroadcastHashJoin"), ("left", "SortMergeJoin"), ("full", "SortMergeJoin")])
def test_only_a_copyable_side_is_broadcast(spark, people, places, how, node):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = joins.named_join(people, places, "id", how, "broadcast_first")
        assert node in plan_of(out)
        assert {tuple(r) for r in out.collect()} == INNER | (RIGHT if how != "left" else set()) | (LEFT if how != "right" else set())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


SQL_NODES = {
    "BROADCAST": "BroadcastHashJoin", "SHUFFLE_HASH": "ShuffledHashJoin", "SHUFFLE_MERGE": "SortMergeJoin",
}


@pytest.mark.parametrize("hint", list(SQL_NODES))
def test_sql_hints(people, places, hint):
    out = joins.sql_join(people, places, hint, "l.id = r.id", "l.id, name, state")
    assert {tuple(r) for r in out.collect()} == INNER
    assert SQL_NODES[hint] in plan_of(out)


def test_nest_loop_hint(people, places):
    out = joins.sql_join(people, places, "NEST_LOOP", "l.id < r.id", "l.id AS a, r.id AS b")
    assert "BroadcastNestedLoopJoin" in plan_of(out)
    assert out.count() == sum(a < b for a in (1, 3, 4, 6, 7) for b in (1, 2, 4, 5, 7, 9))


def test_nest_loop_without_a_small_side_is_no_product(people, places):
    with pytest.warns(UserWarning, match="grid"):
        out = joins.sql_join(people, places, "NEST_LOOP", "l.id < r.id", "l.id AS a, r.id AS b", max_rows=2, rows_per_task=2)
    assert "Cartesian" not in plan_of(out) and "NestedLoop" not in plan_of(out)
    assert rows_of(out) == sorted(((a, b) for a in (1, 3, 4, 6, 7) for b in (1, 2, 4, 5, 7, 9) if a < b), key=str)


def test_an_unfit_broadcast_becomes_a_plain_join(people, places):
    with pytest.warns(UserWarning, match="without a hint"):
        out = joins.sql_join(people, places, "BROADCAST", "l.id = r.id", "l.id, name, state", max_rows=2)
    assert "Hint" not in out._jdf.queryExecution().logical().toString() and {tuple(r) for r in out.collect()} == INNER


def most_in_a_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_pairs_of_a_key_spread_over_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("l"))
        right = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("r"))
        out = joins.equi_join(left, right, "k", hint=("left", "merge"), rows_per_task=1000)
        assert out.count() == 1_000_000 and most_in_a_task(out) < 200_000
        assert out.distinct().count() == 1_000_000
        same = spark.range(10_000).select(F.lit(1).alias("k"), F.lit("x").alias("l")).coalesce(1)
        one = spark.createDataFrame([(1, "y")], "k int, r string")
        out = joins.equi_join(same, one, "k", hint=("left", "merge"), rows_per_task=100)
        assert out.count() == 10_000 and most_in_a_task(out) < 2_000
    finally:
        spark.conf.unset("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_streams_are_joined_by_spark(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, l string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k int, l string").parquet(f"{tmp_path}/in")
    fixed = spark.createDataFrame([(1, "x")], "k int, r string")
    assert joins.named_join(stream, fixed, "k", "left").isStreaming
    assert joins.hinted_join(stream, fixed, "k", "broadcast_first").isStreaming


def test_asof_join_of_nulls(spark):
    left = spark.createDataFrame([("a", 5, 1), (None, 5, 2), ("a", None, 3), ("b", 5, 4)], "k string, t bigint, id bigint")
    right = spark.createDataFrame([("a", 1, 10, "v"), (None, 1, 11, "n"), ("b", None, 12, "w")], "k string, vt bigint, vid bigint, rate string")
    got = joins.asof_join(left, right, ["k"], ["t", "id"], ["vt", "vid"], ["rate"])
    assert {r["id"]: r["rate"] for r in got.collect()} == {1: "v", 2: None, 3: None, 4: None}


def skewed(spark, n, seed, prefix, hot):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = rng.choice([hot, hot, None, rng.randrange(40)])
        # many exact copies of one row
        rows.append((key, rng.randrange(3), f"{prefix}{i if rng.random() < 0.7 else 0}"))
    return spark.createDataFrame(rows, f"k int, k2 int, {prefix} string").repartition(5)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("hot", [(7, 7), (7, 100), (100, 9)])
def test_heavy_join_keys_are_spread_without_changing_the_result(spark, how, hot):
    left, right = skewed(spark, 300, 1, "l", hot[0]), skewed(spark, 200, 2, "r", hot[1])
    whole = rows_of(left.join(right, ["k"], how))
    assert rows_of(joins.equi_join(left, right, "k", how, rows_per_task=20)) == whole
    pair = rows_of(left.join(right, ["k", "k2"], how))
    assert rows_of(joins.equi_join(left, right, ["k", "k2"], how, rows_per_task=9)) == pair


@pytest.mark.parametrize("how", ["inner", "full"])
def test_spread_keys_keep_the_strategy(spark, how):
    left, right = skewed(spark, 300, 1, "l", 7), skewed(spark, 200, 2, "r", 7)
    out = joins.hinted_join(left, right, "k", "shuffle_hash_second", how, rows_per_task=20)
    assert "ShuffledHashJoin" in plan_of(out)


def test_key_names_may_differ(people, places):
    out = joins.equi_join(people, places.withColumnRenamed("id", "place"), {"id": "place"})
    assert {tuple(r) for r in out.collect()} == INNER


def test_theta_join_by_broadcast_and_by_grid(spark):
    left = spark.createDataFrame([(i % 13, i) for i in range(90)], "x int, l int")
    right = spark.createDataFrame([(i % 11, i) for i in range(50)], "y int, r int")
    want = sorted((i % 13, i, j % 11, j) for i in range(90) for j in range(50) if i % 13 < j % 11)
    small = joins.theta_join(left, right, F.col("x") < F.col("y"))
    assert "BroadcastNestedLoopJoin" in plan_of(small)
    large = joins.theta_join(left, right, F.col("x") < F.col("y"), rows_per_task=17, max_rows=5)
    assert "NestedLoop" not in plan_of(large) and "Cartesian" not in plan_of(large)
    assert sorted(tuple(r) for r in small.collect()) == sorted(tuple(r) for r in large.collect()) == want


def test_lookup_join_small_and_large(people, places):
    small = joins.lookup_join(people, places, "id")
    large = joins.lookup_join(people, places, "id", max_rows=2)
    assert "BroadcastHashJoin" in plan_of(small)
    assert rows_of(small) == rows_of(large) and small.count() == 5


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("rows_per_task", [10_000, 20])
def test_asof_join_against_a_search(spark, inclusive, rows_per_task):
    rng = random.Random(11)
    probe = [(rng.choice("aaaab"), rng.randrange(300), i) for i in range(200)]
    versions = [(rng.choice("aaaac"), rng.randrange(300), 1000 + i, f"v{i}") for i in range(120)]
    left = spark.createDataFrame(probe, "k string, t bigint, id bigint")
    right = spark.createDataFrame(versions, "k string, vt bigint, vid bigint, rate string")
    got = joins.asof_join(left, right, ["k"], ["t", "id"], ["vt", "vid"], ["vt", "rate"], inclusive, rows_per_task)
    want = []
    for k, t, i in probe:
        known = [(vt, vid, rate) for vk, vt, vid, rate in versions if vk == k and (vt <= t if inclusive else vt < t)]
        best = max(known, default=(None, None, None))
        want.append((k, t, i, best[0], best[2]))
    assert rows_of(got) == sorted(want, key=str)


def test_window_join_counts_pairs(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    a = spark.createDataFrame([("x", t(1)), ("x", t(3)), ("x", t(7)), ("y", t(1))], "k string, ta timestamp")
    b = spark.createDataFrame([("x", t(2)), ("x", t(4)), ("y", t(9))], "k string, tb timestamp")
    out = joins.window_join(a, b, ["k"], "ta", "tb", "5 seconds", None, [F.count("*").alias("na")], [F.count("*").alias("nb")])
    assert [(r["k"], r["na"], r["nb"]) for r in out.collect()] == [("x", 2, 2)]


def test_nearby_join_against_all_pairs(spark):
    rng = random.Random(5)
    def points(n, base):
        out = []
        for i in range(n):
            lat, lon = rng.choice([(48.1, 11.5), (0.0, 179.999), (89.9, 0.0), (-89.95, 120.0), (60.0, -180.0)])
            lon += rng.uniform(-0.06, 0.06) if abs(lat) < 80 else rng.uniform(-180, 180)
            out.append((base + i, max(-90.0, min(90.0, lat + rng.uniform(-0.04, 0.04))), (lon + 180) % 360 - 180))
        return out

    left, right = points(80, 0), points(80, 1000)
    l = spark.createDataFrame(left, "ride bigint, la double, lo double")
    r = spark.createDataFrame(right, "driver bigint, dla double, dlo double")
    pairs = l.join(F.broadcast(r), haversine_km(F.col("la"), F.col("lo"), F.col("dla"), F.col("dlo")) < 2.0)
    want = {(x["ride"], x["driver"]) for x in pairs.collect()}
    got = joins.nearby_join(l, r, ("la", "lo"), ("dla", "dlo"), 2.0).collect()
    assert {(x["ride"], x["driver"]) for x in got} == want and len(got) == len(want) > 20
    assert all(x["distance_km"] < 2 for x in got)


def test_haversine(spark):
    row = spark.range(1).select(haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0))).first()
    assert math.isclose(row[0], 6371.0 * math.pi / 2, rel_tol=1e-9)


def test_ship_delay_and_spending(spark):
    orders = spark.createDataFrame([(1, "c1", dt.date(2024, 1, 1)), (2, "c1", dt.date(2024, 1, 5)), (3, "c2", dt.date(2024, 1, 1))], "o int, c string, d date")
    ships = spark.createDataFrame([(1, dt.date(2024, 1, 3)), (1, dt.date(2024, 1, 4)), (2, dt.date(2024, 1, 6)), (9, dt.date(2024, 1, 6))], "so int, s date")
    assert [tuple(r) for r in enrich.ship_delay(orders, ships, "o", "c", "d", "so", "s").collect()] == [("c1", 6, 3, 2.0)]
    pay = spark.createDataFrame([("u1", 5), ("u1", 6), ("u2", 7), ("u9", 1)], "u string, a bigint")
    who = spark.createDataFrame([("u1", "gold"), ("u2", "silver")], "id string, level string")
    for limit in (None, 1):
        out = enrich.spend_by(pay, "u", F.col("a"), who, "id", "level", limit)
        assert rows_of(out) == [("gold", 11, 2), ("silver", 7, 1)]


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_map_columns_of_heavy_keys(spark, how):
    left = spark.createDataFrame([(i % 3, {"k": i}, [{"n": i}]) for i in range(60)], "id int, m map<string,int>, l array<map<string,int>>")
    right = spark.createDataFrame([(i % 4, {i: "v"}) for i in range(40)], "id int, w map<int,string>")
    shown = lambda df: sorted(str(sorted(r.asDict().items(), key=str)) for r in df.collect())
    plain, spread = (joins.equi_join(left, right, "id", how, rows_per_task=n) for n in (1_000, 5))
    assert "_at_l" in plan_of(spread) and shown(spread) == shown(plain)


def test_light_rows_are_not_sorted_before_the_join(spark, tmp_path):
    spark.range(1_000).selectExpr("if(id < 600, 0, id) AS k", "id AS a").write.parquet(f"{tmp_path}/l")
    left, right = spark.read.parquet(f"{tmp_path}/l"), spark.range(50).selectExpr("id AS k", "-id AS b")
    plan = plan_of(joins.equi_join(left, right, "k", "inner", ("right", "shuffle_hash"), rows_per_task=100))
    sorts = plan.split("Sort [xxhash64")[1:]
    # what is sorted is what meets the table of heavy keys
    assert sorts and all(-1 < part.find("Inner") < (part.find("LeftAnti") % len(plan)) for part in sorts) and "LeftAnti" in plan
