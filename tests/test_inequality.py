"""Inequality joins against all pairs, and what their plans hold."""

import datetime as dt
import math
import operator
import random

import pytest

from rillstone.operators import inequality
from rillstone.operators.inequality import inequality_join
from tests.conftest import plan_of

OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def _less(a, b):
    """Spark's order of doubles: NaN is the largest."""
    return not math.isnan(a) and (math.isnan(b) or a < b)


def _holds(a, op, b):
    if a is None or b is None:
        return False
    if isinstance(a, float) and isinstance(b, float):
        return {"<": _less(a, b), ">": _less(b, a), "<=": not _less(b, a), ">=": not _less(a, b)}[op]
    return OPS[op](a, b)


def _sides(seed, n, m):
    rng = random.Random(seed)
    number = lambda: rng.choice([None, float("nan"), 0.0, -0.0, rng.uniform(-5, 5), rng.randint(-5, 5) * 1.0, 1.5])
    left = [(i, rng.choice([None, *range(8)]), number(), rng.randint(0, 20)) for i in range(n)]
    right = [(i, rng.choice([None, *range(8)]), number(), rng.randint(0, 20), rng.randint(0, 20)) for i in range(m)]
    return left, right


LEFT, RIGHT = ["a", "ai", "ad", "ax"], ["b", "bi", "bd", "bx", "by"]
CASES = [
    *[[("ad", op, "bd")] for op in OPS],
    [("ax", ">=", "bx"), ("ax", "<=", "by")],
    [("ax", "<", "bx"), ("ai", ">", "bx")],
    [("ai", "<", "bi"), ("ad", ">=", "bd")],
    [("ai", "<=", "bi"), ("ad", ">", "bd"), ("ax", "<", "bx")],
    [("ax", ">", "bx"), ("ax", "<", "by"), ("ai", ">=", "bi"), ("ad", "<=", "bd")],
]


@pytest.mark.parametrize("conditions", CASES, ids=str)
@pytest.mark.parametrize("block_rows, fan_out, rows_per_task", [(2, 2, None), (4, 3, 7)])
def test_pairs_are_those_of_all_pairs(spark, conditions, block_rows, fan_out, rows_per_task):
    left, right = _sides(len(conditions), 60, 45)
    left, right = left + left[:3], right + right[:2]
    l = spark.createDataFrame(left, "a int, ai int, ad double, ax int")
    r = spark.createDataFrame(right, "b int, bi int, bd double, bx int, by int")
    found = inequality_join(l, r, conditions, block_rows, fan_out, rows_per_task)
    assert found.columns == LEFT + RIGHT
    wanted = [
        (*x, *y) for x in left for y in right
        if all(_holds(x[LEFT.index(a)], op, y[RIGHT.index(b)]) for a, op, b in conditions)
    ]
    assert sorted(map(str, (tuple(q) for q in found.collect()))) == sorted(map(str, wanted))
    assert wanted


def test_other_columns_types_and_empty_sides(spark):
    day = lambda n: dt.date(2024, 1, n)
    l = spark.createDataFrame([(day(1), {"k": 1}, [1]), (day(5), {}, None), (None, None, None)], "d date, m map<string,int>, list array<int>")
    r = spark.createDataFrame([(day(1), "x"), (day(3), "y"), (day(9), None)], "e date, t string")
    found = inequality_join(l, r, [("d", ">=", "e")])
    assert sorted((q["d"].day, q["m"], q["t"]) for q in found.collect()) == [(1, {"k": 1}, "x"), (5, {}, "x"), (5, {}, "y")]
    assert inequality_join(l, r.limit(0), [("d", ">=", "e")]).collect() == []
    assert inequality_join(l.limit(0), r, [("d", ">=", "e")]).collect() == []


def test_wrong_calls(spark):
    l, r = spark.range(2), spark.range(2)
    with pytest.raises(ValueError, match="both sides"):
        inequality_join(l, r, [("id", "<", "id")])
    with pytest.raises(ValueError, match="conditions"):
        inequality_join(l, r.toDF("o"), [("id", "=", "o")])
    with pytest.raises(ValueError, match="conditions"):
        inequality_join(l, r.toDF("o"), [])


def test_work_follows_the_output(spark):
    """Ten thousand rows on both sides with ten thousand pairs: copies stay far below the hundred million of all pairs."""
    n = 10_000
    l = spark.range(n).selectExpr("id AS a", "id AS low", "id + 1 AS high", "-id AS x")
    r = spark.range(n).selectExpr("id AS b", "id AS value", "-id AS y")
    found = inequality_join(l, r, [("low", "<=", "value"), ("high", ">", "value"), ("x", ">=", "y")])
    plan = plan_of(found)
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert found.count() == n
    copies = [p for p in _stored_paths(found) if "inequality-copies" in p]
    assert len(copies) == 1 and spark.read.parquet(copies[0]).count() < 20 * n


def _stored_paths(df):
    return sorted({p.rsplit("/", 1)[0] for p in df.inputFiles()})


def test_many_levels_are_one_expression_each(spark):
    """Eleven levels: the ends of an interval were nested in those of the level below, three times in each."""
    n = 1500
    l = spark.range(40).selectExpr("id AS a", "id * 30 AS low", "id AS x")
    r = spark.range(n).selectExpr("id AS b", "id AS value", "id % 40 AS y")
    assert len(inequality._interval(11, 2)._jc.toString()) < 3 * len(inequality._interval(5, 2)._jc.toString())
    found = inequality_join(l, r, [("low", "<=", "value"), ("x", ">", "y")], block_rows=1, fan_out=2)
    assert found.count() == sum(a > b % 40 for a in range(40) for b in range(a * 30, n))


def test_copies_are_dealt_by_the_pairs_that_they_make(spark, monkeypatch):
    """The left rows with the most partners are neighbours in the order; no task makes the copies of them all."""
    monkeypatch.setattr(inequality, "PAIRS", 2_000)
    l, r = spark.range(2_000).selectExpr("id AS a"), spark.range(1_900, 2_000).selectExpr("id AS b")
    found = inequality_join(l, r, [("a", ">", "b")], block_rows=4)
    assert found.count() == 99 * 100 // 2
    l = spark.range(2_000).selectExpr("id - 1700 AS a")
    r = spark.range(300).selectExpr("id AS b")
    found = inequality_join(l, r, [("a", ">", "b")], block_rows=4)
    assert found.count() == 299 * 300 // 2
    (copies,) = [p for p in _stored_paths(found) if "inequality-copies" in p]
    made = [q["count"] for q in spark.read.parquet(copies).groupBy("_metadata.file_path").count().collect()]
    assert len(made) > 15 and max(made) < sum(made) / 4
    assert found.rdd.getNumPartitions() > 15


def test_no_task_puts_too_many_rows_in_order(spark, monkeypatch):
    monkeypatch.setattr(inequality, "SORTED_ROWS", 100)
    l = spark.range(1_000).selectExpr("id AS a", "id AS low", "id + 1 AS high")
    r = spark.range(1_000).selectExpr("id AS b", "id AS value")
    found = inequality_join(l, r, [("low", "<=", "value"), ("high", ">=", "value")])
    assert found.count() == 1_999
    (order,) = [p for p in _stored_paths(found) if "inequality-order" in p]
    held = [q["count"] for q in spark.read.parquet(order).groupBy("_task").count().collect()]
    assert len(held) >= 25 and max(held) <= 400
