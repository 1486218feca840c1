import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from rillstone.operators import rolling as r
from rillstone.operators.aggregates import final_state
from rillstone.operators.skew import HEAVY, cut_heavy, plan_chunks
from tests.conftest import plan_of

RECORD = ["category", "product", "profit"]


def may(df, *names):
    return [tuple(row[n] for n in names) for row in df.filter("month = 'May'").orderBy("seq").collect()]


def test_rolling_sum_in_file_order(profits):
    out = r.roll(profits, ["month"], ["seq"], r.rolling_sum("profit", "s"))
    assert [x for (x,) in may(out, "s")] == [17, 26, 70, 96, 105, 149, 162]


def test_field_only_and_whole_record_minimum(profits):
    out = r.roll(
        profits, ["month"], ["seq"], r.rolling_min("profit", "low"), r.rolling_first("product", "p"),
        r.rolling_first("category", "c"), r.rolling_min_by("profit", RECORD, "rec"),
    )
    row = out.filter("month = 'May'").orderBy("seq").collect()[1]
    assert (row["c"], row["p"], row["low"]) == ("Garden", "Rake", 9)
    assert tuple(row["rec"]["_r"]) == ("Kitchen", "Kettle", 9)


def test_ties_keep_the_first_or_the_last_record(profits):
    out = r.roll(
        profits, ["month"], ["seq"], r.rolling_max_by("profit", RECORD, "a"), r.rolling_max_by("profit", RECORD, "b", last=True)
    )
    row = out.filter("month = 'May'").orderBy(F.desc("seq")).first()
    assert tuple(row["a"]["_r"]) == ("Office", "Lamp", 44)
    assert tuple(row["b"]["_r"]) == ("Office", "Chair", 44)


def test_final_state(profits):
    out = {x["month"]: x for x in final_state(profits, ["month"], "profit", ["seq"], RECORD).collect()}
    assert [(m, out[m]["n"], out[m]["total"], out[m]["smallest"], out[m]["largest"]) for m in ("May", "November", "September")] == [
        ("May", 7, 162, 9, 44), ("November", 1, 23, 23, 23), ("September", 4, 113, 12, 58),
    ]
    assert tuple(out["May"]["max_last"]) == ("Office", "Chair", 44)
    assert out["May"]["mean"] == 162 / 7


def heavy_rows(n, seed=3):
    """Key 'h' holds most rows, crowded into few positions; some keys, values and positions are null."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = rng.choice(["h", "h", "h", "a", "b", None, None])
        at = int(rng.expovariate(1 / 50)) if rng.random() < 0.9 else rng.randrange(10_000_000)
        if rng.random() < 0.02:
            at = None
        out.append((key, at, i, rng.choice([None, *range(-5, 6)]), rng.choice("xyz")))
    return out


SCHEMA = "k string, at bigint, id bigint, v bigint, tag string"
ALL = [
    r.rolling_sum("v", "r_sum"),
    r.rolling_count("r_count"),
    r.rolling_min("v", "r_min"),
    r.rolling_max("v", "r_max"),
    r.rolling_first("tag", "r_first"),
    r.rolling_last_known("v", "r_last"),
    r.rolling_min_by("v", ["id"], "r_min_by"),
    r.rolling_max_by("v", ["id"], "r_max_by", last=True),
]


def test_heavy_keys_are_cut_and_give_the_same_result(spark):
    df = spark.createDataFrame(heavy_rows(3000), SCHEMA)
    whole = r.roll(df, ["k"], ["at", "id"], *ALL).orderBy("id").collect()
    cut = r.roll(df, ["k"], ["at", "id"], *ALL, rows_per_task=50).orderBy("id").collect()
    assert cut == whole


def test_ranges_are_refined_until_no_task_is_too_full(spark):
    df = spark.createDataFrame(heavy_rows(3000), SCHEMA).filter("at is not null")
    plan = plan_chunks(df, ["k"], "at", 100)
    assert len(plan.levels) > 1
    chunked = plan.apply_marked(df)
    assert chunked.count() == 3000 - sum(x[1] is None for x in heavy_rows(3000))
    worst = chunked.filter(HEAVY).groupBy("k", "_chunk").agg(F.count("*").alias("n"), F.countDistinct("at").alias("d"))
    # only rows that share one position stay above the limit
    assert worst.filter("n > 100 and d > 1").count() == 0
    assert plan_chunks(df, ["k"], "at", 10_000) is None


def test_rows_at_one_position_are_cut_by_the_next_column(spark):
    rows = [("h", 5, i, i % 7, "x") for i in range(600)] + [("a", i, 1000 + i, 1, "y") for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    cut = cut_heavy(df, ["k"], ["at", "id"], 100)
    assert cut.chunks == ("_chunk0", "_chunk1")
    assert cut.frame.groupBy("k", *cut.chunks).count().filter("count > 100").count() == 0
    whole = r.roll(df, ["k"], ["at", "id"], *ALL).orderBy("id").collect()
    assert r.roll(df, ["k"], ["at", "id"], *ALL, rows_per_task=100).orderBy("id").collect() == whole


def test_lags_across_cuts(spark):
    df = spark.createDataFrame(heavy_rows(2000, 5), SCHEMA)
    whole = r.with_lags(df, ["k"], ["at", "id"], ["v", "tag"], 3).orderBy("id").collect()
    for size in (4, 60):
        cut = r.with_lags(df, ["k"], ["at", "id"], ["v", "tag"], 3, rows_per_task=size)
        assert cut.orderBy("id").collect() == whole


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-20, 20), st.integers(-3, 3)), min_size=1, max_size=40))
def test_rolling_matches_a_plain_loop(spark, data):
    rows = [(k, at, i, v) for i, (k, at, v) in enumerate(data)]
    df = spark.createDataFrame(rows, "k string, at bigint, id bigint, v bigint")
    got = r.roll(
        df, ["k"], ["at", "id"], r.rolling_sum("v", "s"), r.rolling_min_by("v", ["id"], "m"), rows_per_task=3
    ).collect()
    state, want = {}, {}
    for k, at, i, v in sorted(rows, key=lambda x: (x[1], x[2])):
        total, low = state.get(k, (0, None))
        low = (v, i) if low is None or v < low[0] else low
        state[k] = (total + v, low)
        want[i] = (total + v, low[1])
    assert {x["id"]: (x["s"], x["m"]["_r"]["id"]) for x in got} == want


def test_light_keys_need_one_shuffle(spark):
    df = spark.createDataFrame(heavy_rows(100), SCHEMA)
    plan = plan_of(r.roll(df, ["k"], ["at", "id"], *ALL))
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_order_must_be_a_position(spark):
    df = spark.createDataFrame([("a", "b")], "k string, o string")
    with pytest.raises(TypeError):
        r.roll(df, ["k"], ["o"], r.rolling_count("n"))


def test_a_missing_value_is_no_extreme_and_not_in_the_mean(spark):
    df = spark.createDataFrame([("k", 1, 10), ("k", 2, None), ("k", 3, 5)], "k string, seq bigint, v bigint")
    out = r.roll(df, ["k"], ["seq"], r.rolling_min_by("v", ["seq"], "low"), r.rolling_min("v", "m")).orderBy("seq").collect()
    assert [x["low"]["_r"]["seq"] for x in out] == [1, 1, 3] and [x["m"] for x in out] == [10, 10, 5]
    last = final_state(df, ["k"], "v", ["seq"], ["seq"]).first()
    assert (last["n"], last["mean"], last["min_first"]["seq"]) == (3, 7.5, 3)
