"""Sliding windows from panes, user accumulators over them, and several sinks from one read."""

import random

import pytest
from pyspark.sql import functions as F

from rillstone.operators.windows import sliding_by_panes, windowed
from rillstone.streaming import runner, stateful
from tests.conftest import plan_of, rows_of
from tests.test_streams import drop

SCHEMA = "k string, s double, v bigint"


def _aggs():
    return {"n": (F.count(F.lit(1)), F.sum), "total": (F.sum("v"), F.sum), "low": (F.min("v"), F.min)}


def _lines(seed=1, n=200):
    rng = random.Random(seed)
    return [f"{rng.choice('ab')},{1_000 + i * 0.7 + rng.random():.3f},{rng.randint(-9, 9)}" for i in range(n)]


def _timed(rows):
    return rows.withColumn("t", (F.col("s") * 1_000_000).cast("bigint")).withColumn("t", F.timestamp_micros("t"))


@pytest.mark.parametrize("size, slide", [(10, 5), (9, 3), (10, 4), (6, 6)])
def test_panes_give_the_same_windows(spark, size, slide):
    rng = random.Random(size)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.uniform(0, 90)]), rng.choice([None, rng.randint(-9, 9)])) for _ in range(300)]
    df = _timed(spark.createDataFrame(rows, SCHEMA))
    whole = [F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.min("v").alias("low")]
    for keys in ([], ["k"]):
        got = sliding_by_panes(df, "t", size, slide, _aggs(), keys)
        assert rows_of(got) == rows_of(windowed(df, "t", f"{size} seconds", whole, keys, f"{slide} seconds"))


def test_rows_are_aggregated_before_they_are_copied(spark):
    df = _timed(spark.createDataFrame([("a", 1.0, 1)], SCHEMA))
    plan = plan_of(sliding_by_panes(df, "t", 10, 5, _aggs(), ["k"]))
    copied = plan.index("Expand")  # plans are read from the top: what comes below runs earlier
    assert plan.count("Expand") == 1 and "HashAggregate" in plan[copied:] and "Exchange" in plan[copied:]


def _accumulated(df, delay="0 seconds"):
    merge = lambda part, by: part.groupby(by, as_index=False, dropna=False).agg(n=("n", "sum"), most=("most", "max"))
    add = lambda part, by: merge(part.assign(n=1, most=part["v"]), by)
    return stateful.accumulate_windows(df, ["k"], "t", 10, 4, "n bigint, most bigint", add, merge, delay)


def test_user_accumulators_over_sliding_windows(spark, tmp_path):
    lines = _lines()
    drop(f"{tmp_path}/in", [lines[i : i + 40] for i in range(0, 200, 40)])
    static = _timed(spark.read.schema(SCHEMA).csv(f"{tmp_path}/in"))
    whole = windowed(static, "t", "10 seconds", [F.count(F.lit(1)).alias("n"), F.max("v").alias("most")], ["k"], "4 seconds")
    assert rows_of(_accumulated(static)) == rows_of(whole)
    stream = _timed(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).csv(f"{tmp_path}/in"))
    closed = runner.to_table(_accumulated(stream, "2 seconds"), "accumulated")
    assert 50 < closed.count() < whole.count()
    done = runner.with_open_windows(closed, static, "t", 2_000, "window_end", _accumulated, "10 seconds")
    assert rows_of(done) == rows_of(whole)


def test_accumulators_across_a_restart_and_late_rows(spark, tmp_path):
    source, paths = f"{tmp_path}/in", (f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    for i, batch in enumerate([["a,1000.5,1", "a,1003,2", "b,1001,"], ["a,1009,7"], ["a,1000,9", "a,1030,0"], [",1100,0"]]):
        drop(source, [batch], i)
        runner.run(_accumulated(_timed(spark.readStream.schema(SCHEMA).csv(source)), "3 seconds"), *paths)
    got = {(r["k"], r["window_start"].timestamp()): (r["n"], r["most"]) for r in spark.read.parquet(paths[0]).collect()}
    # 1000 came too late for [992, 1002) and [996, 1006), and with its pane for [1000, 1010)
    assert got["a", 992] == (1, 1) and got["a", 996] == (2, 2) and got["b", 992][0] == 1
    assert got["a", 1028] == (1, 0) and max(t for _, t in got) == 1028


def test_several_sinks_from_one_read(spark, tmp_path):
    drop(f"{tmp_path}/in", [["a,1,1", "b,2,2"], ["a,3,3", ",4,4", "a,,5"]])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).csv(f"{tmp_path}/in")
    totals = stateful.fan_out_totals(stream, {"keys": F.col("k"), "even": F.col("s").cast("int") % 2 == 0}, "v")
    out = runner.to_table(totals, "sinks", partition_by=["sink"])
    last = out.groupBy("sink", "key").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total"))
    want = {("keys", "a", 3, 9), ("keys", "b", 1, 2), ("even", "true", 2, 6), ("even", "false", 2, 4)}
    assert {(r["sink"], r["key"], r["n"], r["total"]) for r in last.collect()} == want
    progress = totals.writeStream.format("memory").queryName("one_read").trigger(availableNow=True).start()
    progress.awaitTermination()
    plan = progress._jsq.explainInternal(False)
    assert plan.count("FileScan") + plan.count("BatchScan") + plan.count("StreamingRelation") == 1
