"""Streams that wait for the watermark: temporal joins, overdue spans and window joins."""

import random

import pytest
from pyspark.sql import functions as F

from rillstone.operators import joins
from rillstone.streaming import runner, temporal
from tests.conftest import rows_of
from tests.test_streams import drop

RATES = "kind string, id int, currency string, s bigint, rate double"


def _lines(seed, n):
    """Facts and versions in batches; within three seconds of each other they come in any order."""
    rng = random.Random(seed)
    rows = [(rng.choice("FFV"), i, rng.choice(["USD", "EUR", "CHF"]), 10 + i // 2, rng.random()) for i in range(n)]
    rows.sort(key=lambda r: r[3] + rng.random() * 3)
    lines = [",".join(map(str, r)) for r in rows]
    return [lines[i : i + n // 5] for i in range(0, n, n // 5)]


def _sides(rows):
    timed = rows.withColumn("t", F.timestamp_seconds("s"))
    facts = timed.where("kind = 'F'").select("id", "currency", "t")
    return facts, timed.where("kind = 'V'").select("currency", F.col("t").alias("since"), F.col("id").alias("version"), "rate")


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("slots", [1, 3])
def test_out_of_order_versions_over_micro_batches_equal_the_batch_join(spark, tmp_path, inclusive, slots):
    batches = _lines(4, 200)
    drop(f"{tmp_path}/in", batches)
    stream = spark.readStream.schema(RATES).option("maxFilesPerTrigger", 1).csv(f"{tmp_path}/in")
    columns = ["since", "version", "rate"]
    joined = temporal.temporal_join(*_sides(stream), ["currency"], "t", "since", columns, "4 seconds", inclusive, "version", slots)
    answered = runner.to_table(joined, "rates")
    facts, versions = _sides(spark.read.schema(RATES).csv(f"{tmp_path}/in"))
    whole = joins.asof_join(facts, versions, ["currency"], ["t", "id"], ["since", "version"], columns, inclusive).select(answered.columns)
    assert 0 < answered.count() < facts.count()  # some facts wait for the watermark
    got = temporal.with_waiting_facts(answered, facts, versions, ["currency"], "t", "since", columns, 4_000, inclusive, "version")
    assert rows_of(got) == rows_of(whole)
    assert got.where("version IS NULL").count() > 0


def test_a_restart_keeps_versions_and_waiting_facts(spark, tmp_path):
    source, paths = f"{tmp_path}/in", (f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    batches = [["V,1,USD,10,1.5", "F,2,USD,12,0"], ["V,3,USD,11,2.5", "F,4,USD,30,0"], ["V,5,USD,40,9", "F,6,USD,41,0", "F,7,EUR,41,0"], ["F,8,USD,5,0"]]
    for i, batch in enumerate(batches):
        drop(source, [batch], i)
        stream = spark.readStream.schema(RATES).csv(source)
        runner.run(temporal.temporal_join(*_sides(stream), ["currency"], "t", "since", ["rate"]), *paths)
    found = {r["id"]: r["rate"] for r in spark.read.parquet(paths[0]).collect()}
    # 2 waited for a version that came later; 6 and 7 still wait; 8 came too late
    assert found == {2: 2.5, 4: 2.5}


def test_facts_without_key_or_time_know_no_version(spark, tmp_path):
    drop(f"{tmp_path}/in", [["F,1,,10,0", "F,2,USD,,0", "V,3,,9,1", "V,4,USD,,1", "V,5,USD,9,7"]])
    stream = spark.readStream.schema(RATES).csv(f"{tmp_path}/in")
    out = runner.to_table(temporal.temporal_join(*_sides(stream), ["currency"], "t", "since", ["rate"]), "nulls")
    assert rows_of(out.select("id", "rate")) == [(1, None), (2, None)]


RIDES = "ride int, status string, s bigint"


def _overdue(spark, source, max_files=None, retain=50):
    rows = spark.readStream.schema(RIDES).option("maxFilesPerTrigger", max_files or 1000).csv(source).withColumn("t", F.timestamp_seconds(F.col("s") + 1_000))
    status = F.col("status")
    return temporal.overdue(rows, ["ride"], "t", status == "started", status == "completed", 100, "10 seconds", retain)


def test_unfinished_rides_are_reported_across_restarts(spark, tmp_path):
    source, paths = f"{tmp_path}/in", (f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    told = []
    batches = [
        ["1,started,0", "2,started,5", "3,completed,1", "3,started,2", "4,started,0", "4,completed,60"],
        ["5,started,90", "2,completed,95", "9,requested,100"],
        ["1,completed,101", "6,started,130"],  # a second too late
        ["1,started,140", "7,started,160"],
        ["8,started,500"],  # nothing more of 3, 5, 6 and 7
        ["3,started,100"],  # behind the watermark
        ["8,completed,599", "9,started,800"],
    ]
    for i, batch in enumerate(batches):
        drop(source, [batch], i)
        runner.run(_overdue(spark, source), *paths)
        told.append(sorted(r["ride"] for r in spark.read.parquet(paths[0]).collect()))
    assert told == [[], [], [1, 3], [1, 3], [1, 3, 5, 6, 7], [1, 3, 5, 6, 7], [1, 3, 5, 6, 7]]
    row = spark.read.parquet(paths[0]).where("ride = 5").first()
    assert (row["started_at"].timestamp(), row["due_at"].timestamp()) == (1_090, 1_190)


def test_batches_do_not_matter(spark, tmp_path):
    rng = random.Random(3)
    lines = [f"{rng.randint(1, 40) if rng.random() < 0.95 else ''},{rng.choice(['started', 'completed', 'x'])},{i * 5 + rng.randint(0, 9)}" for i in range(300)]
    lines += ["1,started,", "99,x,5000"]
    lines += ["98,started,4999"]
    results = []
    for name, size in (("one", len(lines)), ("many", 60)):
        drop(f"{tmp_path}/{name}", [lines[i : i + size] for i in range(0, len(lines), size)])
        results.append(rows_of(runner.to_table(_overdue(spark, f"{tmp_path}/{name}", 1, 86_400), name)))
    assert results[0] == results[1] and len(results[0]) > 5


def test_window_join_of_streams(spark, tmp_path):
    """Windows that are closed come from the stream, the others from the same input read as a table."""
    drop(f"{tmp_path}/in", [["a,1,L", "a,2,R", "b,3,L", "a,8,R"], ["a,12,L", "a,13,R", "b,14,R"], ["b,22,L", "b,25,R", "a,27,L"]])
    schema = "k string, s bigint, side string"
    aggs = [F.count(F.lit(1)).alias("n")], [F.count(F.lit(1)).alias("m"), F.sum("s").alias("total")]

    def sides(rows, delay=None):
        timed = rows.withColumn("t", F.timestamp_seconds("s"))
        parts = [timed.where(F.col("side") == s) for s in "LR"]
        return [p.withWatermark("t", delay) if delay else p for p in parts]

    join = lambda l, r: joins.window_join(l, r, ["k"], "t", "t", "10 seconds", "5 seconds", *aggs)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).csv(f"{tmp_path}/in")
    closed = runner.to_table(join(*sides(stream, "2 seconds")), "window-join", single_stateful=False)
    rows = spark.read.schema(schema).csv(f"{tmp_path}/in")
    whole = join(*sides(rows))
    assert 0 < closed.count() < whole.count()
    left, right = sides(rows)
    got = runner.with_open_joined(closed, left, right, "t", "t", 2_000, join, "10 seconds")
    assert rows_of(got) == rows_of(whole)


def test_late_rows_are_those_that_windows_drop(spark, tmp_path):
    drop(f"{tmp_path}/in", [["a,1003,1", "a,1012,2"], ["a,1001,4", "a,1011,8", "a,1035,16"], ["a,1029,32", "a,1031,64", "a,,128"]])
    schema = "k string, s bigint, v bigint"
    timed = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).csv(f"{tmp_path}/in").withColumn("t", F.timestamp_seconds("s"))
    tagged = runner.to_table(temporal.tag_late(timed(), "t", "1 second", 10), "late", partition_by=["late"])
    assert {r["v"]: r["late"] for r in tagged.collect()} == {1: False, 2: False, 4: True, 8: False, 16: False, 32: True, 64: False, 128: True}
    assert tagged.columns == ["k", "s", "v", "t", "late"]
    by_row = runner.to_table(temporal.tag_late(timed(), "t", "1 second"), "late")
    assert {r["v"] for r in by_row.where("late").collect()} == {4, 32, 64, 128}
    windows = timed().withWatermark("t", "1 second").groupBy(F.window("t", "10 seconds")).agg(F.sum("v").alias("v"))
    query = runner.start(windows, f"{tmp_path}/out", f"{tmp_path}/c")
    query.awaitTermination()
    assert runner.dropped(query) == 2
    kept = {r["window"]["start"].timestamp(): r["v"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert kept == {1_000: 1, 1_010: 10}


def test_the_clock_closes_what_goes_silent(spark, tmp_path):
    import time

    from rillstone.streaming.stateful import idle_totals

    drop(f"{tmp_path}/in", [["a,1", "a,2", "b,", ",4"]])
    stream = spark.readStream.schema("k string, v int").csv(f"{tmp_path}/in")
    query = runner.start(idle_totals(stream, "k", "v", 2_000), f"{tmp_path}/out", f"{tmp_path}/c", every="200 milliseconds")
    try:
        seen = lambda n: spark.read.schema("k string, n bigint, total bigint").parquet(f"{tmp_path}/out").count() >= n
        for batch, rows in ((None, 3), (["a,8"], 4)):
            if batch:
                drop(f"{tmp_path}/in", [batch], 1)
            end = time.monotonic() + 60
            while not seen(rows) and time.monotonic() < end:
                time.sleep(0.3)
    finally:
        query.stop()
    assert rows_of(spark.read.parquet(f"{tmp_path}/out")) == sorted([("a", 2, 3), ("a", 1, 8), ("b", 1, 0), (None, 1, 4)], key=str)


def test_a_slot_of_many_keys_is_one_group(spark, tmp_path):
    """Two hundred rides in three slots: a state each, and all that are late are told."""
    drop(f"{tmp_path}/in", [[f"{i},started,{i}" for i in range(200)] + [f"{i},completed,{i + 50}" for i in range(0, 200, 3)], ["999,started,900"]])
    rows = spark.readStream.schema(RIDES).option("maxFilesPerTrigger", 1).csv(f"{tmp_path}/in").withColumn("t", F.timestamp_seconds(F.col("s") + 1_000))
    late = temporal.overdue(rows, ["ride"], "t", F.col("status") == "started", F.col("status") == "completed", 100, retain_seconds=10_000, slots=3)
    query = runner.start(late, f"{tmp_path}/out", f"{tmp_path}/c")
    query.awaitTermination()
    assert {r["ride"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {i for i in range(200) if i % 3}
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 3
