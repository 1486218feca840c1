"""The replayable stream source and the writer with an encoder."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rillstone.encoded import pairs_line, write_encoded
from rillstone.sources.replay import Range, ReplayReader, replay
from rillstone.streaming import runner
from tests.conftest import rows_of


@pytest.fixture
def numbers(spark, tmp_path):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 7).alias("k"), F.concat(F.lit("t"), "id").alias("t"))
    df.unionByName(spark.createDataFrame([(None, 1, "x")], "id bigint, k bigint, t string")).repartition(3).write.parquet(f"{tmp_path}/numbers")
    return f"{tmp_path}/numbers"


def test_every_row_once_over_micro_batches(spark, numbers, tmp_path):
    query = runner.start(replay(spark, numbers, "id", ["id", "t"], batches=5, tasks=3), f"{tmp_path}/out", f"{tmp_path}/c", every="0 seconds")
    try:
        query.processAllAvailable()
        read = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    finally:
        query.stop()
    assert read == [20] * 5
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.columns == ["id", "t"] and rows_of(out) == sorted(((i, f"t{i}") for i in range(100)), key=str)


def test_a_restart_goes_on_where_the_log_ends(spark, numbers, tmp_path):
    paths = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    for _ in range(2):
        query = runner.start(replay(spark, numbers, "id", ["id", "k"], batches=10), *paths, every="0 seconds")
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    out = spark.read.parquet(paths[0])
    assert out.count() == 100 and out.distinct().count() == 100


def test_ranges_repeat_the_same_rows(numbers):
    reader = ReplayReader(numbers, "id", ["id"], 0, 100, 30, 4)
    assert [reader.initialOffset(), reader.latestOffset(), reader.latestOffset()] == [{"next": 0}, {"next": 30}, {"next": 60}]
    parts = reader.partitions({"next": 30}, {"next": 60})
    assert [(p.low, p.high) for p in parts] == [(30, 38), (38, 46), (46, 54), (54, 60)]
    again = ReplayReader(numbers, "id", ["id"], 0, 100, 30, 4)
    assert again.partitions({"next": 30}, {"next": 60})[0].low == 30 and again.latestOffset() == {"next": 90}
    read = lambda r: sorted(v for b in r.read(Range(38, 46)) for v in b.column("id").to_pylist())
    assert read(reader) == read(again) == list(range(38, 46))


def test_an_empty_table_replays_nothing(spark, numbers, tmp_path):
    spark.read.parquet(numbers).limit(0).write.parquet(f"{tmp_path}/none")
    query = runner.start(replay(spark, f"{tmp_path}/none", "id", ["id"]), f"{tmp_path}/out", f"{tmp_path}/c", every="0 seconds")
    query.processAllAvailable()
    query.stop()
    assert not query.exception()


def test_rows_are_encoded_and_published(spark, tmp_path):
    rows = [(1, "a;b", None), (2, "line\nend\\", 0.5), (3, None, 1.0)]
    df = spark.createDataFrame(rows, "id int, t string, x double").repartition(2, "id")
    write_encoded(df, f"{tmp_path}/out", "rillstone.encoded.pairs_line")
    lines = sorted(r[0] for r in spark.read.text(f"{tmp_path}/out").collect())
    assert lines == ["id=1;t=a\\;b;x=", "id=2;t=line\\nend\\\\;x=0.5", "id=3;t=;x=1.0"]
    assert not os.path.exists(f"{tmp_path}/out/_staging")
    write_encoded(df.where("id = 1"), f"{tmp_path}/out", "rillstone.encoded.pairs_line")
    assert spark.read.text(f"{tmp_path}/out").count() == 1
    with pytest.raises(Exception, match="holds files already"):
        write_encoded(df, f"{tmp_path}/out", "rillstone.encoded.pairs_line", overwrite=False)


def failing(row):
    if row["id"] == 77:
        raise ValueError("no form for 77")
    return pairs_line(row)


def test_a_failed_task_leaves_no_partial_output(spark, tmp_path):
    out = f"{tmp_path}/out"
    write_encoded(spark.range(5), out, "rillstone.encoded.pairs_line")
    before = sorted(os.listdir(out))
    with pytest.raises(PySparkException):
        write_encoded(spark.range(100).repartition(6), out, "tests.test_custom_io.failing")
    assert sorted(os.listdir(out)) == before
    with pytest.raises(PySparkException):
        write_encoded(spark.range(100).repartition(6), f"{tmp_path}/new", "tests.test_custom_io.failing")
    assert not [f for _, _, files in os.walk(f"{tmp_path}/new") for f in files]
