import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rillstone import plans
from rillstone.operators import fraud, joins, parsing, routing
from rillstone.operators.windows import stamp_arrival, streaming_sessions, windowed
from rillstone.session import shared_dir
from rillstone.sources import streams
from rillstone.streaming import runner, stateful
from tests.conftest import TRANSACTIONS, rows_of

BATCHES = [["1000,S1,10", "2000,S1,20", "4000,S2,5"], ["9000,S1,1", "12000,S1,7"], ["3000,S1,99", "30000,S1,0"], ["60000,S1,0"]]
STORE = "ms bigint, store string, sale int"


def drop(folder, batches, first=0):
    """One file per micro-batch, in order of their modification times."""
    os.makedirs(folder, exist_ok=True)
    for i, lines in enumerate(batches, first):
        path = f"{folder}/f{i}.txt"
        with open(path, "w") as f:
            f.write("\n".join(lines) + "\n")
        os.utime(path, (1_700_000_000 + i * 10,) * 2)


@pytest.fixture
def folder(tmp_path):
    drop(f"{tmp_path}/in", BATCHES)
    return f"{tmp_path}/in"


def sales(spark, folder, delay):
    df = streams.delimited_stream(spark, folder, STORE, max_files=1)
    return df.select(F.timestamp_millis("ms").alias("t"), "store", "sale").withWatermark("t", delay)


def sliding(spark, folder):
    return windowed(sales(spark, folder, "1 second"), "t", "10 seconds", [F.sum("sale").alias("total")], ["store"], "5 seconds")


@pytest.mark.parametrize("state", ["rocksdb", "heap"])
@pytest.mark.parametrize("single,want", [(True, 31), (False, 130)])
def test_late_rows_in_sliding_windows(spark, folder, state, single, want):
    out = runner.to_table(sliding(spark, folder), "late", state=state, single_stateful=single)
    zero = out.filter("store = 'S1' AND unix_seconds(window_start) = 0").collect()
    assert [r["total"] for r in zero] == [want]
    assert out.filter("unix_seconds(window_end) > 59").count() == 0


@pytest.mark.parametrize("single,want", [(True, 35), (False, 134)])
def test_late_rows_in_unkeyed_windows(spark, folder, single, want):
    out = windowed(sales(spark, folder, "0 seconds"), "t", "5 seconds", [F.sum("sale").alias("total")])
    table = runner.to_table(out, "all", single_stateful=single)
    assert [r["total"] for r in table.filter("unix_seconds(window_start) = 0").collect()] == [want]


def test_a_restart_continues_without_repeating(spark, folder, tmp_path):
    paths = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    runner.run(sliding(spark, folder), *paths)
    first = spark.read.parquet(paths[0]).count()
    runner.run(sliding(spark, folder), *paths)
    assert spark.read.parquet(paths[0]).count() == first
    drop(folder, [["100000,S1,3"]], first=4)
    runner.run(sliding(spark, folder), *paths)
    again = spark.read.parquet(paths[0])
    assert again.count() > first and again.dropDuplicates(["window_start", "store"]).count() == again.count()


def test_stream_and_batch_agree(spark, tmp_path):
    ordered = [b for b in BATCHES if not b[0].startswith("3000")]
    drop(f"{tmp_path}/in", ordered)
    closed = rows_of(runner.to_table(sliding(spark, f"{tmp_path}/in"), "agree"))
    static = spark.read.schema(STORE).csv(f"{tmp_path}/in").select(F.timestamp_millis("ms").alias("t"), "store", "sale")
    whole = windowed(static, "t", "10 seconds", [F.sum("sale").alias("total")], ["store"], "5 seconds")
    assert closed == rows_of(whole.filter("unix_seconds(window_end) <= 59"))


def test_session_summary_on_timeout(spark, folder):
    out = streaming_sessions(sales(spark, folder, "0 seconds"), "t", "6 seconds", ["store"], [F.count("*").alias("n"), F.sum("sale").alias("total")])
    table = runner.to_table(out, "sessions")
    s1 = table.filter("store = 'S1'").orderBy("session_start").select("n", "total").collect()
    assert [tuple(r) for r in s1] == [(2, 30), (2, 8), (1, 0)]


def test_processing_time_windows(spark, folder):
    stream = stamp_arrival(streams.delimited_stream(spark, folder, STORE))
    out = windowed(stream.withWatermark("arrived_at", "0 seconds"), "arrived_at", "5 seconds", [F.sum("sale").alias("total")], ["store"])
    assert out.isStreaming and stream.schema["arrived_at"].dataType.simpleString() == "timestamp"
    assert runner.to_table(stamp_arrival(streams.line_stream(spark, folder)), "stamped").filter("arrived_at IS NULL").count() == 0


def test_changed_counts_per_micro_batch(spark, folder):
    lines = streams.line_stream(spark, folder, max_files=1).select(F.split("value", ",")[1].alias("store"))
    query = runner.start(lines.groupBy("store").count(), None, f"{shared_dir(spark)}/counts", format="memory", mode="update", name="counts")
    query.awaitTermination()
    assert rows_of(spark.table("counts")) == [("S1", 2), ("S1", 4), ("S1", 6), ("S1", 7), ("S2", 1)]


def test_running_totals(spark, folder):
    rows = streams.delimited_stream(spark, folder, STORE, max_files=1)
    out = runner.to_table(stateful.running_totals(rows, "store", "sale"), "totals")
    assert rows_of(out) == [("S1", 2, 30), ("S1", 4, 38), ("S1", 6, 137), ("S1", 7, 137), ("S2", 1, 5)]


def test_rolling_sum_per_record(spark, folder):
    rows = streams.delimited_stream(spark, folder, STORE, max_files=1)
    out = runner.to_table(stateful.rolling_sums(rows, "store", "sale", ["ms"]), "rolling")
    got = [r["rolling"] for r in out.filter("store = 'S1'").orderBy(F.when(F.col("ms") == 3000, 12500).otherwise(F.col("ms"))).collect()]
    assert got == [10, 30, 31, 38, 137, 137, 137]


def test_rolling_sum_of_a_silent_key_starts_anew(spark, folder):
    drop(folder, [["70000,S2,4", "70000,S1,1"]], first=4)
    out = runner.to_table(stateful.rolling_sums(sales(spark, folder, "0 seconds"), "store", "sale", [], "t", 50_000), "idle")
    last = out.filter("unix_seconds(t) = 70").select("store", "rolling")
    assert rows_of(last) == [("S1", 39), ("S2", 4)]


def test_sequence_alerts_across_micro_batches(spark, tmp_path):
    drop(f"{tmp_path}/in", [
        ["1000,ip1,fail", "2000,ip1,fail", "1000,ip2,fail"], ["3000,ip1,fail", "2000,ip2,ok", "3000,ip2,fail"],
        ["4000,ip1,ok", "5000,ip1,ok", "4000,ip2,fail", "5000,ip2,fail", "900000,ip2,ok"],
    ])
    rows = streams.delimited_stream(spark, f"{tmp_path}/in", "ms bigint, ip string, status string", max_files=1)
    timed = rows.select(F.timestamp_millis("ms").alias("t"), "ip", "status")
    out = runner.to_table(stateful.sequence_alerts(timed, "ip", "t", "status", ["fail", "fail", "fail", "ok"], 300), "alerts")
    assert rows_of(out.select("ip", F.unix_millis("first_time"), F.unix_millis("last_time"))) == [("ip1", 1000, 4000)]


def test_order_shipment_streams(spark, tmp_path):
    drop(f"{tmp_path}/o", [["1,c1,1000", "2,c2,2000", "3,c1,3000"]])
    drop(f"{tmp_path}/s", [["1,5000", "2,1000", "3,90000"]])
    orders = streams.delimited_stream(spark, f"{tmp_path}/o", "id int, c string, ms bigint").select("id", "c", F.timestamp_millis("ms").alias("ot"))
    ships = streams.delimited_stream(spark, f"{tmp_path}/s", "sid int, ms bigint").select("sid", F.timestamp_millis("ms").alias("st"))
    out = joins.interval_join(orders, ships, {"id": "sid"}, "ot", "st", "1 minute", "0 seconds")
    table = runner.to_table(out.select("id", "c", (F.unix_seconds("st") - F.unix_seconds("ot")).alias("delay")), "ships", single_stateful=False)
    assert rows_of(table) == [(1, "c1", 4)]


def test_a_join_that_drops_state_silently_runs_no_batch_for_it(spark, tmp_path):
    drop(f"{tmp_path}/o", [["1,c1,1000", "2,c2,2000", "3,c1,3000"]])
    drop(f"{tmp_path}/s", [["1,5000", "2,1000", "3,90000"]])
    orders = streams.delimited_stream(spark, f"{tmp_path}/o", "id int, c string, ms bigint").select("id", "c", F.timestamp_millis("ms").alias("ot"))
    ships = streams.delimited_stream(spark, f"{tmp_path}/s", "sid int, ms bigint").select("sid", F.timestamp_millis("ms").alias("st"))
    out = joins.interval_join(orders, ships, {"id": "sid"}, "ot", "st", "1 minute", "0 seconds")
    query = runner.start(out.select("id", "c"), f"{tmp_path}/out", f"{tmp_path}/c", counted_state=False, idle_batches=False)
    query.awaitTermination()
    assert rows_of(spark.read.parquet(f"{tmp_path}/out")) == [(1, "c1")]
    assert {p["batchId"] for p in query.recentProgress} == {0}
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"


def test_scoring_a_stream_fans_out_to_tagged_folders(spark, tmp_path, transactions):
    drop(f"{tmp_path}/in", [TRANSACTIONS[:2], ["broken"], TRANSACTIONS[2:]])
    lines = streams.line_stream(spark, f"{tmp_path}/in", max_files=1)
    scored = fraud.score(parsing.parse(lines, "value"))
    tagged = routing.tagged(scored, {"fraud": F.col("is_fraud")}, "normal").select("txn_id", "score", "tag")
    runner.run(tagged, f"{tmp_path}/out", f"{tmp_path}/checkpoint", partition_by=["tag"])
    assert rows_of(spark.read.parquet(f"{tmp_path}/out/tag=fraud")) == [("TXN902", 47), ("TXN904", 47)]
    static = fraud.score(transactions).select("txn_id", "score")
    assert rows_of(spark.read.parquet(f"{tmp_path}/out").select("txn_id", "score")) == rows_of(static)


def test_text_sink_with_small_files(spark, folder, tmp_path):
    runner.run(streams.line_stream(spark, folder, 1), f"{tmp_path}/out", f"{tmp_path}/c", format="text", max_rows_per_file=1)
    assert spark.read.text(f"{tmp_path}/out").count() == sum(len(b) for b in BATCHES)
    assert len(spark.read.text(f"{tmp_path}/out").inputFiles()) == sum(len(b) for b in BATCHES)


def test_trigger_interval(spark, folder, tmp_path):
    query = runner.start(streams.line_stream(spark, folder), f"{tmp_path}/out", f"{tmp_path}/c", format="text", every="1 second")
    query.processAllAvailable()
    assert query.isActive
    query.stop()
    assert spark.read.text(f"{tmp_path}/out").count() == 8


def test_rate_events(spark):
    df = streams.key_value_stream(spark, 50, 2, ["A", "B", "C"])
    query = runner.start(df, None, f"{shared_dir(spark)}/rate", format="memory", every="1 second", name="ticks")
    query.awaitTermination(8)
    query.stop()
    got = spark.table("ticks")
    assert {r["key"] for r in got.collect()} == {"A", "B", "C"} and got.filter("value < 0 OR value > 99").count() == 0


def test_user_defined_source(spark):
    class LettersReader(DataSourceReader):
        def __init__(self, per_key):
            self.per_key = per_key

        def partitions(self):
            return [InputPartition(k) for k in "ABC"]

        def read(self, partition):
            for i in range(self.per_key):
                yield (partition.value, i)

    class Letters(DataSource):
        @classmethod
        def name(cls):
            return "letters"

        def schema(self):
            return "key string, value int"

        def reader(self, schema):
            return LettersReader(int(self.options.get("per_key", "3")))

    df = streams.custom(spark, Letters, per_key="4")
    assert rows_of(df.groupBy("key").agg(F.sum("value").alias("s"))) == [("A", 6), ("B", 6), ("C", 6)]


def test_topic_adapters(spark):
    options = streams.topic_options("host:9092", "simple-transactions", "g")
    assert options == {
        "kafka.bootstrap.servers": "host:9092", "subscribe": "simple-transactions", "startingOffsets": "earliest",
        "kafka.group.id": "g",
    }
    raw = spark.createDataFrame([(bytearray(t.encode()),) for t in TRANSACTIONS], "value binary")
    assert parsing.parse(streams.message_values(raw), "value").count() == 4


def test_interval_join_bounds(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    left = spark.createDataFrame([(1, t(10))], "id int, a timestamp")
    right = spark.createDataFrame([(1, t(9)), (1, t(10)), (1, t(15)), (1, t(16))], "rid int, b timestamp")
    out = joins.interval_join(left, right, {"id": "rid"}, "a", "b", "5 seconds", "0 seconds")
    assert [r["b"] for r in out.orderBy("b").collect()] == [t(10), t(15)]


def test_running_totals_keep_large_numbers_beside_nulls(spark, tmp_path):
    drop(f"{tmp_path}/in", [["a,9007199254740993", "a,"]])
    rows = streams.delimited_stream(spark, f"{tmp_path}/in", "k string, v bigint")
    assert rows_of(runner.to_table(stateful.running_totals(rows, "k", "v"), "large")) == [("a", 2, 9007199254740993)]


def test_rolling_sums_follow_their_order_and_take_nulls(spark, tmp_path):
    drop(f"{tmp_path}/in", [["a,3,5", "a,1,10", "a,2,"], ["a,5,", "a,4,9007199254740993"]])
    rows = streams.delimited_stream(spark, f"{tmp_path}/in", "k string, at bigint, v bigint", max_files=1)
    out = runner.to_table(stateful.rolling_sums(rows, "k", "v", ["at"], order=["at"]), "ordered").orderBy("at")
    big = 9007199254740993
    assert [(r["value"], r["rolling"]) for r in out.collect()] == [(10, 10), (None, 10), (5, 15), (big, big + 15), (None, big + 15)]


def test_a_late_event_raises_no_false_alert(spark, tmp_path):
    drop(f"{tmp_path}/in", [["1000000,ip,fail", "1001000,ip,fail", "1002000,ip,fail"], ["10000,ip,ok", "1003000,ip,fail"], ["1004000,ip,ok"]])
    rows = streams.delimited_stream(spark, f"{tmp_path}/in", "ms bigint, ip string, status string", max_files=1)
    timed = rows.select(F.timestamp_millis("ms").alias("t"), "ip", "status")
    out = runner.to_table(stateful.sequence_alerts(timed, "ip", "t", "status", ["fail", "fail", "fail", "ok"], 300), "late_alerts")
    assert rows_of(out.select(F.unix_seconds("first_time"), F.unix_seconds("last_time"))) == [(1001, 1004)]


def test_windows_open_at_the_end_of_the_input_are_added(spark, tmp_path):
    drop(f"{tmp_path}/in", [b for b in BATCHES if not b[0].startswith("3000")])
    static = spark.read.schema(STORE).csv(f"{tmp_path}/in").select(F.timestamp_millis("ms").alias("t"), "store", "sale")
    whole = lambda rows: windowed(rows, "t", "10 seconds", [F.sum("sale").alias("total")], ["store"], "5 seconds")
    closed = runner.to_table(sliding(spark, f"{tmp_path}/in"), "closed")
    done = runner.with_open_windows(closed, static, "t", 1000, "window_end", whole, "10 seconds")
    assert rows_of(done) == rows_of(whole(static)) and done.count() > closed.count()


HOT = 60


@pytest.fixture
def hot_folder(spark, tmp_path):
    """Events of which one user has most, many of them close together or at one time, and some without a time or a value."""
    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
    kinds = ["error", "error", "error", "purchase", "view"]
    rows = [(i, day(i // 4 if i < 40 else 20 * i), 7, kinds[i % 5], None if i and i % 9 == 0 else i / 4) for i in range(HOT)]
    rows += [(100 + i, day(5 * i), 1 + i % 3, kinds[(i // 3) % 5], 1.0) for i in range(30)]
    rows += [(200 + i, day(700), 7, kinds[i % 4], 2.0) for i in range(20)]  # one time
    rows += [(300 + i, None, 7 if i % 2 else 1, "error", 0.5) for i in range(8)] + [(400, day(1), None, "view", 3.0), (401, day(2), None, "view", 3.0)]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
    spark.createDataFrame(rows, schema).withColumn("props", F.lit("{}")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def fed(monkeypatch):
    """Most rows of a user, or of a range of a user, that each stream of the query is given."""
    found, slices = [], plans.streams._by_slices

    def counted(spark, rows, *args):
        by = [c for c in ("user_id", "_chunk0", "_chunk1") if c in rows.columns]
        found.append(rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0)
        return slices(spark, rows, *args)

    monkeypatch.setattr(plans.streams, "_by_slices", counted)
    return found


def sql_rows(name, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return sorted(con.execute(plans.ORACLES[name]).fetchall(), key=str)


@pytest.mark.parametrize("limit", [None, 15, 1])
def test_stream_rolling_sum_of_a_hot_user_is_that_of_the_sql_and_no_task_gets_all_its_rows(spark, hot_folder, monkeypatch, limit):
    found = fed(monkeypatch)
    if limit:
        spark.conf.set("spark.rillstone.rowsPerTask", str(limit))
    try:
        got = rows_of(plans.QUERIES["stream_rolling_sum"](spark, hot_folder).select("event_id", "user_id", "total"))
    finally:
        spark.conf.unset("spark.rillstone.rowsPerTask")
    assert got == sql_rows("stream_rolling_sum", hot_folder)
    assert len(found) == (2 if limit else 1) and (not limit or max(found) <= limit)


@pytest.mark.parametrize("limit", [None, 15, 1])
def test_stream_pattern_of_a_hot_user_is_that_of_the_sql_and_no_task_gets_all_its_rows(spark, hot_folder, monkeypatch, limit):
    found = fed(monkeypatch)
    if limit:
        spark.conf.set("spark.rillstone.rowsPerTask", str(limit))
    try:
        got = rows_of(plans.QUERIES["stream_pattern"](spark, hot_folder).select("user_id", "first_time", "last_time"))
    finally:
        spark.conf.unset("spark.rillstone.rowsPerTask")
    want = sql_rows("stream_pattern", hot_folder)
    assert got == want and len(want) > 10
    assert not limit or max(found) <= limit + 3  # with copies of three events


def test_sequence_alerts_of_many_keys_in_one_slot(spark, tmp_path):
    """Keys share a group and its state, and never each other's events; a null key is a key."""
    steps = ["fail", "fail", "ok"]
    events = [(i * 10 + s, f"ip{i % 50}" if i % 50 else "", step) for i in range(50) for s, step in enumerate(steps)]
    drop(f"{tmp_path}/in", [[f"{ms},{ip},{step}" for ms, ip, step in events if step == part] for part in ("fail", "ok")])
    rows = streams.delimited_stream(spark, f"{tmp_path}/in", "ms bigint, ip string, status string", max_files=1)
    timed = rows.select(F.timestamp_millis("ms").alias("t"), "ip", "status")
    query = runner.start(stateful.sequence_alerts(timed, "ip", "t", "status", steps, 300, delay="1 hour", slots=2), f"{tmp_path}/out", f"{tmp_path}/c")
    query.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((q["ip"] or "") for q in got.collect()) == sorted(f"ip{i}" if i else "" for i in range(50))
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
