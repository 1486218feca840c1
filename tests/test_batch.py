import datetime as dt
import glob
import math
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rillstone import sinks
from rillstone.functions.text import fields, trim_controls, whole_number
from rillstone.operators import aggregates, fraud, iterate, parsing, patterns, routing, windows
from rillstone.sources import files
from tests.conftest import PROFITS, TRANSACTIONS, plan_of, rows_of

KAFKA_TXN = [  # amount, currency, source, destination -> score in hundredths
    (1500, "USD", "NY", "NY", -10), (35000, "EUR", "Paris", "Rome", 25), (900, "GBP", "A", "B", 10),
    (45, "USD", "A", "A", 0), (45, "USD", "A", "B", 20), (120500, "USD", "A", "B", 45), (120000, "USD", "A", "B", 57), (150000, "USD", "A", "B", 57),
    (60001, "USD", "A", "B", 35), (52000, "CHF", "A", "B", 55), (100000, "INR", "A", "A", 27), (150000, "XAU", "A", "B", 65),
]


def test_word_count_trims_and_filters(spark):
    words = ["earth", "element", "element ", "\telement", "engine", "Engine", " earth"]
    df = spark.createDataFrame([(w,) for w in words], "value string")
    assert rows_of(aggregates.word_count(df, "value")) == [("Engine", 1), ("earth", 2), ("element", 3), ("engine", 1)]
    assert rows_of(aggregates.word_count(df, "value", prefix="e")) == [("earth", 1), ("element", 2), ("engine", 1)]
    assert ("element ", 1) in rows_of(aggregates.word_count(df, "value", trim=False))
    assert aggregates.word_count(df, "value", prefix="N").count() == 0


def test_text_helpers(spark):
    df = spark.createDataFrame([("a,b,,,,",), (",a,,b",), ("",), (" \x01x y\n",)], "s string")
    assert [r[0] for r in df.select(F.size(fields(F.col("s")))).collect()][:3] == [2, 4, 1]
    assert df.select(trim_controls(F.col("s"))).collect()[3][0] == "x y"
    numbers = ["12", "-5", "+7", " 12", "12.0", "1e3", "2147483648", "", "x", "12\n"]
    got = spark.createDataFrame([(n,) for n in numbers], "s string").select(whole_number(F.col("s"))).collect()
    assert [r[0] for r in got] == [12, -5, 7, None, None, None, None, None, None, None]


def test_parse_and_rejects_split_the_lines(spark):
    bad = [
        ("TXN1,5,USD,A,B", "column count"),
        ("TXN1,5,USD,A,B,1,2", "column count"),
        ("TXN1,5,USD,A,,", "column count"),
        ("TXN1,x,USD,A,B,1", "bad amount"),
        ("TXN1,5,USD,A,B,1.5", "bad ts"),
        ("[Ljava.lang.String;@1,[Ljava.lang.String;@1,[Ljava.lang.String;@1,a,b,c", "bad amount"),
        ("", "column count"),
        (None, "column count"),
    ]
    df = spark.createDataFrame([(t,) for t in TRANSACTIONS] + [(b,) for b, _ in bad], "line string")
    assert parsing.parse(df, "line").first() == ("TXN901", 33500, "USD", "Oslo", "Bergen", 1700000100123)
    assert parsing.parse(df, "line").count() == 4
    assert rows_of(parsing.rejects(df, "line")) == sorted(bad, key=str)


def test_strict_pick_fails_on_bad_numbers(spark):
    df = spark.createDataFrame([("a,b",)], "line string")
    with pytest.raises(PySparkException):
        parsing.pick(df, "line", {"n": (1, "int")}).collect()


def test_table_queries(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("\n".join(TRANSACTIONS))
    ddl = "txn_id STRING, amount INT, currency STRING, source STRING, destination STRING, ts BIGINT"
    df = files.csv_table(spark, "transactions", ddl, str(path))
    high = df.filter(F.col("amount") > 50000).select("txn_id", "amount", "currency")
    assert rows_of(high) == [("TXN902", 64000, "INR"), ("TXN904", 87000, "EUR")]
    mean = df.groupBy("currency").agg(aggregates.truncated_mean("amount").alias("avg_amount"))
    assert rows_of(mean) == [("EUR", 87000), ("INR", 64000), ("USD", 17900)]
    assert rows_of(spark.sql("SELECT currency FROM transactions WHERE amount > 80000")) == [("EUR",)]
    pair = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    assert pair.agg(aggregates.truncated_mean("v")).first()[0] == 1


def test_scores_and_flags(spark, transactions):
    rows = [(f"T{i}", a, c, s, d, 0) for i, (a, c, s, d, _) in enumerate(KAFKA_TXN)]
    df = spark.createDataFrame(rows, "txn_id string, amount int, currency string, source string, destination string, ts bigint")
    out = fraud.score(df).orderBy(F.substring("txn_id", 2, 9).cast("int")).collect()
    assert [r["score"] for r in out] == [x[-1] for x in KAFKA_TXN]
    assert [r["is_fraud"] for r in out] == [x[-1] > 35 for x in KAFKA_TXN]
    assert out[9]["reasons"] == ["HIGH_AMOUNT($52000)", "CROSS_LOCATION(A->B)", "UNUSUAL_CURRENCY(CHF)", "ROUND_AMOUNT_PATTERN"]
    assert [(r["txn_id"], r["score"]) for r in fraud.score(transactions).orderBy("txn_id").collect()] == [
        ("TXN901", 25), ("TXN902", 47), ("TXN903", -10), ("TXN904", 47),
    ]


def test_report_lines(transactions):
    scored = fraud.score(transactions)
    alert = fraud.flagged(scored).filter("txn_id = 'TXN902'").select(fraud.alert_text()).first()[0]
    assert alert == (
        "🚨 FRAUD DETECTED\n  TxnID: TXN902 | Amount: $64000 INR | Score: 0.47\n  Route: Pune → Nagpur\n"
        "  Reasons: HIGH_AMOUNT($64000) | CROSS_LOCATION(Pune->Nagpur) | ROUND_AMOUNT_PATTERN\n  Time: 2023-11-14 22:16:40\n"
    )
    line = fraud.normal(scored).filter("txn_id = 'TXN903'").select(fraud.normal_text()).first()[0]
    assert line == "✓ NORMAL | TxnID: TXN903 | $2300 USD | Oslo → Oslo | Score: -0.10 | Time: 2023-11-14 22:18:20"


def test_scoring_is_one_projection(transactions):
    plan = plan_of(fraud.flagged(fraud.score(transactions)))
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("rows_per_task", [10_000, 25])
def test_velocity_against_a_search(spark, rows_per_task):
    rng = random.Random(2)
    rows = [(rng.choice("aaab"), dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=rng.randrange(400_000))) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, t timestamp")
    got = fraud.velocity(df, ["k"], "t", 20, 8, rows_per_task)
    want = set()
    epoch = [(k, int(t.replace(tzinfo=dt.timezone.utc).timestamp())) for k, t in rows]
    for k, s in epoch:
        n = sum(1 for k2, s2 in epoch if k2 == k and s - 20 <= s2 <= s)
        if n >= 8:
            want.add((k, s, n))
    assert rows_of(got) == sorted(want, key=str)


def test_routing(spark):
    df = spark.range(1, 11).withColumnRenamed("id", "v")
    tagged = routing.parity(df, "v")
    assert [r[0] for r in routing.route(tagged, "even").collect()] == [2, 4, 6, 8, 10]
    assert [r[0] for r in routing.route(tagged, "odd").collect()] == [1, 3, 5, 7, 9]
    speeds = spark.createDataFrame([(60.0,), (60.5,), (61.0,), (80.0,), (80.1,)], "v double")
    assert [r["tag"] for r in routing.speed_classes(speeds, "v").collect()] == ["normal", "minor", "minor", "minor", "major"]


def test_iteration(spark):
    one = spark.range(1)
    assert iterate.count_up(one, F.lit(0), 10, 20).select("state.value", "state.rounds").first() == (10, 10)
    steps = iterate.steps_to(files.sequence(spark, 0, 11), F.col("value"), 10, 12)
    assert rows_of(steps) == sorted([(n, 10, 10 - n) for n in range(11)], key=str)
    out = iterate.converge(files.sequence(spark, 0, 100), F.col("value"), 0.9, 5.0, 0.1, 10).collect()
    for row in out:
        x, rounds, done = float(row["value"]), 0, False
        while not done and rounds < 10:
            y = x * 0.9 + 5.0
            x, rounds, done = y, rounds + 1, abs(y - x) < 0.1
        assert (row["state"]["value"], row["state"]["rounds"], row["state"]["done"]) == (x, rounds, done)


def test_iteration_over_frames(spark):
    df = files.sequence(spark, 0, 9).withColumn("n", F.lit(0))
    total = lambda d: d.select((F.col("value") + 4).alias("value"), (F.col("n") + 1).alias("n"))
    finished, left = iterate.iterate_frame(df, total, F.col("value") >= 10, 2)
    assert rows_of(finished) == sorted([(v + 4, 1) if v >= 6 else (v + 8, 2) for v in range(2, 10)], key=str)
    assert rows_of(left) == [(8, 2), (9, 2)]


def clock(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


@pytest.mark.parametrize("rows_per_task", [10_000, 2])
def test_strict_sequences(spark, rows_per_task):
    events = [
        ("a", 0, "fail"), ("a", 1, "fail"), ("a", 2, "fail"), ("a", 3, "ok"),     # match
        ("b", 0, "fail"), ("b", 1, "fail"), ("b", 2, "view"), ("b", 3, "fail"), ("b", 4, "ok"),  # interrupted
        ("c", 0, "fail"), ("c", 1, "fail"), ("c", 2, "fail"), ("c", 6, "ok"),     # too slow
        ("d", 0, "fail"), ("d", 1, "fail"), ("d", 2, "fail"), ("d", 3, "fail"), ("d", 6, "ok"),  # last three count
    ]
    df = spark.createDataFrame([(i, k, clock(m), s) for i, (k, m, s) in enumerate(events)], "id int, ip string, t timestamp, s string")
    out = patterns.strict_sequence(df, ["ip"], ["t", "id"], "s", ["fail", "fail", "fail", "ok"], 300, rows_per_task)
    assert [(r["ip"], r["first_time"]) for r in out.orderBy("ip").collect()] == [("a", clock(0)), ("d", clock(1))]


def test_ride_life_cycle_and_metrics(spark):
    stages = ["requested", "matched", "started", "completed"]
    log = [
        *[("r1", s, clock(m)) for s, m in zip(stages, (0, 2, 5, 20))],
        *[("r2", s, clock(m)) for s, m in zip(stages[:2], (1, 4))],
        ("r3", "requested", clock(3)), ("r3", "started", clock(4)),
        *[("r4", s, clock(m)) for s, m in zip(stages, (10, 15, 16, 200))],
    ]
    meta = {"r1": ("Rome", "d1"), "r2": ("Rome", "d2"), "r3": ("Oslo", "d1"), "r4": ("Oslo", "d1")}
    df = spark.createDataFrame([(r, s, t, *meta[r]) for r, s, t in log], "ride string, status string, t timestamp, city string, driver string")
    rides = patterns.life_cycle(df, ["ride"], "status", "t", stages, [F.first("city").alias("city"), F.first("driver").alias("driver")])
    assert {r["ride"]: r["in_order"] for r in rides.collect()} == {"r1": True, "r2": True, "r3": False, "r4": True}
    assert [r["ride"] for r in patterns.too_long(rides, "started_at", "completed_at", 3600).collect()] == ["r4"]
    assert rows_of(patterns.mean_wait(rides, ["city"], "requested_at", "matched_at")) == [("Oslo", 1, 300, 300.0), ("Rome", 2, 300, 150.0)]
    busy = {r["driver"]: r["busy_seconds"] for r in patterns.utilisation(rides, "driver", "started_at", "completed_at", 86400).collect()}
    assert busy == {"d1": 900 + 184 * 60, "d2": None}
    assert patterns.peak_hours(df, "t").orderBy("rank").first()["hour"] == 0


def test_reports(spark):
    df = spark.createDataFrame([("a", "x", 3), ("a", "x", 2), ("a", "y", 1), ("b", "y", 9), ("b", "x", 1)], "g string, i string, v bigint")
    assert rows_of(aggregates.top_groups(df, ["g"], ["i"], 1)) == [("a", "x", 2, 1), ("b", "x", 1, 1)]
    assert tuple(aggregates.most_frequent(df, "i").first()) == ("x", 3)
    assert rows_of(aggregates.ratio_report(df, ["g"], "v", "rows", "v")) == [("a", 6, 3, 2.0), ("b", 10, 2, 5.0)]
    assert rows_of(aggregates.frequent(df, ["g"], 2)) == [("a", 3)]
    rates = aggregates.conversion(df, ["g"], "i", "x", "y").collect()
    assert sorted((r["g"], r["views"], r["purchases"], r["rate"]) for r in rates) == [("a", 2, 1, 0.5), ("b", 1, 1, 1.0)]
    assert aggregates.conversion(df, ["g"], "i", "z", "y").first()["rate"] is None


def test_user_defined_accumulator(spark):
    """Extremes of a ratio, held as (key, low, high); tasks flush when they hold too many keys."""
    rows = [(f"k{i % 5}", float(i * 37 % 101), float(i % 7 + 1)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, a double, b double").repartition(4)

    def merge(pdf):
        return pdf.groupby("k", as_index=False).agg(low=("low", "min"), high=("high", "max"))

    def add(pdf):
        ratio = pdf["a"] / pdf["b"]
        return merge(pdf.assign(low=ratio, high=ratio)[["k", "low", "high"]])

    want = sorted((k, min(a / b for x, a, b in rows if x == k), max(a / b for x, a, b in rows if x == k)) for k in {r[0] for r in rows})
    for flush in (200_000, 1):
        out = aggregates.accumulate(df, ["k"], "k string, low double, high double", add, merge, flush)
        assert rows_of(out) == want


def test_top_groups_rank_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") % 50).alias("i"))
    assert "WindowGroupLimit" in plan_of(aggregates.top_groups(df, ["g"], ["i"], 5))


def test_sessions_match_the_built_in_windows(spark):
    rng = random.Random(9)
    rows = [(rng.choice("aab"), clock(0) + dt.timedelta(seconds=rng.randrange(40_000)), rng.randrange(9)) for _ in range(400)]
    rows += [("gap", clock(0), 1), ("gap", clock(1), 1), ("gap", clock(2) + dt.timedelta(microseconds=1), 1)]
    df = spark.createDataFrame(rows, "k string, t timestamp, v bigint")
    own = windows.sessions(df, "t", 60, ["k"], ["v"]).select("k", "session_start", "session_end", "events", "v")
    ref = windows.streaming_sessions(df, "t", "60 seconds", ["k"], [F.count("*").alias("events"), F.sum("v").alias("v")])
    assert rows_of(own) == rows_of(ref.select("k", "session_start", "session_end", "events", "v"))
    assert [r["events"] for r in own.filter("k = 'gap'").orderBy("session_start").collect()] == [2, 1]


def test_windows_of_the_original_sizes(spark):
    rows = [(1000, "S1", 10), (2000, "S1", 20), (4000, "S2", 5), (9000, "S1", 1), (12000, "S1", 7)]
    df = spark.createDataFrame(rows, "ms bigint, store string, sale int").select(F.timestamp_millis("ms").alias("t"), "store", "sale")
    slide = windows.windowed(df, "t", "10 seconds", [F.sum("sale").alias("total")], ["store"], "5 seconds")
    lines = slide.filter("store = 'S1'").orderBy("window_start").select(windows.window_line("Store", "store", "Total Sales", "total")).collect()
    assert [r[0] for r in lines] == [
        "Store: S1 | Total Sales: 30 | Window: [1969-12-31 23:59:55 → 1970-01-01 00:00:05]",
        "Store: S1 | Total Sales: 31 | Window: [1970-01-01 00:00:00 → 1970-01-01 00:00:10]",
        "Store: S1 | Total Sales: 8 | Window: [1970-01-01 00:00:05 → 1970-01-01 00:00:15]",
        "Store: S1 | Total Sales: 7 | Window: [1970-01-01 00:00:10 → 1970-01-01 00:00:20]",
    ]
    every = windows.windowed(df, "t", "5 seconds", [F.sum("sale").alias("total")]).orderBy("window_start")
    assert [r[0] for r in every.select(windows.total_line("window_end", "total")).collect()] == [
        "1970-01-01 00:00:05.000,35", "1970-01-01 00:00:10.000,1", "1970-01-01 00:00:15.000,7",
    ]
    counted = windows.windowed(df, "t", "10 seconds", [F.count("*").alias("n"), F.sum("sale").alias("total")], ["store"])
    line = counted.filter("store = 'S2'").select(windows.count_sum_line("store", "n", "total")).first()[0]
    assert line == "WindowStart=1970-01-01 00:00:00, Key=S2, Count=1, Sum=5"


def read(path):
    return sorted(line for f in glob.glob(f"{path}/**/part-*", recursive=True) for line in open(f).read().splitlines())


def test_sinks(spark, tmp_path, capsys):
    df = spark.createDataFrame([(1, "John", "DC"), (3, "Lui", "NULL")], "id int, name string, state string")
    for _ in range(2):  # a second run replaces the first
        sinks.write_delimited(df, f"{tmp_path}/csv", " ")
    assert read(f"{tmp_path}/csv") == ["1 John DC", "3 Lui NULL"]
    sinks.write_text(df, f"{tmp_path}/text", max_rows_per_file=1)
    assert read(f"{tmp_path}/text") == ["(1,John,DC)", "(3,Lui,NULL)"]
    sinks.write_partitioned(df, f"{tmp_path}/parts", ["state"])
    assert spark.read.parquet(f"{tmp_path}/parts/state=DC").select("id").collect() == [(1,)]
    sinks.show(df.orderBy("id"), 20, "Even")
    assert "Even> (1,John,DC)" in capsys.readouterr().out
    sinks.show(df, 20)
    assert "John" in capsys.readouterr().out
    out = sinks.messages(df, "id", F.concat_ws(",", "id", "name"))
    assert rows_of(out) == [("1", "1,John"), ("3", "3,Lui")]
    assert sinks.message_options("h:1", "t")["kafka.acks"] == "all"


def test_sources(spark, tmp_path):
    path = tmp_path / "people"
    path.write_text("1,John\n2,Albert")
    assert rows_of(files.delimited(spark, str(path), "id int, name string")) == [(1, "John"), (2, "Albert")]
    assert files.lines(spark, str(path)).count() == 2
    assert [r[0] for r in files.sequence(spark, 0, 5).collect()] == [0, 1, 2, 3, 4, 5]
    assert files.rows(spark, [(1,)], "v int").count() == 1
    path.write_text("1,John\nx,Albert")
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.delimited(spark, str(path), "id int, name string").collect()
    sensors = ['{"sensorId": "s1", "temperature": 120.5, "timestamp": 1}', '{"sensorId": "s2", "temperature": 20}', "broken"]
    df = files.json_fields(spark.createDataFrame([(s,) for s in sensors], "value string"), "value", "sensorId string, temperature double, timestamp bigint")
    assert rows_of(df.filter("temperature > 100 OR temperature < -20")) == [("s1", 120.5, 1)]


def test_lines_of_profits(profits):
    assert profits.count() == len(PROFITS) and profits.schema["profit"].dataType.simpleString() == "int"
    assert math.isclose(profits.agg(F.avg("profit")).first()[0], 298 / 12)


def test_a_declared_table_refuses_malformed_rows(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("a,1\nb,x\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.csv_table(spark, "bad_rows", "name STRING, n INT", str(path)).collect()


def test_printing_takes_a_number_of_rows(spark, capsys):
    sinks.show(spark.range(30), 30, "row")
    assert capsys.readouterr().out.count("row>") == 30


def test_status_transitions(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    log = [("r1", "matched", t(1)), ("r1", "started", t(2)), ("r1", "matched", t(3)), ("r2", "requested", t(1)), ("r2", "requested", t(2))]
    df = spark.createDataFrame(log, "ride string, status string, t timestamp")
    out = patterns.transitions(df, ["ride"], ["t"], "status", ["requested", "matched", "started"]).orderBy("ride", "t")
    assert [(x["from_status"], x["status"], x["forward"]) for x in out.collect()] == [
        (None, "matched", False), ("matched", "started", True), ("started", "matched", False),
        (None, "requested", True), ("requested", "requested", False),
    ]


def test_place_changes_and_high_amounts(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    log = [("u", t(0), "A", 9), ("u", t(50), "A", 90), ("u", t(60), "B", 95), ("u", t(200), "A", 99), ("v", t(201), "B", 99), ("v", t(202), None, 99)]
    df = spark.createDataFrame(log, "u string, t timestamp, place string, amount int")
    assert [(x["t"], x["from_place"]) for x in fraud.place_changes(df, ["u"], ["t"], "place", 60).collect()] == [(t(60), "A")]
    high = fraud.high_velocity(df, ["u"], "t", "amount", 80, 60, 2)
    assert {(x["u"], x["n_recent"]) for x in high.collect()} == {("u", 2), ("v", 2)}


def test_recursion_is_bounded_and_leaves_the_settings(spark):
    from rillstone.operators.iterate import recurse

    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8)], "a int, b int")
    step = "SELECT l.a, k.b FROM loop l JOIN {links} k ON l.b = k.a"
    got = recurse(spark, "a, b", "SELECT a, b FROM {links}", step, 10, links=links)
    assert rows_of(got) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (7, 8)]
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000000"
    with pytest.raises(Exception, match="RECURSION_LEVEL_LIMIT"):
        recurse(spark, "a, b", "SELECT a, b FROM {links}", step, 1, links=links)
