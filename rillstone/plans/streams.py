"""Streaming queries: the event table read as a stream, run over everything available and written to files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rillstone.operators import fraud, joins, parsing, routing
from rillstone.operators.rolling import with_preceding
from rillstone.operators.skew import HEAVY, cut_heavy
from rillstone.functions.time import SECONDS, text
from rillstone.operators.windows import sliding_by_panes, stamp_arrival, streaming_sessions, windowed
from rillstone.plans.basics import ORACLES as BASICS, transaction_lines
from rillstone.plans.common import EVENTS_SQL, cents, events, in_cents, scored_input, shown
from rillstone.plans.joins import ORACLES as JOINS
from rillstone.plans.reports import ORACLES as REPORTS
from rillstone.plans.scoring import ORACLES as SCORING
from rillstone.plans.windows import ORACLES as WINDOWS, window_sql
from rillstone.session import fresh_dir, stored
from rillstone.sinks import write_text
from rillstone.sources.files import table
from rillstone.sources.replay import replay
from rillstone.sources.streams import line_stream, table_stream
from rillstone.streaming.runner import drained, run, to_table, until_idle, with_open_joined, with_open_sessions, with_open_windows
from rillstone.streaming.stateful import accumulate_windows, chunk_totals, fan_out_totals, idle_totals, rolling_sums, running_totals, sequence_alerts, sums_in_chunks
from rillstone.streaming.temporal import overdue, tag_late, temporal_join, with_waiting_facts

_BOUNDS = ("window_start", "window_end")


_COLUMNS = ("event_id", "ts", "user_id", "event_type", "cents")
_SLICES = 2
_SLOT_ROWS = 50_000  # rows that one group of keys with a common state may get
_ORDER = ["at", "event_id"]


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return in_cents(table_stream(spark, folder, "events")).select(*_COLUMNS)


def _ordered(spark: SparkSession, folder: str) -> DataFrame:
    """The events with `at`, their time in microseconds; events without a time come after all others, as they do in the SQL."""
    rows = events(spark, folder, *_COLUMNS)
    high = rows.agg(F.max(F.unix_micros("ts"))).first()[0]
    return rows.withColumn("at", F.coalesce(F.unix_micros("ts"), F.lit((high or 0) + 1)))


def _slots(rows: DataFrame) -> int:
    return max(16, rows.count() // _SLOT_ROWS)


def _by_slices(spark: SparkSession, rows: DataFrame, name: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run `build` over `rows` as they arrive in two spans of `at`: one micro-batch and one restart for each span."""
    low, high = rows.agg(F.min("at"), F.max("at")).first()
    width = ((high or 0) - (low or 0)) // _SLICES + 1
    span = F.floor((F.col("at") - (low or 0)) / width)
    root = fresh_dir(spark, name)
    for i in range(_SLICES):
        rows.where(span == i).write.mode("append").parquet(f"{root}/in")
        out = build(spark.readStream.schema(rows.schema).parquet(f"{root}/in"))
        run(out, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{root}/out")


def stream_tumbling_sum(spark: SparkSession, folder: str) -> DataFrame:
    whole = lambda rows: windowed(rows, "ts", "1 hour", [F.sum("cents").alias("total")])
    closed = to_table(whole(_events(spark, folder).withWatermark("ts", "0 seconds")), "stream_tumbling_sum")
    return shown(with_open_windows(closed, events(spark, folder, *_COLUMNS), "ts", 0, "window_end", whole, "1 hour"), *_BOUNDS)


def stream_sliding_sum(spark: SparkSession, folder: str) -> DataFrame:
    whole = lambda rows: windowed(rows, "ts", "2 hours", [F.sum("cents").alias("total")], ["event_type"], "1 hour")
    closed = to_table(whole(_events(spark, folder).withWatermark("ts", "1 second")), "stream_sliding_sum")
    return shown(with_open_windows(closed, events(spark, folder, *_COLUMNS), "ts", 1000, "window_end", whole, "2 hours"), *_BOUNDS)


def stream_session(spark: SparkSession, folder: str) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("events"), F.sum("cents").alias("cents")]
    whole = lambda rows: streaming_sessions(rows, "ts", "6 hours", ["user_id"], aggs)
    closed = to_table(whole(_events(spark, folder).withWatermark("ts", "0 seconds")), "stream_session")
    rows = events(spark, folder, *_COLUMNS)
    done = with_open_sessions(closed, rows, "ts", 0, "session_end", whole, ["user_id"], "6 hours")
    return shown(done, "session_start", "session_end")


def _arriving(rows: DataFrame) -> DataFrame:
    """Five events a second in the order of their ids, from the start of 2024 on."""
    return stamp_arrival(rows, at=F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("event_id") * 200_000))


def stream_processing_time(spark: SparkSession, folder: str) -> DataFrame:
    """Every window of five seconds of arrival, by arrival times that are replayed instead of taken from the clock."""
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("cents").alias("total")]
    whole = lambda rows: windowed(rows, "arrived_at", "5 seconds", aggs, ["event_type"])
    closed = to_table(whole(_arriving(_events(spark, folder)).withWatermark("arrived_at", "0 seconds")), "stream_processing_time")
    rows = _arriving(events(spark, folder, *_COLUMNS))
    return shown(with_open_windows(closed, rows, "arrived_at", 0, "window_end", whole, "5 seconds"), *_BOUNDS)


def stream_late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Events that arrive in four parts by time, some a part too late: hours summed without the late ones, and those as a side output."""
    rows = events(spark, folder, *_COLUMNS).where("ts IS NOT NULL")
    low, high = rows.agg(F.min(F.unix_millis("ts")), F.max(F.unix_millis("ts"))).first()
    width = ((high or 0) - (low or 0)) // 4 + 1
    part = F.floor((F.unix_millis("ts") - (low or 0)) / width)
    # the events of every 19th id come with the next part
    placed = stored(rows.withColumn("part", F.least(part + (F.col("event_id") % 19 == 0).cast("int"), F.lit(3))), "stream-parts")
    root = fresh_dir(spark, "stream_late_rows")
    for i in range(4):
        placed.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    tagged = to_table(tag_late(stream, "ts", "0 seconds", 3600), "stream_late_rows", partition_by=["late"])
    hours = tagged.groupBy("late", F.date_trunc("hour", "ts").alias("hour"))
    return shown(hours.agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("total")), "hour")


def stream_fan_out(spark: SparkSession, folder: str) -> DataFrame:
    """One read of the input, two sinks with aggregates of their own: totals per kind of event, and events per hour."""
    hour = text(F.date_trunc("hour", "ts"), SECONDS)
    totals = fan_out_totals(_events(spark, folder), {"kinds": F.col("event_type"), "hours": hour}, "cents")
    written = to_table(totals, "stream_fan_out", partition_by=["sink"])
    # the rows of a key only grow in number, so its last emission has the most
    last = written.groupBy("sink", "key").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total"))
    return last.select("sink", "key", F.when(F.col("sink") == "kinds", F.col("total")).otherwise(F.col("n")).alias("value"))


def _spread_of(rows: DataFrame) -> DataFrame:
    """Count, sum and sum of squares of whole values over three hours, every hour, by a user-defined accumulator."""
    fields = ["n", "total", "squares"]
    merge = lambda part, by: part.groupby(by, as_index=False, dropna=False)[fields].sum()
    add = lambda part, by: merge(part.assign(n=1, squares=part["total"] ** 2), by)
    whole = rows.select("event_type", "ts", F.floor(F.col("cents") / 100).alias("total"))
    return accumulate_windows(whole, ["event_type"], "ts", 3 * 3600, 3600, "n bigint, total bigint, squares bigint", add, merge)


def stream_accumulator(spark: SparkSession, folder: str) -> DataFrame:
    """A user-defined aggregate over sliding windows of a stream, from panes of an hour."""
    rows = _events(spark, folder).where("cents IS NOT NULL")
    static = events(spark, folder, *_COLUMNS).where("cents IS NOT NULL")
    closed = to_table(_spread_of(rows), "stream_accumulator")
    return shown(with_open_windows(closed, static, "ts", 0, "window_end", _spread_of, "3 hours"), *_BOUNDS)


def stream_sliding_panes(spark: SparkSession, folder: str) -> DataFrame:
    """Means over three hours, every hour, from counts and sums per hour."""
    aggs = {"n": (F.count(F.lit(1)), F.sum), "total": (F.sum("cents"), F.sum)}
    whole = lambda rows: sliding_by_panes(rows, "ts", 3 * 3600, 3600, aggs, ["event_type"])
    closed = to_table(whole(_events(spark, folder).withWatermark("ts", "0 seconds")), "stream_sliding_panes", single_stateful=False)
    done = with_open_windows(closed, events(spark, folder, *_COLUMNS), "ts", 0, "window_end", whole, "3 hours")
    return shown(done.select(*_BOUNDS, "event_type", (F.col("total") / F.col("n")).alias("mean_cents")), *_BOUNDS)


def stream_delimited_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Transaction lines that arrive as text files, parsed and written row by row as delimited files."""
    root = fresh_dir(spark, "lines")
    write_text(transaction_lines(spark, folder), f"{root}/in", F.col("line"))
    return to_table(parsing.parse(line_stream(spark, f"{root}/in"), "value"), "stream_delimited_lines", format="csv")


def stream_rolling_sum(spark: SparkSession, folder: str) -> DataFrame:
    """Every event with its user's running sum, kept in state across micro-batches.

    Users with more events than a task may hold are cut into ranges: the state has a total for each range, and the sums
    inside a range are a window over the stored events.
    """

    def build(stream: DataFrame) -> DataFrame:
        return rolling_sums(stream.select("event_id", "user_id", "cents", "at"), "user_id", "cents", ["event_id", "at"], order=_ORDER)

    rows = _ordered(spark, folder)
    cut = cut_heavy(rows, ["user_id"], _ORDER)
    if cut is None:
        light = rows
    else:
        frame = stored(cut.frame, "stream-ranges")
        light, heavy = frame.where(~F.col(HEAVY)), frame.where(HEAVY)
    sums = _by_slices(spark, light, "stream_rolling_sum", build).select("event_id", "user_id", F.col("rolling").alias("total"))
    if cut is None:
        return sums
    totals = _by_slices(spark, heavy, "stream_range_totals", lambda stream: chunk_totals(stream, ["user_id"], cut.chunks, "cents"))
    inside = sums_in_chunks(heavy, totals, ["user_id"], cut.chunks, _ORDER, "cents", "total")
    return sums.unionByName(inside.select("event_id", "user_id", "total"))


def stream_pattern(spark: SparkSession, folder: str) -> DataFrame:
    """Three errors and then a purchase, one right after the other within three days.

    Users with more events than a task may hold are cut into ranges, each with copies of the three events before it.
    """
    steps = ["error", "error", "error", "purchase"]
    rows = _ordered(spark, folder).where(F.col("ts").isNotNull())
    cut = cut_heavy(rows, ["user_id"], _ORDER)
    chunks, copied = ((), None) if cut is None else (cut.chunks, "_copied")
    if cut is not None:
        rows = stored(with_preceding(cut, ["user_id"], _ORDER, len(steps) - 1, copied), "stream-ranges")
    slots = _slots(rows)
    build = lambda stream: sequence_alerts(
        stream, "user_id", "ts", "event_type", steps, 3 * 86400, "event_id", chunks=chunks, copied=copied, slots=slots
    )
    return shown(_by_slices(spark, rows, "stream_pattern", build), "first_time", "last_time")


def stream_asof(spark: SparkSession, folder: str) -> DataFrame:
    """Every purchase with the user's latest view before it, answered once the watermark has passed the purchase."""

    def sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        bought = rows.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "cents")
        seen = rows.where("event_type = 'view'").select(
            "user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"), F.col("cents").alias("view_cents")
        )
        return bought, seen

    how = ["user_id"], "ts", "view_ts", ["view_id", "view_ts", "view_cents"]
    answered = to_table(temporal_join(*sides(_events(spark, folder)), *how, inclusive=False, tie="view_id"), "stream_asof")
    whole = with_waiting_facts(answered, *sides(events(spark, folder, *_COLUMNS)), *how, inclusive=False, tie="view_id")
    return shown(whole, "ts", "view_ts")


def stream_window_join(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks and purchases of a user in the same hour: two windowed aggregates of streams, joined on window and user."""
    clicks = [F.count(F.lit(1)).alias("clicks"), F.sum("cents").alias("click_cents")]
    bought = [F.count(F.lit(1)).alias("purchases"), F.sum("cents").alias("purchase_cents")]
    whole = lambda left, right: joins.window_join(left, right, ["user_id"], "ts", "ts", "1 hour", None, clicks, bought)
    sides = lambda rows: [rows.where(F.col("event_type") == kind) for kind in ("click", "purchase")]
    timed = [side.withWatermark("ts", "0 seconds") for side in sides(_events(spark, folder))]
    closed = to_table(whole(*timed), "stream_window_join", single_stateful=False)
    done = with_open_joined(closed, *sides(events(spark, folder, *_COLUMNS)), "ts", "ts", 0, whole, "1 hour")
    return shown(done.withColumn("pairs", F.col("clicks") * F.col("purchases")), *_BOUNDS)


def stream_ride_overdue(spark: SparkSession, folder: str) -> DataFrame:
    """Rides, one per user and day, that were started and not completed within six hours; most never are."""
    rows = _events(spark, folder).withColumn("day", F.to_date("ts").cast("string"))
    started, ended = F.col("event_type") == "signup", F.col("event_type") == "purchase"
    slots = _slots(table(spark, folder, "events"))
    late = overdue(rows, ["user_id", "day"], "ts", started, ended, 6 * 3600, slots=slots)
    return shown(to_table(late, "stream_ride_overdue"), "started_at", "due_at")


def stream_report_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Report lines of transactions that aren't flagged, written as text by the stream."""
    scored = fraud.normal(fraud.score(scored_input(table_stream(spark, folder, "orders"), spark, folder)))
    return to_table(scored.select(fraud.normal_text().alias("value")), "stream_report_lines", format="text")


def stream_count_by_type(spark: SparkSession, folder: str) -> DataFrame:
    counts = to_table(running_totals(_events(spark, folder), "event_type", "cents"), "stream_count_by_type")
    # the counts of a key only grow, so its last emission is the largest
    return counts.groupBy("event_type").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total"))


def stream_idle_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Count and sum per kind of event, closed by a timer on the clock once no more rows come."""
    return until_idle(idle_totals(_events(spark, folder), "event_type", "cents", 1_000), "stream_idle_totals")


def stream_order_ship(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines shipped within 30 days of their order, by a join of two streams whose state is bounded by time."""
    orders = table_stream(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ordered"))
    lines = table_stream(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("shipped"))
    met = joins.interval_join(orders, lines, {"o_orderkey": "l_orderkey"}, "ordered", "shipped", "30 days", "0 seconds")
    days = F.date_diff("shipped", "ordered").alias("days")
    # an inner join emits nothing when it drops state
    return to_table(met.select("o_orderkey", "l_linenumber", days), "stream_order_ship", counted_state=False, idle_batches=False)


def stream_replay(spark: SparkSession, folder: str) -> DataFrame:
    """The events replayed in ranges of their ids by a user-defined stream source, counted per kind of event."""
    rows = replay(spark, f"{folder}/events.parquet", "event_id", ["event_id", "event_type", "value"], batches=3, tasks=4)
    counts = drained(running_totals(rows.withColumn("cents", cents("value")), "event_type", "cents"), "stream_replay")
    return counts.groupBy("event_type").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total"))


def stream_split(spark: SparkSession, folder: str) -> DataFrame:
    tagged = routing.parity(_events(spark, folder).select("event_id", "event_type"), "event_id")
    return to_table(tagged, "stream_split", partition_by=["tag"]).select("event_id", "event_type", "tag")


def stream_fraud(spark: SparkSession, folder: str) -> DataFrame:
    scored = fraud.score(scored_input(table_stream(spark, folder, "orders"), spark, folder))
    tagged = routing.tagged(scored, {"fraud": F.col("is_fraud")}, "normal").select("txn_id", "score", "tag")
    return to_table(tagged, "stream_fraud", partition_by=["tag"]).select("txn_id", "score", "tag")


QUERIES = {
    f.__name__: f
    for f in (
        stream_tumbling_sum, stream_sliding_sum, stream_session, stream_processing_time, stream_late_rows, stream_count_by_type,
        stream_fan_out, stream_accumulator, stream_sliding_panes, stream_delimited_lines, stream_rolling_sum, stream_pattern, stream_asof, stream_window_join, stream_ride_overdue, stream_idle_totals, stream_order_ship, stream_replay, stream_split, stream_fraud, stream_report_lines,
    )
}

_SUM = "CAST(sum(cents) AS BIGINT) AS total"


ORACLES = {
    "stream_tumbling_sum": window_sql(1, "", _SUM),
    "stream_sliding_sum": window_sql(2, "event_type", _SUM),
    "stream_session": f"""
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start,
               strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS session_end,
               count(*) AS events, CAST(sum(cents) AS BIGINT) AS cents
        FROM (SELECT *, sum(opened) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
          SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR
                         THEN 0 ELSE 1 END AS opened
          FROM ({EVENTS_SQL})))
        GROUP BY user_id, s""",
    "stream_processing_time": f"""
        SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(w + INTERVAL 5 SECOND, '%Y-%m-%d %H:%M:%S') AS window_end,
               event_type, count(*) AS n, {_SUM}
        FROM (SELECT *, TIMESTAMP '2024-01-01' + CAST(event_id // 25 AS INTEGER) * INTERVAL 5 SECOND AS w FROM ({EVENTS_SQL}))
        GROUP BY w, event_type""",
    "stream_late_rows": f"""
        WITH rows AS (SELECT *, epoch_ms(ts) AS ms FROM ({EVENTS_SQL}) WHERE ts IS NOT NULL),
             ends AS (SELECT min(ms) AS low, (max(ms) - min(ms)) // 4 + 1 AS width FROM rows),
             placed AS (SELECT rows.*, least((ms - low) // width + CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END, 3) AS part FROM rows, ends),
             marks AS (SELECT part, max(ms) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark
                       FROM (SELECT part, max(ms) AS ms FROM placed GROUP BY part))
        SELECT epoch_ms(date_trunc('hour', ts) + INTERVAL 1 HOUR) <= coalesce(mark, 0) AS late,
               strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n, {_SUM}
        FROM placed JOIN marks USING (part) GROUP BY 1, 2""",
    "stream_fan_out": f"""
        SELECT 'kinds' AS sink, event_type AS key, CAST(sum(cents) AS BIGINT) AS value FROM ({EVENTS_SQL}) GROUP BY 2
        UNION ALL SELECT 'hours', window_start, n FROM ({window_sql(1, "", "count(*) AS n")})""",
    "stream_accumulator": window_sql(
        3, "event_type", """count(*) AS n, CAST(sum(CAST(floor(cents / 100.0) AS BIGINT)) AS BIGINT) AS total,
        CAST(sum(CAST(floor(cents / 100.0) * floor(cents / 100.0) AS BIGINT)) AS BIGINT) AS squares""", "WHERE cents IS NOT NULL"
    ),
    "stream_sliding_panes": WINDOWS["window_sliding_avg"],
    "stream_delimited_lines": BASICS["parse_good"],
    "stream_rolling_sum": f"""
        SELECT event_id, user_id, CAST(sum(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id
               ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM ({EVENTS_SQL})""",
    "stream_pattern": f"SELECT user_id, first_time, ts AS last_time FROM ({REPORTS['pattern_fail_then_success']})",
    "stream_asof": JOINS["join_asof"],
    "stream_window_join": JOINS["join_window"],
    "stream_ride_overdue": """
        WITH rides AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, ts, event_type FROM events
                       WHERE event_type IN ('signup', 'purchase') AND ts IS NOT NULL),
             started AS (SELECT user_id, day, min(ts) AS begun FROM rides WHERE event_type = 'signup' GROUP BY ALL)
        SELECT user_id, day, strftime(begun, '%Y-%m-%d %H:%M:%S') AS started_at,
               strftime(begun + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS due_at
        FROM started s
        WHERE date_trunc('milliseconds', (SELECT max(ts) FROM rides)) > begun + INTERVAL 6 HOUR
          AND NOT EXISTS (SELECT 1 FROM rides r WHERE r.event_type = 'purchase' AND r.user_id IS NOT DISTINCT FROM s.user_id
                          AND r.day = s.day AND r.ts BETWEEN s.begun AND s.begun + INTERVAL 6 HOUR)""",
    "stream_report_lines": f"SELECT line AS value FROM ({SCORING['format_normal']})",
    "stream_count_by_type": f"SELECT event_type, count(*) AS n, {_SUM} FROM ({EVENTS_SQL}) GROUP BY 1",
    "stream_idle_totals": f"SELECT event_type, count(*) AS n, {_SUM} FROM ({EVENTS_SQL}) GROUP BY 1",
    "stream_order_ship": """
        SELECT o_orderkey, l_linenumber, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS days
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY""",
    "stream_replay": f"SELECT event_type, count(*) AS n, {_SUM} FROM ({EVENTS_SQL}) WHERE event_id IS NOT NULL GROUP BY 1",
    "stream_split": """
        SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS tag FROM events""",
    "stream_fraud": f"""
        SELECT txn_id, score, CASE WHEN is_fraud THEN 'fraud' ELSE 'normal' END AS tag
        FROM ({SCORING["fraud_score"]})""",
}
