"""Starting streaming queries with durable checkpoints."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from rillstone.session import fresh_dir, stored

PROVIDERS = {
    "heap": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
    "rocksdb": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# sessions are merged inside each task before the shuffle, so a heavy key sends sessions and not rows
_LOCAL_SESSIONS = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
_COUNTED = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
_CHAINED = "spark.sql.streaming.statefulOperator.allowMultiple"


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def start(
    df: DataFrame,
    path: str | None,
    checkpoint: str,
    format: str = "parquet",
    mode: str = "append",
    every: str | None = None,
    partition_by: Sequence[str] = (),
    max_rows_per_file: int | None = None,
    state: str = "rocksdb",
    single_stateful: bool = True,
    name: str | None = None,
    counted_state: bool = True,
    idle_batches: bool = True,
) -> StreamingQuery:
    """Start a query; restarted on the same checkpoint it continues without repeating or losing rows.

    `every` is the trigger interval, which also sets how often files are closed; without it the query takes
    what is available and ends.  `single_stateful` drops late rows by the watermark of the current batch; a
    plan with several stateful operators has to turn it off.  Without `counted_state` RocksDB does not look up each row that
    it writes, and progress reports no number of rows of the state.  Without `idle_batches` state behind the watermark goes with
    the next rows and not in a batch of its own: for queries that emit nothing when they drop state.
    """
    spark = df.sparkSession
    writer = df.writeStream.format(format).outputMode(mode).option("checkpointLocation", checkpoint)
    if path:
        writer = writer.option("path", path)
    if name:
        writer = writer.queryName(name)
    if max_rows_per_file:
        writer = writer.option("maxRecordsPerFile", max_rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    settings = {_PROVIDER: PROVIDERS[state], _CHAINED: "false" if single_stateful else "true", _LOCAL_SESSIONS: "true"}
    if not counted_state:
        settings[_COUNTED] = "false"
    if not idle_batches:
        settings[_IDLE] = "false"
    with _settings(spark, settings):
        return writer.start()


def dropped(query: StreamingQuery) -> int:
    """Rows that a query's stateful operators have dropped behind the watermark, by its recent progress."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


def run(df: DataFrame, path: str, checkpoint: str, **options) -> None:
    """Process everything available and wait for the end."""
    query = start(df, path, checkpoint, **options)
    query.awaitTermination()
    failure = query.exception()
    if failure is not None:
        raise failure


def to_table(df: DataFrame, name: str, format: str = "parquet", **options) -> DataFrame:
    """Run a stream over the available input into a new folder of the shared area, and read it."""
    spark = df.sparkSession
    root = fresh_dir(spark, name)
    run(df, f"{root}/out", f"{root}/checkpoint", format=format, **options)
    return spark.read.format(format).schema(df.schema).load(f"{root}/out")


def drained(df: DataFrame, name: str, **options) -> DataFrame:
    """`to_table` for sources that offer their input step by step: a query that runs until nothing more comes."""
    spark = df.sparkSession
    root = fresh_dir(spark, name)
    query = start(df, f"{root}/out", f"{root}/checkpoint", every="0 seconds", **options)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def until_idle(df: DataFrame, name: str, every: str = "500 milliseconds", wait_seconds: float = 120, **options) -> DataFrame:
    """`to_table` for state with timers on the clock: runs until all input is read and no state is left, or raises after a while."""
    spark = df.sparkSession
    root = fresh_dir(spark, name)
    query = start(df, f"{root}/out", f"{root}/checkpoint", every=every, **options)
    try:
        end = time.monotonic() + wait_seconds
        # processAllAvailable would not return: timers on the clock make Spark run batches without end
        while not (query.lastProgress and not query.lastProgress["numInputRows"] and sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"]) == 0):
            if not query.isActive or time.monotonic() > end:
                raise query.exception() or TimeoutError(f"{name}: state is left after {wait_seconds} seconds")
            time.sleep(0.1)
    finally:
        query.stop()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def with_open_windows(emitted: DataFrame, rows: DataFrame, time: str, delay_ms: int, end: str, whole, reach: str) -> DataFrame:
    """`emitted` and the windows that were still open when a bounded input ended.

    `rows` is the same input as a static frame, `whole` turns rows into windows with the column `end`, and no window that
    is open at the end holds a row older than `reach` before the watermark.  The watermark is the latest time, in whole
    milliseconds, less the delay; the stream has emitted what ends by it.
    """
    latest = rows.agg(F.max(F.unix_millis(F.col(time).cast("timestamp")))).first()[0]
    if latest is None:
        return emitted
    mark = F.timestamp_millis(F.lit(latest - delay_ms))
    late = rows.where(F.col(time).cast("timestamp") > mark - F.expr(f"INTERVAL {reach}"))
    return emitted.unionByName(whole(late).where(F.col(end) > mark))


def with_open_joined(
    emitted: DataFrame, left: DataFrame, right: DataFrame, left_time: str, right_time: str, delay_ms: int, whole, reach: str
) -> DataFrame:
    """`with_open_windows` for a join of two streams, whose watermark is the earlier one of both sides."""
    latest = [df.agg(F.max(F.unix_millis(F.col(t).cast("timestamp")))).first()[0] for df, t in ((left, left_time), (right, right_time))]
    if None in latest:
        return emitted  # nothing meets
    mark = F.timestamp_millis(F.lit(min(latest) - delay_ms))
    late = [df.where(F.col(t).cast("timestamp") > mark - F.expr(f"INTERVAL {reach}")) for df, t in ((left, left_time), (right, right_time))]
    return emitted.unionByName(whole(*late).where(F.col("window_end") > mark))


def with_open_sessions(emitted: DataFrame, rows: DataFrame, time: str, delay_ms: int, end: str, whole, keys: Sequence[str], gap: str) -> DataFrame:
    """`emitted` and the sessions that were still open when a bounded input ended: those of keys seen shortly before it."""
    latest = rows.agg(F.max(F.unix_millis(F.col(time).cast("timestamp")))).first()[0]
    if latest is None:
        return emitted
    mark = F.timestamp_millis(F.lit(latest - delay_ms))
    recent = rows.where(F.col(time).cast("timestamp") > mark - F.expr(f"INTERVAL {gap}")).select(*keys).distinct()
    # stored first: the optimizer pushes a condition on the end of a session below the merging of its rows
    last = stored(whole(rows.join(recent, list(keys), "left_semi")), "open-sessions")
    return emitted.unionByName(last.where(F.col(end) > mark))
