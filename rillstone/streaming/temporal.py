"""State that waits for the watermark: joins with versions valid at a time, and spans that end too late.

Both operators answer only for times behind the watermark, when no earlier event can come any more, so their results don't
depend on the order in which rows arrive or on where micro-batches and restarts fall.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rillstone.operators.joins import asof_join

SLOTS = 64

_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _packed(columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), _JSON)


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(f"`{column}`").cast("timestamp"))


def temporal_join(
    facts: DataFrame,
    versions: DataFrame,
    on: Sequence[str],
    fact_time: str,
    version_time: str,
    columns: Sequence[str],
    delay: str = "0 seconds",
    inclusive: bool = True,
    tie: str | None = None,
    slots: int = 1,
) -> DataFrame:
    """Each fact of a stream with `columns` of the version of its key that was valid at its time, null if there was none.

    The stream form of `asof_join`.  The state of a key is its versions in order of time, and of the integer column `tie`
    where times are equal, and the facts that still wait.  A fact is answered once the watermark has passed its time; the
    watermark is the earlier one of both sides, each `delay` behind its latest row.  Of the versions behind the watermark
    only the latest stays.  Versions may come in any order; rows at or behind the watermark are dropped, as are versions
    without a key or a time.  Facts without a key or a time are passed on at once and know none.  With `inclusive`, a
    version at exactly the fact's time counts.  Facts of one key are dealt to `slots` tasks, each with all its versions.
    """
    keys = [f"_k{i}" for i in range(len(on))]
    complete = lambda time: F.expr(" AND ".join([f"`{c}` IS NOT NULL" for c in [*on, time]]))
    slot = F.pmod(F.xxhash64(_packed(facts.columns)), F.lit(slots).cast("bigint"))

    def side(df: DataFrame, time: str, fact: bool, row: Column, tie: Column, slot: Column) -> DataFrame:
        timed = df.where(complete(time)).withColumn("_time", F.col(f"`{time}`").cast("timestamp")).withWatermark("_time", delay)
        return timed.select(
            *[F.col(f"`{c}`").alias(k) for c, k in zip(on, keys)], slot.alias("_slot"), F.lit(fact).alias("fact"),
            F.unix_micros("_time").alias("at"), tie.cast("bigint").alias("tie"), row.alias("row"), "_time",
        )

    none = F.lit(0)
    asked = side(facts, fact_time, True, _packed(facts.columns), none, slot)
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slots - 1).cast("bigint")))
    known = side(versions, version_time, False, _packed(columns), F.col(f"`{tie}`") if tie else none, every)
    edge = "right" if inclusive else "left"

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, ties, rows, waiting, asking = ([*x] for x in state.get) if state.exists else ([], [], [], [], [])
        mark = state.getCurrentWatermarkMs() * 1000
        for part in parts:
            fact = part["fact"].to_numpy(bool)
            versions = part[~fact]
            at += versions["at"].tolist()
            ties += versions["tie"].fillna(0).astype("int64").tolist()
            rows += versions["row"].tolist()
            timely = part[fact & (part["at"].to_numpy("int64") >= mark)]
            waiting += timely["at"].tolist()
            asking += timely["row"].tolist()
        order = np.lexsort((np.array(ties, "int64"), np.array(at, "int64")))
        times = np.array(at, "int64")[order]
        wait = np.array(waiting, "int64")
        done = np.flatnonzero(wait < mark)
        found = np.searchsorted(times, wait[done], side=edge) - 1
        if len(done):
            yield pd.DataFrame({"row": [asking[i] for i in done], "version": [rows[order[f]] if f >= 0 else None for f in found]})
        # what comes from here on asks for the mark or later
        kept = order[max(0, int(np.searchsorted(times, mark, side=edge)) - 1) :]
        left = np.flatnonzero(wait >= mark).tolist()
        state.update(([at[i] for i in kept], [ties[i] for i in kept], [rows[i] for i in kept], wait[left].tolist(), [asking[i] for i in left]))
        if left:
            state.setTimeoutTimestamp(max(int(wait[left].min()) // 1000, mark // 1000 + 1))

    answered = (
        asked.unionByName(known)
        .groupBy(*keys, "_slot")
        .applyInPandasWithState(
            update, "row string, version string", "at array<bigint>, tie array<bigint>, rows array<string>, waiting array<bigint>, asking array<string>",
            "append", GroupStateTimeout.EventTimeTimeout,
        )
    )
    unknown = facts.where(~complete(fact_time)).select(_packed(facts.columns).alias("row"), F.lit(None).cast("string").alias("version"))
    fields = versions.select(*columns).schema
    both = answered.unionByName(unknown).select(
        F.from_json("row", facts.schema, _JSON).alias("f"), F.from_json("version", fields, _JSON).alias("v")
    )
    return both.select(*[F.col("f")[c].alias(c) for c in facts.columns], *[F.col("v")[c].alias(c) for c in columns])


def with_waiting_facts(
    emitted: DataFrame,
    facts: DataFrame,
    versions: DataFrame,
    on: Sequence[str],
    fact_time: str,
    version_time: str,
    columns: Sequence[str],
    delay_ms: int = 0,
    inclusive: bool = True,
    tie: str | None = None,
) -> DataFrame:
    """`emitted` and the facts that still waited when a bounded input ended; `facts` and `versions` are the same input, static."""
    latest = lambda df, time: df.dropna(subset=[*on, time]).agg(F.max(F.unix_millis(F.col(f"`{time}`").cast("timestamp")))).first()[0]
    ends = [latest(facts, fact_time), latest(versions, version_time)]
    waits = F.col(f"`{fact_time}`").isNotNull()
    for c in on:
        waits = waits & F.col(f"`{c}`").isNotNull()
    if None not in ends:  # else no watermark ever moved
        waits = waits & (_micros(fact_time) >= (min(ends) - delay_ms) * 1000)
    open_ = facts.where(waits)
    mine = versions.join(open_.select(*on).distinct(), list(on), "left_semi")
    # the order of facts among themselves decides nothing
    orders = ([fact_time, "_tie"], [version_time, tie or "_tie"])
    left, right = open_.withColumn("_tie", F.lit(0).cast("bigint")), mine if tie else mine.withColumn("_tie", F.lit(0).cast("bigint"))
    late = asof_join(left, right, on, *orders, columns, inclusive)
    return emitted.unionByName(late.select(*emitted.columns))


def tag_late(df: DataFrame, time: str, delay: str, window_seconds: int | None = None, slots: int = 64) -> DataFrame:
    """The rows of a stream with `late`: whether they came behind the watermark of their micro-batch.

    With `window_seconds` a row is late once the tumbling window that it is in has closed, which is when windowed aggregates
    drop it.  Rows without a time are late.  Nothing is kept between micro-batches; rows are dealt to `slots` tasks by
    their content.
    """
    rows = df.withColumn("_time", F.col(f"`{time}`").cast("timestamp")).withWatermark("_time", delay)
    at = F.unix_micros("_time")
    span = (window_seconds or 0) * 1_000_000
    end = at - F.pmod(at, F.lit(span)) + span if span else at
    packed = rows.select(_packed(df.columns).alias("row"), end.alias("end"), "_time")
    slot = F.pmod(F.xxhash64("row"), F.lit(slots).cast("bigint")).alias("_slot")

    def tag(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # the aggregates of a row at the watermark are still open, a window that ends there is closed
        mark = state.getCurrentWatermarkMs() * 1000
        for part in parts:
            ends = part["end"]
            behind = ends <= mark if span else ends < mark
            yield pd.DataFrame({"row": part["row"], "late": (behind | ends.isna()).astype(bool)})

    tagged = packed.select("*", slot).groupBy("_slot").applyInPandasWithState(
        tag, "row string, late boolean", "nothing int", "append", GroupStateTimeout.NoTimeout
    )
    fields = F.from_json("row", df.schema, _JSON)
    return tagged.select(fields.alias("r"), "late").select(*[F.col("r")[c].alias(c) for c in df.columns], "late")


def overdue(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    started: Column,
    ended: Column,
    limit_seconds: int,
    delay: str = "0 seconds",
    retain_seconds: int = 86_400,
    slots: int = SLOTS,
) -> DataFrame:
    """Keys whose span has no end within the limit: keys, `started_at`, `due_at`, raised by a timer once the watermark is past `due_at`.

    A key's span begins with its first event that `started` is true for, and ends with the first event that `ended` is true for
    at that time or later.  A key that never ends is reported without any further event.  Each key is reported once; what
    is known of a key goes `retain_seconds` after it was due or ended.  Events at or behind the watermark are dropped, as
    are those without a time.  What is known of a key is its start, its end and ends that are ahead of the watermark.  Keys are
    dealt to `slots` groups, each with one table of its keys as state: the work is that of the rows, not of a call for each key.
    """
    seen = F.col(f"`{time}`").cast("timestamp")
    rows = (
        df.select(*[F.col(f"`{k}`") for k in keys], seen.alias("_time"), F.coalesce(started, F.lit(False)).alias("starts"), F.coalesce(ended, F.lit(False)).alias("ends"))
        .where("_time IS NOT NULL AND (starts OR ends)")
        .withWatermark("_time", delay)
        .withColumn("at", F.unix_micros("_time"))
    )
    # keys as text: pandas would turn whole numbers beside nulls into floats
    kinds, names = dict(rows.dtypes), [f"_k{i}" for i in range(len(keys))]
    key = F.to_json(F.struct(*[F.col(f"`{k}`").cast("string").alias(n) for k, n in zip(keys, names)]))
    rows = rows.select(key.alias("key"), "at", "starts", "ends", "_time")
    rows = rows.withColumn("_slot", F.pmod(F.xxhash64("key"), F.lit(slots).cast("bigint")))
    limit, retain = limit_seconds * 1_000_000, retain_seconds * 1_000_000
    start_, told_, end_ = 0, 1, 2  # kinds of rows in the state: a start, one that was told or ended, an end
    never = np.iinfo("int64").max

    def update(slot: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs() * 1000
        known = [pa.ipc.open_stream(state.get[0]).read_pandas()] if state.exists else []
        for part in parts:
            timely = part[part["at"] >= mark]
            for flag, kind in (("starts", start_), ("ends", end_)):
                known.append(timely.loc[timely[flag].to_numpy(bool), ["key", "at"]].assign(kind=np.int8(kind)))
        events = pd.concat(known, ignore_index=True)
        who, found = pd.factorize(events["key"])
        at, kind = events["at"].to_numpy("int64"), events["kind"].to_numpy("int8")
        start, told = np.full(len(found), never), np.zeros(len(found), bool)
        np.minimum.at(start, who[kind == start_], at[kind == start_])
        told[who[kind == told_]] = True
        start[who[kind == told_]] = at[kind == told_]  # what was told stays
        begun = start < never
        of, ends = who[kind == end_], at[kind == end_]
        after, later = np.full(len(found), never), begun[of] & (ends >= start[of])
        np.minimum.at(after, of[later], ends[later])
        due = np.where(begun, start, 0) + limit
        now = begun & ~told & (mark > due)
        late = now & ((after == never) | (after > due))
        if late.any():
            yield pd.DataFrame({"key": found[late], "start_us": start[late], "due_us": due[late]})
        told |= now
        # an earlier start can only come ahead of the mark, so ends behind it are of use only to the start that is known
        kept = (ends >= mark) | (ends == after[of])
        of, ends = of[kept], ends[kept]
        last = np.where(begun, due, np.int64(-1))
        np.maximum.at(last, of[~begun[of]], ends[~begun[of]])
        alive = (last >= 0) & (mark <= last + retain)
        if not alive.any():
            state.remove()
            return
        stay, of_alive = begun & alive, alive[of]
        held = pd.DataFrame({
            "key": np.concatenate([found[stay], found[of[of_alive]]]), "at": np.concatenate([start[stay], ends[of_alive]]),
            "kind": np.concatenate([np.where(told[stay], told_, start_), np.full(int(of_alive.sum()), end_)]).astype("int8"),
        }).drop_duplicates()
        table = pa.Table.from_pandas(held, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))
        timer = int(np.where(begun & ~told, due, last + retain)[alive].min())
        state.setTimeoutTimestamp(max(timer // 1000, mark // 1000 + 1))

    found = rows.groupBy("_slot").applyInPandasWithState(
        update, "key string, start_us bigint, due_us bigint", "held binary", "append", GroupStateTimeout.EventTimeTimeout
    )
    named = F.from_json("key", ", ".join(f"{n} string" for n in names)).alias("_key")
    return found.select(named, "start_us", "due_us").select(
        *[F.col("_key")[n].cast(kinds[k]).alias(k) for n, k in zip(names, keys)],
        F.timestamp_micros("start_us").alias("started_at"), F.timestamp_micros("due_us").alias("due_at"),
    )
