"""Keyed state kept by user code: running totals, per-record sums and sequence alerts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rillstone.operators.skew import same


def running_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """Count and sum per key so far, one row for each key a micro-batch changes.

    Each Arrow batch is reduced to one row per key inside its task before the shuffle, so a heavy key sends
    a few partial sums and not its rows.  Nulls count and add nothing; they never reach pandas, which would turn the
    numbers into floats.  Append-mode files take no aggregate without a watermark, hence the state function.
    """
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(value).cast("bigint"), F.lit(0)).alias("value"))
    kind = dict(rows.dtypes)["key"]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums = batch.groupby("key", dropna=False, sort=False)["value"].agg(["size", "sum"])
            yield sums.reset_index().rename(columns={"size": "n", "sum": "total"})

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0)
        for part in parts:
            n += int(part["n"].sum())
            total += int(part["total"].sum())
        state.update((n, total))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "total": [total]})

    out = f"key {kind}, n bigint, total bigint"
    return (
        rows.mapInPandas(partial, out)
        .groupBy("key")
        .applyInPandasWithState(update, out, "n bigint, total bigint", "append", GroupStateTimeout.NoTimeout)
        .withColumnRenamed("key", key)
    )


def idle_totals(df: DataFrame, key: str, value: str, idle_ms: int) -> DataFrame:
    """Count and sum of a key's rows, emitted once no row of it has come for `idle_ms` of processing time; then it starts anew.

    A timer on the clock closes what no later event would close.  Each Arrow batch is reduced to one row per key before
    the shuffle; nulls count and add nothing.  Rows that come again and again within `idle_ms` keep a key open.
    """
    rows = df.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(value).cast("bigint"), F.lit(0)).alias("total"))
    out = "key string, n bigint, total bigint"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.Table.from_batches([batch]).group_by(["key"]).aggregate([([], "count_all"), ("total", "sum")])
            yield from sums.select(["key", "count_all", "total_sum"]).rename_columns(["key", "n", "total"]).combine_chunks().to_batches()

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "n": [n], "total": [total]})
            return
        for part in parts:
            n += int(part["n"].sum())
            total += int(part["total"].sum())
        state.update((n, total))
        state.setTimeoutDuration(idle_ms)

    found = (
        rows.mapInArrow(partial, out)
        .groupBy("key")
        .applyInPandasWithState(update, out, "n bigint, total bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)
    )
    return found.select(F.col("key").cast(dict(df.dtypes)[key]).alias(key), "n", "total")


def rolling_sums(
    df: DataFrame,
    key: str,
    value: str,
    carry: Sequence[str],
    time: str | None = None,
    idle_ms: int | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """One output row per input row with the key's running sum, micro-batch by micro-batch.

    Within a micro-batch rows follow the columns `order`, which must be among `carry` or be the value; without them their
    order is the shuffle's.  A null value adds nothing and stays null in the output.  `carry` columns are passed
    through.  With `time`, a watermarked column, and `idle_ms`, a key starts anew once the watermark is that far
    beyond its latest row.

    The rows that a key brings in one micro-batch sit in one task: heavy keys go through `chunk_totals` and `sums_in_chunks`.
    """
    number = F.col(value).cast("bigint")
    rows = df.select(
        F.col(key).alias("key"), F.coalesce(number, F.lit(0)).alias("value"), number.isNull().alias("_absent"),
        *carry, *([time] if time else []),
    )
    by = ["value" if o == value else o for o in order]
    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        total, latest = state.get if state.exists else (0, 0)
        if time and latest + idle_ms <= state.getCurrentWatermarkMs():
            total, latest = 0, 0  # new rows came in the very batch in which the time ran out
        if by:
            parts = iter([pd.concat(list(parts), ignore_index=True).sort_values(by, kind="stable", ignore_index=True)])
        for part in parts:
            sums = part["value"].cumsum() + total
            if len(sums):
                total = int(sums.iloc[-1])
                if time:
                    latest = max(latest, int(part[time].max().timestamp() * 1000))
            yield part.assign(rolling=sums)
        state.update((total, latest))
        if time:
            state.setTimeoutTimestamp(max(latest + idle_ms, state.getCurrentWatermarkMs() + 1))

    return (
        rows.groupBy("key")
        .applyInPandasWithState(update, f"{fields}, rolling bigint", "total bigint, latest bigint", "append", timeout)
        .withColumn("value", F.when(~F.col("_absent"), F.col("value")))
        .drop("_absent")
        .withColumnRenamed("key", key)
    )


def chunk_totals(df: DataFrame, keys: Sequence[str], chunks: Sequence[str], value: str) -> DataFrame:
    """Rows `n` and sum `total` so far per key and chunk, one row for each chunk that a micro-batch changes.

    Each Arrow batch is reduced to one row per chunk before the shuffle, and the state is one total per chunk.  A null
    value adds nothing.
    """
    names, kinds = [*keys, *chunks], dict(df.dtypes)
    # keys as text: pandas would turn whole numbers beside nulls into floats
    rows = df.select(*[F.col(k).cast("string").alias(k) for k in keys], *chunks, F.coalesce(F.col(value).cast("bigint"), F.lit(0)).alias("total"))
    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "total") + ", n bigint, total bigint"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.Table.from_batches([batch]).group_by(names).aggregate([([], "count_all"), ("total", "sum")])
            columns = [*names, "count_all", "total_sum"]
            yield from sums.select(columns).rename_columns([*names, "n", "total"]).combine_chunks().to_batches()

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0)
        for part in parts:
            n += int(part["n"].sum())
            total += int(part["total"].sum())
        state.update((n, total))
        yield pd.DataFrame({**{name: [k] for name, k in zip(names, key)}, "n": [n], "total": [total]})

    return (
        rows.mapInArrow(partial, fields)
        .groupBy(*names)
        .applyInPandasWithState(update, fields, "n bigint, total bigint", "append", GroupStateTimeout.NoTimeout)
        .select(*[F.col(k).cast(kinds[k]).alias(k) for k in keys], *chunks, "n", "total")
    )


def fan_out_totals(df: DataFrame, sinks: Mapping[str, Column], value: str) -> DataFrame:
    """Counts and sums so far of several groupings from one read: `sink`, `key` (as text), `n`, `total`, when they change.

    Each row is expanded to one per sink within its task and reduced there per Arrow batch; the shuffle and the state have one
    row per sink and key.  A null key has no row.  Written with `partition_by=["sink"]`, every sink gets a folder of its own.
    """
    each = [F.struct(F.lit(name).alias("sink"), key.cast("string").alias("key")) for name, key in sinks.items()]
    rows = df.select(F.explode(F.array(*each)).alias("_s"), F.col(value)).select("_s.*", value).where("key IS NOT NULL")
    totals = chunk_totals(rows, ["sink", "key"], [], value)
    # a projection that stays in the plan: the sort of a partitioned sink can't take the rows of a state function as they are
    return totals.select("sink", "key", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).alias("total"))


def accumulate_windows(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    size_seconds: int,
    slide_seconds: int,
    schema: str,
    add: Callable[[pd.DataFrame, list[str]], pd.DataFrame],
    merge: Callable[[pd.DataFrame, list[str]], pd.DataFrame],
    delay: str = "0 seconds",
) -> DataFrame:
    """A user-defined aggregate over sliding windows, static or streaming: window_start, window_end, keys and `schema`.

    `add(rows, by)` turns rows into accumulators and `merge(accumulators, by)` combines accumulators, both to one row per
    value of the columns `by`, with the columns `schema` beside them.  Rows are accumulated per pane and key in their
    task; a window merges the accumulators of its panes.  On a stream, the state of a key is the accumulators of the
    panes that open windows hold, and a window is emitted once the watermark has passed its end; panes of which all
    windows are closed are dropped.  Rows without a time belong to no window; null keys are a key.
    """
    pane_us = math.gcd(size_seconds, slide_seconds) * 1_000_000
    size, slide = size_seconds * 1_000_000, slide_seconds * 1_000_000
    kinds, names = dict(df.dtypes), [f"_k{i}" for i in range(len(keys))]
    # keys as text: pandas would turn whole numbers beside nulls into floats
    seen = F.unix_micros(F.col(time).cast("timestamp"))
    rows = df.where(F.col(time).isNotNull()).select(
        *[c for c in df.columns if c not in (time, *keys)], *[F.col(k).cast("string").alias(n) for k, n in zip(keys, names)],
        (seen - F.pmod(seen, F.lit(pane_us))).alias("_pane"), seen.alias("_at"),
    )
    by = [*names, "_pane"]
    fields = [f.strip().split(" ")[0].strip("`") for f in schema.split(",")]
    keyed = "".join(f"{n} string, " for n in names)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                latest = batch.groupby(by, dropna=False, as_index=False)["_at"].max()
                yield add(batch.drop(columns="_at"), by).merge(latest, on=by)[[*by, "_at", *fields]]

    def windows_of(panes: pd.DataFrame) -> pd.DataFrame:
        """Each pane once for every window that holds it."""
        first = (panes["_pane"] - size + pane_us + slide - 1) // slide * slide  # the earliest such window
        copies = [panes.assign(_start=first + i * slide) for i in range(-(-size // slide))]
        every = pd.concat(copies, ignore_index=True)
        return every[(every["_start"] <= every["_pane"]) & (every["_pane"] + pane_us <= every["_start"] + size)]

    parts = rows.mapInPandas(partial, f"{keyed}_pane bigint, _at bigint, {schema}")
    out = f"{keyed}_start bigint, {schema}"
    if not df.isStreaming:
        found = (
            parts.drop("_at").groupBy(*by).applyInPandas(lambda p: merge(p, by)[[*by, *fields]], f"{keyed}_pane bigint, {schema}")
            .mapInPandas(lambda batches: (windows_of(b)[[*names, "_start", *fields]] for b in batches if len(b)), out)
            .groupBy(*names, "_start").applyInPandas(lambda w: merge(w, [*names, "_start"])[[*names, "_start", *fields]], out)
        )
    else:

        def update(key: tuple, arriving: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            held, told = state.get if state.exists else (None, 0)
            known = [pa.ipc.open_stream(held).read_pandas()] if held else []
            mark = state.getCurrentWatermarkMs() * 1000
            fresh = [p[[*by, *fields]] for p in arriving]
            panes = pd.concat([*known, *fresh], ignore_index=True) if known or fresh else None
            if panes is not None and len(panes):
                panes = panes[panes["_pane"] + size > told]  # else all of its windows are closed
                panes = merge(panes, by)[[*by, *fields]] if len(panes) else panes
            if panes is not None and len(panes):
                every = windows_of(panes)
                closed = every[(every["_start"] + size <= mark) & (every["_start"] + size > told)]
                if len(closed):
                    yield merge(closed, [*names, "_start"])[[*names, "_start", *fields]]
                panes = panes[(panes["_pane"] // slide) * slide + size > mark]
            if panes is None or not len(panes):
                state.remove()
                return
            table = pa.Table.from_pandas(panes, preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            state.update((sink.getvalue().to_pybytes(), mark))
            ends = windows_of(panes)["_start"] + size
            due = int(ends[ends > mark].min())
            state.setTimeoutTimestamp(max(due // 1000 - 1, mark // 1000 + 1))

        timed = parts.withColumn("_time", F.timestamp_micros("_at")).withWatermark("_time", delay)
        found = timed.groupBy(*names).applyInPandasWithState(
            update, out, "panes binary, told bigint", "append", GroupStateTimeout.EventTimeTimeout
        )
    return found.select(
        F.timestamp_micros("_start").alias("window_start"), F.timestamp_micros(F.col("_start") + size).alias("window_end"),
        *[F.col(n).cast(kinds[k]).alias(k) for k, n in zip(keys, names)], *fields,
    )


def sums_in_chunks(
    rows: DataFrame, totals: DataFrame, keys: Sequence[str], chunks: Sequence[str], order: Sequence[str], value: str, name: str
) -> DataFrame:
    """`rows` plus the key's running sum, from the emissions of `chunk_totals`: a window for each chunk, and what comes before it."""
    # the rows of a chunk only grow in number, so its last emission has the most
    last = totals.groupBy(*keys, *chunks).agg(F.max_by("total", "n").alias("total"))
    before = Window.partitionBy(*keys).orderBy(*chunks).rowsBetween(Window.unboundedPreceding, -1)
    carries = last.select(*keys, *chunks, F.coalesce(F.sum("total").over(before), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy(*keys, *chunks).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumn("_here", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return here.join(carries, same(here, carries, [*keys, *chunks]), "left").select(
        *[here[c] for c in rows.columns], (carries["_carry"] + here["_here"]).alias(name)
    )


def sequence_alerts(
    df: DataFrame,
    key: str,
    time: str,
    status: str,
    steps: Sequence[str],
    within_seconds: int,
    tie: str | None = None,
    delay: str = "0 seconds",
    chunks: Sequence[str] = (),
    copied: str | None = None,
    slots: int = 64,
) -> DataFrame:
    """Alerts for `steps` as consecutive events of a key within the limit, over a stream.

    Known of a key is the tail of its events, shorter than the pattern.  Tail and micro-batch are put in order of time, and
    of the integer column `tie` where times are equal, as numbers and one byte each; what a key brings at once is in one
    task.  Keys are dealt to `slots` groups, each with one table of tails as state: no call is made for a single key.  Heavy keys come in `chunks`, columns that cut a key's events into ranges, each with copies of the events before it
    that the column `copied` marks: an alert belongs to the range of its last event.  An alert needs a new event.  Events behind the watermark, `delay` after the latest event of
    earlier micro-batches, are dropped, as are events without a time.
    """
    steps = list(steps)
    depth = len(steps) - 1
    names = sorted(set(steps))
    code = F.coalesce(F.array_position(F.array(*[F.lit(n) for n in names]), F.col(status)), F.lit(0)).cast("tinyint")
    wanted = [names.index(s) + 1 for s in steps]
    seen = F.col(time).cast("timestamp")
    if copied:
        code = F.when(F.col(copied), -1 - code).otherwise(code).cast("tinyint")
    # keys as text: pandas would turn whole numbers beside nulls into floats
    kind = dict(df.dtypes)[key]
    own = F.to_json(F.struct(F.col(key).cast("string").alias("key"), *chunks))
    rows = df.withColumn("_seen", seen).where(seen.isNotNull()).withWatermark("_seen", delay).select(
        own.alias("own"), F.unix_micros("_seen").alias("at"), code.alias("code"),
        (F.col(tie).cast("bigint") if tie else F.lit(0).cast("bigint")).alias("tie"), "_seen",
    )
    rows = rows.withColumn("_slot", F.pmod(F.xxhash64("own"), F.lit(slots).cast("bigint")))

    def update(slot: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fields = ["own", "at", "code", "tie"]
        tails = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else pd.DataFrame(columns=fields)
        mark = state.getCurrentWatermarkMs() * 1000
        new = [p.loc[p["at"] >= mark, fields] for p in parts]
        events = pd.concat([t for t in (tails, *new) if len(t)] or [tails], ignore_index=True)
        who, owners = pd.factorize(events["own"])
        at, code, tie_ = (events[c].to_numpy("int64") for c in fields[1:])
        fresh = np.arange(len(at)) >= len(tails)
        order = np.lexsort((tie_, at, who))
        who, at, code, tie_, fresh = who[order], at[order], code[order], tie_[order], fresh[order]
        ends = np.arange(depth, len(at))
        hit = (who[ends] == who[ends - depth]) & (at[ends] - at[ends - depth] <= within_seconds * 1_000_000) & (code[ends] >= 0)
        any_new = np.zeros(len(ends), bool)
        kinds = np.where(code < 0, -1 - code, code)
        for i, step in enumerate(wanted):
            hit &= kinds[ends - depth + i] == step
            any_new |= fresh[ends - depth + i]
        found = ends[hit & any_new]
        yield pd.DataFrame({"own": owners[who[found]], "first_us": at[found - depth], "last_us": at[found]})
        keep = np.searchsorted(who, who, side="right") - np.arange(len(who)) <= depth
        held = {"own": pa.array(owners[who[keep]], pa.string()), "at": at[keep], "code": code[keep], "tie": tie_[keep]}
        table = pa.table(held)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))

    found = rows.groupBy("_slot").applyInPandasWithState(
        update, "own string, first_us bigint, last_us bigint", "tails binary", "append", GroupStateTimeout.NoTimeout
    )
    return found.select(
        F.from_json("own", "key string")["key"].cast(kind).alias(key), F.timestamp_micros("first_us").alias("first_time"),
        F.timestamp_micros("last_us").alias("last_time"),
    )
