"""A table replayed as a stream by ranges of an integer column: a user-defined stream source with offsets.

The offset is a value of the column.  A micro-batch covers the values from its start offset up to its end offset, cut
into partitions that the executors read, so a restart or a retried task reads exactly the same rows again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from rillstone.encoded import files_at
from rillstone.sources.streams import custom


class Range(InputPartition):
    """Values from `low` to `high` - 1."""

    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


def _dataset(path: str) -> ds.Dataset:
    files, inner = files_at(path)
    return ds.dataset(inner, filesystem=files, format="parquet")


class ReplayReader(DataSourceStreamReader):
    """Micro-batches of `step` values of the column, `tasks` partitions in each."""

    def __init__(self, path: str, column: str, names: Sequence[str], low: int, high: int, step: int, tasks: int):
        self.path, self.column, self.names = path, column, list(names)
        self.low, self.high, self.step, self.tasks = low, high, step, tasks
        self.at = low

    def initialOffset(self) -> dict:
        return {"next": self.low}

    def latestOffset(self) -> dict:
        self.at = min(self.at + self.step, self.high)
        return {"next": self.at}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        first, last = start["next"], end["next"]
        self.at = max(self.at, last)  # a restarted query asks for the ranges of its log first
        width = max(1, -(-(last - first) // self.tasks))
        return [Range(low, min(low + width, last)) for low in range(first, last, width)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        wanted = (pc.field(self.column) >= partition.low) & (pc.field(self.column) < partition.high)
        for batch in _dataset(self.path).to_batches(columns=self.names, filter=wanted):
            if len(batch):
                yield batch

    def commit(self, end: dict) -> None:
        """Nothing is held for what is done: the table stays."""


class Replay(DataSource):
    """Options: path, column, low, high (one beyond the last value), step, tasks, and the schema as JSON."""

    @classmethod
    def name(cls) -> str:
        return "rillstone-replay"

    def schema(self) -> str:
        return self.options["ddl"]

    def streamReader(self, schema) -> ReplayReader:
        o = self.options
        return ReplayReader(o["path"], o["column"], json.loads(o["names"]), *(int(o[n]) for n in ("low", "high", "step", "tasks")))


def replay(spark: SparkSession, path: str, column: str, columns: Sequence[str], batches: int = 8, tasks: int | None = None) -> DataFrame:
    """The parquet table at `path` as a stream in the order of the integer `column`, over about so many micro-batches.

    Spark reads the bounds of the column; rows without a value are left out.  The path must be one that pyarrow opens.
    Columns are passed on as they are stored.
    """
    table = spark.read.parquet(path)
    low, high = table.selectExpr(f"min(`{column}`)", f"max(`{column}`)").first()
    low, high = (0, 0) if low is None else (low, high + 1)
    fields = table.select(*columns).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return custom(
        spark, Replay, True, path=path, column=column, names=json.dumps(list(columns)), ddl=ddl, low=str(low), high=str(high),
        step=str(max(1, -(-(high - low) // batches))), tasks=str(tasks or spark.sparkContext.defaultParallelism),
    )
