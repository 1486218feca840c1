"""Streaming sources: folders of line or parquet files, message topics, a rate source and user-defined ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource

from rillstone.session import use_utc


def line_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Lines of the files that arrive in a folder; replayable, and read by all executors."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(folder)


def delimited_stream(
    spark: SparkSession, folder: str, schema: str | T.StructType, separator: str = ",", max_files: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("sep", separator)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.csv(folder)


def table_stream(spark: SparkSession, folder: str, name: str, max_files: int | None = None) -> DataFrame:
    """The parquet table `<folder>/<name>.parquet`, a file or a folder, as a stream with its own schema."""
    schema = use_utc(spark).read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # a pattern makes the folder listing match a single file as well
    return reader.parquet(f"{folder}/{name}.parque[t]")


def topic_options(servers: str, topic: str, group: str | None = None, starting: str = "earliest") -> dict[str, str]:
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting}
    if group:
        options["kafka.group.id"] = group
    return options


def topic_stream(spark: SparkSession, servers: str, topic: str, group: str | None = None, starting: str = "earliest") -> DataFrame:
    """Message values of a Kafka topic as text in `value`; needs Spark's Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").options(**topic_options(servers, topic, group, starting))
    return message_values(reader.load())


def message_values(messages: DataFrame) -> DataFrame:
    return messages.select(F.col("value").cast("string").alias("value"))


def key_value_stream(spark: SparkSession, rows_per_batch: int, partitions: int, keys: list[str]) -> DataFrame:
    """Events (key, value) from Spark's micro-batch rate source."""
    ticks = (
        spark.readStream.format("rate-micro-batch")
        .option("rowsPerBatch", rows_per_batch)
        .option("numPartitions", partitions)
        .load()
    )
    key = F.element_at(F.array(*[F.lit(k) for k in keys]), (F.col("value") % len(keys) + 1).cast("int"))
    return ticks.select("timestamp", key.alias("key"), (F.col("value") % 100).cast("int").alias("value"))


def custom(spark: SparkSession, source: type[DataSource], streaming: bool = False, **options: str) -> DataFrame:
    """Register a user-defined source class and read it; Spark runs its partitions on the executors."""
    spark.dataSource.register(source)
    reader = spark.readStream if streaming else spark.read
    return reader.format(source.name()).options(**options).load()
