"""Static sources: parquet tables, text lines, delimited files, declared CSV tables and JSON columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rillstone.session import use_utc


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table `<folder>/<name>.parquet`, a file or a folder of part files."""
    return use_utc(spark).read.parquet(f"{folder}/{name}.parquet")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per text line, in a column `value`."""
    return spark.read.text(path)


def delimited(spark: SparkSession, path: str, schema: str | T.StructType, separator: str = ",") -> DataFrame:
    """Delimited file without header; a malformed row fails the read."""
    return spark.read.schema(schema).option("sep", separator).option("mode", "FAILFAST").csv(path)


def csv_table(spark: SparkSession, name: str, columns: str, path: str) -> DataFrame:
    """Declare a CSV file as the temporary view `name` and return it; a malformed row fails the read."""
    quoted = path.replace("'", "\\'")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW `{name}` ({columns}) USING csv OPTIONS (path '{quoted}', mode 'FAILFAST')")
    return spark.table(name)


def rows(spark: SparkSession, values: Sequence, schema: str | T.StructType) -> DataFrame:
    """A small in-memory collection."""
    return spark.createDataFrame(values, schema)


def sequence(spark: SparkSession, first: int, last: int, name: str = "value") -> DataFrame:
    """The integers from `first` to `last`, both included."""
    return spark.range(first, last + 1).withColumnRenamed("id", name)


def json_fields(df: DataFrame, column: str, schema: str | T.StructType) -> DataFrame:
    """Expand a JSON text column by a declared schema; fields that do not fit are null."""
    keep = [c for c in df.columns if c != column]
    return df.select(*keep, F.from_json(column, schema).alias("_json")).select(*keep, "_json.*")
