"""Routing rows of one frame to named outputs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def tagged(df: DataFrame, routes: Mapping[str, Column], otherwise: str, name: str = "tag") -> DataFrame:
    """Adds the name of the first route whose condition holds; null conditions do not hold."""
    tag = None
    for route, condition in routes.items():
        tag = F.when(condition, route) if tag is None else tag.when(condition, route)
    return df.withColumn(name, tag.otherwise(otherwise))


def parity(df: DataFrame, column: str) -> DataFrame:
    return tagged(df, {"even": F.col(column) % 2 == 0}, "odd")


def speed_classes(df: DataFrame, column: str, normal_up_to: float = 60, minor_up_to: float = 80) -> DataFrame:
    """normal, minor or major by two upper limits, both inclusive."""
    return tagged(
        df, {"normal": F.col(column) <= normal_up_to, "minor": F.col(column) <= minor_up_to}, "major"
    )


def route(df: DataFrame, tag: str, name: str = "tag") -> DataFrame:
    """One output of a tagged frame."""
    return df.filter(F.col(name) == tag).drop(name)
