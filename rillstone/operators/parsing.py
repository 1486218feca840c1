"""Delimited lines to typed columns, strictly or with a reject side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rillstone.functions.text import fields, whole_number

TRANSACTION = {  # fixed layout of a transaction line
    "txn_id": "string",
    "amount": "int",
    "currency": "string",
    "source": "string",
    "destination": "string",
    "ts": "bigint",
}

_WHOLE = {"tinyint", "smallint", "int", "bigint"}


def _split_once(df: DataFrame, line: str, separator: str) -> DataFrame:
    """Adds the fields as `_parts`; the generator keeps the optimizer from repeating the split per use."""
    return df.select(*df.columns, F.explode(F.array(fields(F.col(line), separator))).alias("_parts"))


def pick(df: DataFrame, line: str, layout: Mapping[str, tuple[int, str]], separator: str = ",") -> DataFrame:
    """Columns by position: `layout` maps a name to (index, type); other columns are kept.

    A field that does not parse fails the query, as a strict reader does.
    """
    keep = [c for c in df.columns if c != line]
    part = F.col("_parts")
    return _split_once(df, line, separator).select(*keep, *[part[i].cast(t).alias(n) for n, (i, t) in layout.items()])


def _parsed(part: Column, kind: str) -> Column:
    if kind == "string":
        return part
    return whole_number(part, kind) if kind in _WHOLE else part.try_cast(kind)


def _checked(df: DataFrame, line: str, layout: Mapping[str, str], separator: str) -> DataFrame:
    values = {n: _parsed(F.get(F.col("_parts"), i), t) for i, (n, t) in enumerate(layout.items())}
    reason = F.when(~F.size("_parts").eqNullSafe(F.lit(len(layout))), F.lit("column count"))
    for name, kind in layout.items():
        if kind != "string":
            reason = reason.when(values[name].isNull(), F.lit(f"bad {name}"))
    return _split_once(df, line, separator).select(
        *df.columns, F.struct(*[v.alias(n) for n, v in values.items()]).alias("_row"), reason.alias("_reason")
    )


def parse(df: DataFrame, line: str, layout: Mapping[str, str] = TRANSACTION, separator: str = ",") -> DataFrame:
    """The lines that have exactly the layout's fields, typed; all others are left out."""
    keep = [c for c in df.columns if c != line]
    return _checked(df, line, layout, separator).filter("_reason IS NULL").select(*keep, "_row.*")


def rejects(df: DataFrame, line: str, layout: Mapping[str, str] = TRANSACTION, separator: str = ",") -> DataFrame:
    """The lines `parse` leaves out, with the first reason found."""
    return _checked(df, line, layout, separator).filter("_reason IS NOT NULL").select(
        *df.columns, F.col("_reason").alias("reason")
    )


def as_line(df: DataFrame, columns: Sequence[str], separator: str = ",", name: str = "value") -> DataFrame:
    """Render columns as one delimited text line."""
    return df.select(F.concat_ws(separator, *[F.col(c).cast("string") for c in columns]).alias(name))
