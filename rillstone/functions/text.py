"""Text helpers: trimming, splitting and strict number parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def trim_controls(col: Column) -> Column:
    """Strip spaces and all control characters up to U+0020 from both ends."""
    return F.regexp_replace(col, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def fields(line: Column, separator: str = ",") -> Column:
    """Split on a one-character separator; trailing empty fields are dropped, inner ones kept."""
    # a plain or escaped single character is split without a regular expression
    pattern = separator if separator.isalnum() or separator in ",;: " else "\\" + separator
    return F.split(F.rtrim(line, F.lit(separator)), pattern)


def whole_number(col: Column, kind: str = "int") -> Column:
    """Strict integer: optional sign and digits within the type's range, otherwise null."""
    return F.when(col.rlike(r"\A[+-]?[0-9]+\z"), col.try_cast(kind))


def fill(template: str, *columns: str | Column) -> Column:
    """The template with each `{}` replaced by a column's text; cheaper per row than a format string."""
    texts = template.split("{}")
    pieces = [F.lit(texts[0])]
    for column, text in zip(columns, texts[1:], strict=True):
        value = (F.col(column) if isinstance(column, str) else column).cast("string")
        pieces += [F.coalesce(value, F.lit("null")), F.lit(text)]
    return F.concat(*pieces)
