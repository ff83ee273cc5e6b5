"""Scalar expressions on result and score rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_seconds(interval: str | Column) -> Column:
    """Day-time interval to seconds with fractions; null stays null."""
    col = F.col(interval) if isinstance(interval, str) else interval
    return col.cast("interval second").cast("decimal(20,6)").cast("double")


def session_key(year: Column, round_number: Column, identifier: Column) -> Column:
    """Name of a session, e.g. `2001_03_R`; null if any part is null."""
    key = F.format_string("%d_%02d_%s", year, round_number, identifier)
    return F.when(year.isNotNull() & round_number.isNotNull() & identifier.isNotNull(), key)


def mode_identifier(mode: Column) -> Column:
    """The one-letter session identifier."""
    # R and S stand for the two session modes.
    return F.when(mode == "Race", "R").when(mode == "Sprint", "S")


def format_color(color: Column) -> Column:
    """`#rrggbb` in lower case; white where there is none."""
    text = F.lower(color)
    return F.when(color.isNull(), "#ffffff").when(color.startswith("#"), text).otherwise(F.concat(F.lit("#"), text))


def composite_id(*parts: Column) -> Column:
    """Parts joined by `_`; null if any part is null."""
    joined: list[Column] = []
    for part in parts:
        joined += [F.lit("_"), part.cast("string")]
    return F.concat(*joined[1:])
