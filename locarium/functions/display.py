"""Displayed figures: half-even rounding of the exact binary value, as the text that statements are checked against."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain(value: Column, digits: int) -> Column:
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def distance(metres: Column) -> Column:
    """Metres below 1000, else kilometres with one decimal; null is none mapped."""
    return F.when(metres.isNull(), "none mapped").when(metres < 1000, F.concat(_plain(metres, 0), F.lit(" m"))).otherwise(F.concat(_plain(metres / 1000, 1), F.lit(" km")))


def people(value: Column) -> Column:
    return F.format_number(value, 0)


def one_decimal(value: Column) -> Column:
    return _plain(value, 1)


def ratio(value: Column) -> Column:
    return _plain(value, 2)


def percent(share: Column, digits: int = 0) -> Column:
    return F.concat(_plain(share * 100, digits), F.lit("%"))


def kilometres(metres: Column) -> Column:
    """Kilometres without trailing zeros."""
    return F.concat(F.regexp_replace(F.regexp_replace(_plain(metres / 1000, 3), r"0+$", ""), r"\.$", ""), F.lit(" km"))
