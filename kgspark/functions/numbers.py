"""Averages and rounding that don't depend on the order of rows or on binary fractions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean(value: Column) -> Column:
    """Average, added up in decimals."""
    return F.avg(value.cast("decimal(20,10)")).cast("double")


def rounded(value: Column, places: int) -> Column:
    """Half up, of the value to nine places."""
    return F.round(value.cast("decimal(28,9)"), places).cast("double")
