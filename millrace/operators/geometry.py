"""Measures and predicates of boxes, spans and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bbox_measures(words: DataFrame) -> DataFrame:
    return words.withColumns({"width": F.col("x1") - F.col("x0"), "height": F.col("bottom") - F.col("top"), "x_center": (F.col("x0") + F.col("x1")) / 2})


def span_contains(x: Column, x_min: Column, x_max: Column) -> Column:
    """Closed at both ends."""
    return x.between(x_min, x_max)


def span_overlaps(x0: Column, x1: Column, x_min: Column, x_max: Column) -> Column:
    """Open at both ends."""
    return (x1 > x_min) & (x0 < x_max)


def span_width(x_min: Column, x_max: Column) -> Column:
    return x_max - x_min


def line_center(y_top: Column, y_bottom: Column) -> Column:
    return (y_top + y_bottom) / 2


def column_rank(order: Column, name: Column) -> Column:
    """0-based place in the array of columns; null if missing."""
    return F.nullif(F.array_position(order, name), F.lit(0).cast("long")) - 1
