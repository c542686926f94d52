"""Grouping of words into physical lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]
LINE = ["doc_id", "page", "line_no"]


def y_tolerance(words: DataFrame, ratio: float = 0.4, fallback: float = 3.0) -> DataFrame:
    """doc_id, page, tol: a share of the median distance of distinct tops further apart than half a point."""
    tops = words.select(*PAGE, F.round("top", 2).alias("t")).distinct()
    steps = tops.withColumn("d", F.col("t") - F.lag("t").over(Window.partitionBy(*PAGE).orderBy("t")))
    return steps.groupBy(*PAGE).agg(F.coalesce(F.median(F.when(F.col("d") > 0.5, F.col("d"))) * ratio, F.lit(fallback)).alias("tol"))


def line_numbers(words: DataFrame, tolerance: DataFrame | None = None) -> DataFrame:
    """doc_id, page, top, line_no. A top joins the line if it is within the tolerance of the line's *first* top, so this is a fold in
    order; it runs over the distinct tops of a page, which are few."""
    tops = words.groupBy(*PAGE).agg(F.array_sort(F.collect_set("top")).alias("tops")).join(tolerance if tolerance is not None else y_tolerance(words), PAGE)
    kind = "array<struct<top:double,line_no:int>>"
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("n"), F.array().cast(kind).alias("out"))

    def step(acc, top):
        new = acc["anchor"].isNull() | (top - acc["anchor"] > F.col("tol"))
        n = acc["n"] + new.cast("int")
        return F.struct(F.when(new, top).otherwise(acc["anchor"]).alias("anchor"), n.alias("n"), F.concat(acc["out"], F.array(F.struct(top.alias("top"), n.alias("line_no")))).alias("out"))

    return tops.select(*PAGE, F.explode(F.aggregate("tops", start, step, lambda acc: acc["out"])).alias("e")).select(*PAGE, "e.top", "e.line_no")


def line_words(words: DataFrame) -> DataFrame:
    """words with line_no and pos, the 0-based place in the line from left to right."""
    order = Window.partitionBy(*LINE).orderBy("x0", "top", "word_id")
    return words.join(line_numbers(words), [*PAGE, "top"]).withColumn("pos", F.row_number().over(order) - 1)


def lines(placed: DataFrame) -> DataFrame:
    """doc_id, page, line_no, y_top, y_bottom, n_words."""
    return placed.groupBy(*LINE).agg(F.min("top").alias("y_top"), F.max("bottom").alias("y_bottom"), F.count(F.lit(1)).cast("int").alias("n_words"))
