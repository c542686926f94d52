"""Discovery of a document's own part number pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import FALLBACK_ID, is_id_candidate, shape_pattern, token_shape

from .geometry import span_contains
from .lines import PAGE

MIN_SHARE, MIN_RATE = 0.05, 0.80


def pool_id_tokens(words: DataFrame, layouts: DataFrame, bands: DataFrame) -> DataFrame:
    """doc_id, page, word_id, token: body words whose centre lies in the identifier band (an equi-join on the page, then a range)."""
    band = bands.filter(F.col("column") == "part_identifier").select(*PAGE, "x_min", "x_max")
    body = words.join(layouts.select(*PAGE, "body_y_top"), PAGE).join(band, PAGE)
    center = (F.col("x0") + F.col("x1")) / 2
    return body.filter(span_contains(center, F.col("x_min"), F.col("x_max")) & (F.col("top") >= F.col("body_y_top"))).select(*PAGE, "word_id", F.col("text").alias("token"))


def candidates(tokens: DataFrame) -> DataFrame:
    """tokens (doc_id, seq, token) that may be part numbers."""
    return tokens.withColumn("token", F.trim("token")).filter(is_id_candidate(F.col("token")))


def shape_frequencies(found: DataFrame, share: float = MIN_SHARE) -> DataFrame:
    """doc_id, shape, n, first_seq of the shapes with enough tokens."""
    shapes = found.groupBy("doc_id", token_shape(F.col("token")).alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
    return shapes.withColumn("total", F.sum("n").over(Window.partitionBy("doc_id"))).filter(F.col("n") / F.col("total") >= share).drop("total")


def synthesized(shapes: DataFrame) -> DataFrame:
    """doc_id, pattern, shapes: the union of the shapes' expressions, most frequent first."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "first_seq", "shape")))
    ordered = shapes.groupBy("doc_id").agg(rows.alias("rows"))
    branch = F.array_distinct(F.transform("rows", lambda r: shape_pattern(r["shape"])))
    return ordered.select("doc_id", F.concat(F.lit("^("), F.array_join(branch, "|"), F.lit(")$")).alias("pattern"), F.array_join(F.transform("rows", lambda r: r["shape"]), "|").alias("shapes"))


def discovered(documents: DataFrame, tokens: DataFrame, share: float = MIN_SHARE, rate: float = MIN_RATE) -> DataFrame:
    """doc_id, pattern, shapes, match_rate, fallback for every document, with the permissive pattern where none is sure."""
    found = candidates(tokens)
    made = synthesized(shape_frequencies(found, share))
    rates = found.join(made, "doc_id").groupBy("doc_id").agg((F.sum(F.expr("token rlike pattern").cast("int")) / F.count(F.lit(1))).alias("rate"))
    both = documents.select("doc_id").join(made, "doc_id", "left").join(rates, "doc_id", "left")
    sure = F.coalesce(F.col("rate") >= rate, F.lit(False))
    return both.select("doc_id", F.when(sure, F.col("pattern")).otherwise(FALLBACK_ID).alias("pattern"), F.when(sure, F.col("shapes")).otherwise("").alias("shapes"), F.coalesce("rate", F.lit(0.0)).alias("match_rate"), (~sure).alias("fallback"))
