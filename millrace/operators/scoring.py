"""Scores of supplier part numbers. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import DATE_SHAPE, ISO_DATE_SHAPE, QUANTITY_SHAPE, SCORE_BAD
from millrace.sources.config import Weights


def hard_reject(token: Column) -> Column:
    """The reason for which a token is no part number at all, or null."""
    t = F.trim(F.coalesce(token, F.lit("")))
    return F.when(t == "", "empty_token").when(t.rlike(DATE_SHAPE) | t.rlike(ISO_DATE_SHAPE), "date_shaped").when(t.rlike(QUANTITY_SHAPE), "quantity_shaped")


def clean_token_ratio(token: Column) -> Column:
    """Share of blank-separated pieces that look like parts of a part number."""
    pieces = F.split(F.trim(token), r"\s+")
    clean = F.filter(pieces, lambda p: p.rlike(r"""^[\p{L}\p{N}\-_/.#"']+$""") & ~(p.rlike(r"\p{Ll}") & ~p.rlike(r"\p{Lu}")))
    return F.size(clean).cast("double") / F.size(pieces)


def weighted_confidence(token: Column, w: Weights = Weights()) -> Column:  # noqa: B008  frozen
    t = F.trim(token)
    d = lambda x: F.lit(float(x))
    score = F.when(F.length(t).between(w.length_min, w.length_max), d(w.length_in_range_reward)).otherwise(d(w.length_out_of_range_penalty))
    blanks = F.regexp_count(t, F.lit(r"\s")).cast("double")
    score = score + F.when((blanks > 0) & (clean_token_ratio(token) < w.whitespace_clean_token_ratio_threshold), d(w.whitespace_penalty_per_char) * blanks).otherwise(d(0))
    score = score + F.when(t.rlike(r"\p{Ll}"), d(w.lowercase_penalty)).otherwise(d(0))
    score = score + d(w.bad_punct_penalty_per_char) * F.regexp_count(t, F.lit(SCORE_BAD)).cast("double")
    score = score + F.when(t.rlike("^[A-Za-z0-9]") & t.rlike("[A-Za-z0-9]$"), d(w.boundary_alnum_reward)).otherwise(d(0))
    return F.greatest(d(0), F.least(d(1), score))


def scored(rows: DataFrame, token: str = "token", pattern: str = "pattern", weights: Weights = Weights()) -> DataFrame:  # noqa: B008  frozen
    """rows with confidence, reason and is_internal. The id pattern is informative and rejects nothing."""
    hard = hard_reject(F.col(token))
    sure = F.when(hard.isNotNull(), F.lit(0.0)).otherwise(weighted_confidence(F.col(token), weights))
    # sums of tenths are compared as such, not by their last bits
    reason = F.coalesce(hard, F.when(F.col("confidence") < weights.min_confidence, "below_min_confidence"))
    internal = F.coalesce(F.expr(f"trim({token}) rlike {pattern}"), F.lit(False)) & (F.trim(F.coalesce(F.col(token), F.lit(""))) != "")
    return rows.withColumn("confidence", sure).withColumns({"reason": reason, "is_internal": internal})


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("reason").isNull())
