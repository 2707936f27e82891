"""Filters and guards: F1 funded_only, F3 min_rows_guard, C15 validate_requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venturelens.schema import CORRUPT_RECORD, MIN_FUNDED_ROWS, YearBounds


class NotEnoughRows(ValueError):
    """Raised when training input is below the minimum row count."""


def funded_only(df: DataFrame, col: str = "funding") -> DataFrame:
    """rows with positive funding."""
    return df.where(F.col(col) > 0)


def min_rows_guard(df: DataFrame, n: int = MIN_FUNDED_ROWS,
                   what: str = "funded examples") -> DataFrame:
    """refuse fewer than ``n`` rows; reads at most ``n`` rows to decide."""
    have = df.limit(n).count()
    if have < n:
        raise NotEnoughRows(f"Not enough {what} to train a model: {have} < {n}")
    return df


def rejection_reason(bounds: YearBounds | None = None) -> Column:
    """Null when the request is valid, else the first failed rule.

    All three fields must be present and non-empty (a zero year counts as
    missing, like a falsy form value); the year window is optional.
    """
    b = bounds or YearBounds()
    year = F.col("founding_year")
    reason = (F.when(F.col("user_idea").isNull() | (F.col("user_idea") == ""), F.lit("missing idea"))
              .when(F.col("user_city").isNull() | (F.col("user_city") == ""), F.lit("missing city"))
              .when(year.isNull() | (year == 0), F.lit("missing year")))
    if b.min_year is not None:
        reason = reason.when(year < b.min_year, F.lit("year before window"))
    if b.max_year is not None:
        reason = reason.when(year > b.max_year, F.lit("year after window"))
    return reason


def validate_requests(requests: DataFrame, bounds: YearBounds | None = None) -> DataFrame:
    """Every request with ``is_valid`` and ``reason`` columns; a malformed line is rejected first."""
    r = rejection_reason(bounds)
    if CORRUPT_RECORD in requests.columns:
        r = F.when(F.col(CORRUPT_RECORD).isNotNull(), F.lit("malformed record")).otherwise(r)
    return requests.withColumn("reason", r).withColumn("is_valid", F.col("reason").isNull())


def split_requests(requests: DataFrame, bounds: YearBounds | None = None):
    """(valid, rejected) frames."""
    v = validate_requests(requests, bounds)
    return (v.where("is_valid").drop("is_valid", "reason", CORRUPT_RECORD), v.where("NOT is_valid").drop("is_valid"))
