"""Column expressions for catalog cleaning and display.

All of these are plain Catalyst expressions: they run inside whole-stage
codegen next to the scan and never cross into Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from venturelens.schema import (
    COPY_LABEL, INTEGER_PATTERN, NO_FUNDING_TEXT, NULL_TOKENS, NUMBER_PATTERN,
    RATE_JOINER, UNIQUE_LABEL,
)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def null_tokens_to_null(col: Column | str) -> Column:
    """Text a CSV reader would read as missing becomes null."""
    c = _c(col)
    return F.when(c.isin(*NULL_TOKENS), F.lit(None).cast("string")).otherwise(c)


def fill_text(col: Column | str, default: str | None) -> Column:
    """Default text for a missing value."""
    c = _c(col)
    return c if default is None else F.coalesce(c, F.lit(default))


def guarded_double(text: Column) -> Column:
    """Text to double under the shared number grammar, else null."""
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def coerce_number(col: Column | str) -> Column:
    """Text to number; anything outside the grammar, or null, is 0."""
    c = _c(col).cast("string")
    return F.coalesce(guarded_double(c), F.lit(0.0))


def clean_currency(col: Column | str) -> Column:
    """Strip ``$`` and ``,`` then C3."""
    return coerce_number(F.regexp_replace(_c(col).cast("string"), "[$,]", ""))


def first_integer(col: Column | str) -> Column:
    """C4: the first run of digits as a number, else 0."""
    digits = F.regexp_extract(_c(col).cast("string"), "([0-9]+)", 1)
    return F.coalesce(digits.try_cast("double"), F.lit(0.0))


def sentinel_to_null(col: Column | str, sentinel: str = "None") -> Column:
    """One sentinel text becomes null."""
    return F.nullif(_c(col), F.lit(sentinel))


def _guarded_int(text: Column) -> Column:
    return F.when(text.rlike(INTEGER_PATTERN), F.trim(text).try_cast("double"))


def range_midpoint(col: Column | str) -> Column:
    """``a-b`` -> (a+b)/2, a plain number -> itself, else null."""
    c = _c(col).cast("string")
    parts = F.split(c, "-")
    lo = _guarded_int(F.get(parts, 0))
    hi = _guarded_int(F.get(parts, 1))
    return (F.when(F.instr(c, "-") > 0, (lo + hi) / 2.0)
            .otherwise(guarded_double(c)))


def list_count(col: Column | str) -> Column:
    """Number of comma separated items; a missing value counts as one."""
    return F.size(F.split(F.coalesce(_c(col), F.lit("nan")), ",")).cast("bigint")


def short_industry(col: Column | str) -> Column:
    """First two comma items joined by a space."""
    return F.array_join(F.slice(F.split(_c(col), ","), 1, 2), " ")


def log_target(col: Column | str) -> Column:
    """log1p."""
    return F.log1p(_c(col))


def inverse_target(col: Column | str, transform: Column | str | None) -> Column:
    """expm1 when the metadata names log1p, else identity."""
    t = F.lit(transform) if transform is None or isinstance(transform, str) else transform
    return F.when(t == F.lit("log1p"), F.expm1(_c(col))).otherwise(_c(col))


def format_currency(col: Column | str) -> Column:
    """``$`` and thousands separators, no decimals; ``N/A`` if missing."""
    c = _c(col)
    return F.when(c.isNull(), F.lit(NO_FUNDING_TEXT)).otherwise(
        F.concat(F.lit("$"), F.format_number(c, 0)))


def funding_rate_label(n: Column | str, k: Column | str | int) -> Column:
    """``n out of k``."""
    kk = F.lit(k) if isinstance(k, int) else _c(k)
    return F.concat(_c(n).cast("string"), F.lit(RATE_JOINER), kk.cast("string"))


def verdict_label(is_copy: Column | str) -> Column:
    """C14: copy flag to the risk label."""
    return F.when(_c(is_copy), F.lit(COPY_LABEL)).otherwise(F.lit(UNIQUE_LABEL))


def percent_label(confidence: Column | str) -> Column:
    """C14: a 0-1 value as a whole percent."""
    return F.concat(F.round(_c(confidence) * 100, 0).cast("bigint").cast("string"),
                    F.lit("%"))
