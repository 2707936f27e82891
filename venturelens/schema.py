"""Schemas and fixed values.

Every constant whose value must equal the behaviour being reproduced is kept in
the "fixed values" block below, in plain text, in one place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must stay equal to the behaviour being reproduced)
# ---------------------------------------------------------------------------
# Text a CSV reader turns into a missing value (the public pandas default list).
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# Defaults for missing catalog text, per caller.
SERVING_DESCRIPTION_DEFAULT = "No description provided"
SERVING_INDUSTRY_DEFAULT = "Not specified"
TRAINING_DESCRIPTION_DEFAULT = ""
FEATURE_MISSING_TOKEN = "___missing___"
# Neighbour summary.
DEFAULT_K = 5
UNKNOWN_INDUSTRY = "Could not determine"
NO_FUNDING_TEXT = "N/A"
RATE_JOINER = " out of "
# Pair verdict defaults: no record at all, and a record missing a key.
NO_ANALYSIS_SCORE = 0.0
NO_ANALYSIS_IS_COPY = False
NO_ANALYSIS_REASONING = "Could not get AI analysis."
MISSING_REASONING = "No reasoning provided."
COPY_LABEL = "High 'Copycat' Risk"
UNIQUE_LABEL = "Looks Unique!"
# Funding prediction.
Z_95 = 1.96
#: Nominal level of the prediction interval.
INTERVAL_LEVEL = 0.95
BASELINE_CONFIDENCE = 0.6
ERROR_CONFIDENCE = 0.0
TARGET_TRANSFORM = "log1p"
FEATURE_ORDER = ("embedding", "starting_year", "founders_count",
                 "employees_count", "city_count", "industry_count")
NO_MODEL_ERROR = "No funding model found"
# Training.
MIN_FUNDED_ROWS = 10
VALIDATION_PERCENT = 20
SPLIT_SEED = 42
ENSEMBLE_MEMBERS = 5
TREES_PER_MEMBER = 200
MEMBER_SEED_BASE = 42
# Number grammar accepted by the numeric coercions (ASCII digits, spaces only).
NUMBER_PATTERN = r"^ *[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)? *$"
INTEGER_PATTERN = r"^ *[+-]?[0-9]+ *$"
# Default text encoder: ASCII word runs, md5 bucket, L2 normalised.
TOKEN_SPLIT_PATTERN = "[^A-Za-z0-9]+"
TOKEN_PATTERN = "[A-Za-z0-9]+"
ENCODER_DIM = 64
# ---------------------------------------------------------------------------


# Raw catalog: every column is text, typed in one cleaning projection.
RAW_CATALOG_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("company", T.StringType()),
    T.StructField("description_raw", T.StringType()),
    T.StructField("industries_raw", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("funding_raw", T.StringType()),
    T.StructField("funding_round", T.StringType()),
    T.StructField("starting_year_raw", T.StringType()),
    T.StructField("employees_raw", T.StringType()),
    T.StructField("founders_raw", T.StringType()),
])

# Headers of a catalog file and the raw column each one fills.
CATALOG_HEADERS = {
    "Company": "company",
    "Description": "description_raw",
    "Industries": "industries_raw",
    "City": "city",
    "Funding Amount in $": "funding_raw",
    "Funding Round": "funding_round",
    "Starting Year": "starting_year_raw",
    "Founders": "founders_raw",
    "Founders Count": "founders_count_raw",
    "No. of Employees": "employees_raw",
}
# Headers that a catalog file may lack; ``id`` may be absent as well.
OPTIONAL_HEADERS = ("Starting Year", "Founders", "Founders Count", "No. of Employees")

#: Column that holds the text of a malformed request line.
CORRUPT_RECORD = "_corrupt_record"

REQUEST_SCHEMA = T.StructType([
    T.StructField("idea_id", T.LongType()),
    T.StructField("user_idea", T.StringType()),
    T.StructField("user_city", T.StringType()),
    T.StructField("founding_year", T.IntegerType()),
])

VERDICT_SCHEMA = T.StructType([
    T.StructField("similarity_score", T.StringType()),
    T.StructField("is_copy", T.StringType()),
    T.StructField("reasoning", T.StringType()),
])

NEIGHBOUR_SCHEMA = T.StructType([
    T.StructField("idea_id", T.LongType(), False),
    T.StructField("id", T.LongType(), False),
    T.StructField("dist2", T.DoubleType(), False),
])


@dataclass(frozen=True)
class CatalogDefaults:
    """Per-caller fill values for missing text (serving by default)."""

    description: str = SERVING_DESCRIPTION_DEFAULT
    industries: str = SERVING_INDUSTRY_DEFAULT


SERVING_DEFAULTS = CatalogDefaults()
TRAINING_DEFAULTS = CatalogDefaults(description=TRAINING_DESCRIPTION_DEFAULT,
                                    industries=None)


@dataclass(frozen=True)
class YearBounds:
    """Optional founding-year window for request validation."""

    min_year: int | None = None
    max_year: int | None = None
