"""Edge tables for the cleaning expressions."""
import pytest
from pyspark.sql import functions as F

from venturelens.functions import cleaning as C
from venturelens.operators.guards import validate_requests


def one(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_clean_currency(spark):
    vals = ["$1,000", "0", "5M", "undisclosed", None, " 7 ", "+4", "-3", "1e6", "inf", "nan", "1d", "1_000",
            "0x10", "(5)", "", ".5"]
    got = one(spark, vals, C.clean_currency)
    assert got == [1000.0, 0.0, 0.0, 0.0, 0.0, 7.0, 4.0, -3.0, 1e6, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5]


def test_first_integer(spark):
    assert one(spark, ["1,000+", "11-50", "-5", None, "None", "abc"], C.first_integer) == [1, 11, 5, 0, 0, 0]


def test_range_midpoint(spark):
    got = one(spark, ["11-50", "51 - 100", "1000+", "1-2-3", "-5", "a-b", "7", None], C.range_midpoint)
    assert got == [30.5, 75.5, None, 1.5, None, None, 7.0, None]


def test_sentinel_and_list_count(spark):
    assert one(spark, ["None", "x", None], C.sentinel_to_null) == [None, "x", None]
    assert one(spark, ["a,,b", "", None, "a,", "a"], C.list_count) == [3, 1, 1, 2, 1]


def test_short_industry(spark):
    assert one(spark, ["A,B,C", "A", None], C.short_industry) == ["A B", "A", None]


def test_format_currency_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (1234567.0,), (-1234.0,), (None,)], "x double")
    got = [r[0] for r in df.select(C.format_currency("x")).collect()]
    assert got == ["$0", "$2", "$2", "$1,234,567", "$-1,234", "N/A"]


def test_percent_and_labels(spark):
    df = spark.createDataFrame([(0.6, True), (0.375, False)], "c double, b boolean")
    got = df.select(C.percent_label("c"), C.verdict_label("b"), C.funding_rate_label(F.lit(3), 5)).collect()
    assert [tuple(r) for r in got] == [("60%", "High 'Copycat' Risk", "3 out of 5"),
                                       ("38%", "Looks Unique!", "3 out of 5")]


def test_validate_requests(spark):
    df = spark.createDataFrame(
        [(1, "idea", "city", 2025), (2, None, "city", 2025), (3, "idea", "", 2025), (4, "idea", "c", 0)],
        "idea_id long, user_idea string, user_city string, founding_year int")
    got = {r.idea_id: r.reason for r in validate_requests(df).collect()}
    assert got == {1: None, 2: "missing idea", 3: "missing city", 4: "missing year"}


@pytest.mark.parametrize("text,expected", [("NA", None), ("n/a", None), ("", None), ("NAN", "NAN")])
def test_null_tokens(spark, text, expected):
    assert one(spark, [text], C.null_tokens_to_null) == [expected]
