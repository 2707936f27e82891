"""Rows counted by fingerprint equal rows counted by value, also where fingerprints collide."""
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from venturelens.operators.fingerprints import fingerprint, fingerprinted, group_counts
from venturelens.operators.profile import describe_texts, duplicate_rows

ROWS = ([("aa", None, 1), (None, "aa", 1), ("aa", None, 1), ("bb", "x", 2), ("cc", "x", 2), ("cc", "x", 2), (None, None, None),
         (None, None, None), ("", "", 0), ("long " * 9000, "x", 3), ("long " * 9000 + "er", "x", 3)] + [("hot", "hot", 9)] * 40)


def by_length(cols):
    """Everything of one length collides."""
    return sum((F.coalesce(F.length(c.cast("string")), F.lit(0)) for c in cols), F.lit(0)).cast("bigint"), F.lit(0).cast("bigint")


def constant(cols):
    return F.lit(7).cast("bigint"), F.lit(7).cast("bigint")


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "s string, t string, n int").repartition(5)


@pytest.mark.parametrize("hashed", [fingerprint, by_length, constant])
def test_duplicates_and_texts_whatever_the_hash(spark, df, hashed):
    assert duplicate_rows(df, hashed=hashed).first()[0] == sum(c - 1 for c in Counter(ROWS).values())
    assert duplicate_rows(df.limit(0), hashed=hashed).first()[0] == 0
    assert duplicate_rows(df.select("s").distinct(), hashed=hashed).first()[0] == 0
    got = {(r.column, r.stat): r.num_value if r.text_value is None else r.text_value
           for r in describe_texts(df, ["s", "t"], hashed).collect()}
    for i, c in enumerate("st"):
        counts = Counter(r[i] for r in ROWS if r[i] is not None)
        freq = max(counts.values())
        assert got[c, "count"] == sum(counts.values()) and got[c, "unique"] == len(counts) and got[c, "freq"] == freq
        assert got[c, "top"] == min(v for v, n in counts.items() if n == freq)


@pytest.mark.parametrize("hashed", [fingerprint, constant])
def test_top_of_ties_and_of_values_that_occur_once(spark, hashed):
    df = spark.createDataFrame([("b", "q"), ("a", "q"), ("c", "p"), ("d", "p"), (None, "r")], "once string, tied string").withColumn("none", F.lit(None).cast("string"))
    got = {(r.column, r.stat): r.num_value if r.text_value is None else r.text_value
           for r in describe_texts(df, ["once", "tied", "none"], hashed).collect()}
    assert (got["once", "top"], got["once", "freq"], got["tied", "top"], got["tied", "freq"]) == ("a", 1, "p", 2)
    assert not any(c == "none" for c, _ in got) and describe_texts(df.limit(0), ["once"], hashed).count() == 0


def test_no_text_in_an_exchange_key(df):
    """The grouping shuffles two numbers a row; texts are not even read into it."""
    rows = fingerprinted(df, [], ["s", "t"])
    plan = rows.groupBy("_a", "_b").count()._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert keys and all(re.fullmatch(r"(_[ab]#\d+L?, )*\d+", k) for k in keys)
    got = group_counts(rows, [], ["s", "t"])
    assert set(got.columns) == {"_a", "_b", "n", "value"} and got.where("value IS NOT NULL").count() == 0
