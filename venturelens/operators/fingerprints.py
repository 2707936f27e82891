"""Counting equal rows by fingerprint instead of by their whole values.

Grouping by long texts sends every text through the exchange as a key.  Here
rows are first counted by a 128-bit fingerprint, together with the least and the
greatest SHA-256 of their values: a row costs a few numbers, and no value is
shuffled however many rows are equal.  Where these two differ, values collide under one
fingerprint: of such fingerprints alone the values are fetched and counted by themselves,
so the result is right whatever the fingerprint, as long as no two values share fingerprint and SHA-256.

Null equals null.  An empty table has no groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venturelens.session import discard, written

Hashed = Callable[[list[Column]], tuple[Column, Column]]


def fingerprint(cols: list[Column]) -> tuple[Column, Column]:
    """Two 64-bit hashes of the values and of which of them are null."""
    nulls = F.concat(*[F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cols])
    return F.xxhash64(*cols, nulls), F.xxhash64(F.lit(1), *cols, nulls)


#: Digits of a number that a long holds, so that aggregates keep digests in numbers.
_DIGITS = 15
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _digest(cols: list[Column]) -> Column:
    """SHA-256 of the values (null is unlike any value) as an array of longs."""
    record = F.to_json(F.struct(*[c.alias(f"v{i}") for i, c in enumerate(cols)]), _TIMES)
    return F.transform(F.array(*[F.lit(at) for at in range(1, 65, _DIGITS)]), lambda at: F.conv(
        F.substring(F.sha2(record, 256), at, F.lit(_DIGITS)), 16, 10).cast("long"))


def fingerprinted(df: DataFrame, by: list[str], cols: list[str], hashed: Hashed = fingerprint) -> DataFrame:
    """``by``, ``cols`` and the fingerprint (_a, _b) of ``cols``."""
    a, b = hashed([F.col(c) for c in cols])
    return df.select(*by, *cols, a.alias("_a"), b.alias("_b"))


def prefix(text: Column) -> Column:
    """The first seven bytes of a text as a long, in the order of the texts (texts of one prefix are equal in it)."""
    return F.conv(F.rpad(F.hex(F.substring(text.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")


def group_counts(rows: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """(``by``, _a, _b, n, value) for every distinct (``by``, ``cols``) of ``fingerprinted`` rows; ``by`` is never null.

    ``value`` is the struct of ``cols`` where the fingerprint
    belongs to several values, else null: whoever needs the values of some groups joins the rows back by fingerprint.
    """
    return group_starts(rows, by, cols).drop("first")


def group_starts(rows: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """``group_counts`` with ``first``, the ``prefix`` of the first of ``cols`` as text."""
    key = [*by, "_a", "_b"]
    kind = F.struct(*cols)
    parts = range(-(-64 // _DIGITS))
    start = prefix(F.col(cols[0]).cast("string"))
    seen = rows.select(*key, start.alias("_p"), _digest([F.col(c) for c in cols]).alias("_d"))
    seen = seen.select(*key, "_p", *[F.col("_d")[i].alias(f"_d{i}") for i in parts])
    ends = [F.min(f"_d{i}").alias(f"_lo{i}") for i in parts] + [F.max(f"_d{i}").alias(f"_hi{i}") for i in parts]
    differ = F.lit(False)
    for i in parts:
        differ |= F.col(f"_lo{i}") != F.col(f"_hi{i}")
    counts = written(seen.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("_p").alias("first"), *ends)
                     .select(*key, "n", "first", differ.alias("_mixed")), "fingerprints")
    mixed = written(counts.where("_mixed").select(*key), "collisions")
    counts = counts.drop("_mixed")
    none = F.lit(None).cast(rows.select(kind.alias("v")).schema["v"].dataType)
    if mixed.isEmpty():
        discard(mixed)
        return counts.withColumn("value", none)
    own = (rows.join(mixed, key, "left_semi").groupBy(*key, kind.alias("value")).agg(F.count(F.lit(1)).alias("n"))
           .select(*key, "n", prefix(F.col("value")[cols[0]].cast("string")).alias("first"), "value"))
    return counts.join(mixed, key, "left_anti").select(*key, "n", "first", none.alias("value")).unionByName(own)
