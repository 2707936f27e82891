"""Profiling and chart data: A4-A6, P1-P11.

Each function returns a small, plot-ready DataFrame computed by distributed
aggregates.  Where a later pass needs a scalar from an earlier one (histogram
range, KDE bandwidth) a single aggregate row is fetched; no data rows reach the
driver.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from venturelens.operators.fingerprints import Hashed, fingerprint, fingerprinted, group_counts, group_starts
from venturelens.operators.joins import computed_once
from venturelens.operators.quantiles import exact_quantiles
from venturelens.session import ensure_checkpoint_dir, written

# ---------------------------------------------------------------------------
# A4-A6 categories
# ---------------------------------------------------------------------------


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A4: frequency of each non-null value, in no order."""
    return (df.where(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias("n")))


def top_categories(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """A5: the ``n`` most frequent values with their rank (ties: smaller value first)."""
    vc = value_counts(df, col)
    w = Window.orderBy(F.desc("n"), F.asc(col))
    # TakeOrderedAndProject: each partition keeps its top n, one task merges n x partitions rows.
    top = vc.orderBy(F.desc("n"), F.asc(col)).limit(n)
    return top.withColumn("rank", F.row_number().over(w).cast("int"))


def mean_by_group_top(df: DataFrame, group: str, value: str, n: int = 10) -> DataFrame:
    """Mean of ``value`` per non-null ``group``, highest ``n`` means."""
    means = (df.where(F.col(group).isNotNull()).groupBy(group)
             .agg(F.avg(value).alias("mean_value")))
    return (means.orderBy(F.desc_nulls_last("mean_value"), F.asc(group)).limit(n)
            .select(group, F.round("mean_value", 4).alias("mean_value")))


# ---------------------------------------------------------------------------
# P1-P4 table profile
# ---------------------------------------------------------------------------


def profile_columns(df: DataFrame) -> DataFrame:
    """Dtype, rows, non-null and null count per column, in one pass."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    aggs += [F.count(F.col(c)).alias(f"nn_{i}") for i, c in enumerate(df.columns)]
    one = df.agg(*aggs)
    entries = [F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                        F.col(f"nn_{i}").alias("non_null")) for i, c in enumerate(df.columns)]
    return (one.select(F.col("__rows").alias("rows"), F.explode(F.array(*entries)).alias("e"))
            .select("e.column", "e.dtype", F.col("rows").cast("bigint").alias("rows"),
                    F.col("e.non_null").cast("bigint").alias("non_null"),
                    (F.col("rows") - F.col("e.non_null")).cast("bigint").alias("nulls")))


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def numeric_summary(df: DataFrame, cols: list[str]) -> dict[str, dict]:
    """n, mean, std, lo, hi, q1, median, q3 of each numeric column, in one aggregate and one exact quantile job.

    One record per column reaches the driver; the charts that need ranges or quartiles take it from here.
    """
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n_{i}"), F.avg(x).alias(f"mean_{i}"), F.stddev_samp(x).alias(f"std_{i}"),
                 F.min(x).alias(f"lo_{i}"), F.max(x).alias(f"hi_{i}")]
    row = df.agg(*aggs).first()
    # all columns stacked (column, value): one quantile job for every column
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])).alias("e")).select("e.*")
    quartiles = {r["column"]: r for r in exact_quantiles(stacked, "v", [0.25, 0.5, 0.75], ["column"]).collect()}
    out = {}
    for i, c in enumerate(cols):
        out[c] = {k: row[f"{k}_{i}"] for k in ("n", "mean", "std", "lo", "hi")}
        out[c] |= {k: quartiles[c][f"q_{j}"] if c in quartiles else None for j, k in enumerate(("q1", "median", "q3"))}
    return out


#: Names of the statistics of P2 and their places in ``numeric_summary``.
_DESCRIBED = (("count", "n"), ("mean", "mean"), ("std", "std"), ("min", "lo"), ("25%", "q1"), ("50%", "median"),
              ("75%", "q3"), ("max", "hi"))
_DESCRIBE_SCHEMA = "column string, stat string, num_value double, text_value string"


def describe_texts(df: DataFrame, cols: list[str], hashed: Hashed = fingerprint) -> DataFrame:
    """count, unique, top, freq of text columns as (column, stat, num_value, text_value); null values do not count.

    Values are counted by fingerprint; of the most frequent ones those of the smallest first bytes alone are fetched.
    """
    spark = df.sparkSession
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text")) for c in cols]))
        .alias("e")).select("e.*").where(F.col("text").isNotNull())
    rows = fingerprinted(stacked, ["column"], ["text"], hashed)
    groups = group_starts(rows, ["column"], ["text"])
    stats = {r["column"]: r for r in groups.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), F.max("n").alias("freq")).collect()}
    # the most frequent values, ties to the smaller one; where all occur once, simply the smallest
    once = [c for c, r in stats.items() if r["freq"] == 1]
    tops = []
    if once:
        tops.append(stacked.where(F.col("column").isin(once)).select("column", "text"))
    if len(once) < len(stats):
        most = F.coalesce(*[F.when(F.col("column") == c, F.lit(r["freq"])) for c, r in stats.items()])
        tied = groups.where((F.col("n") == most) & (F.col("n") > 1))
        # however many are tied, the smallest has the smallest first bytes: few values are fetched
        least = {r["column"]: r["first"] for r in tied.groupBy("column").agg(F.min("first").alias("first")).collect()}
        tied = written(tied.where(F.coalesce(*[F.when(F.col("column") == c, F.col("first") == p) for c, p in least.items()])), "tied")
        tops.append(rows.join(tied.where("value IS NULL"), ["column", "_a", "_b"], "left_semi").select("column", "text"))
        tops.append(tied.where("value IS NOT NULL").select("column", "value.text"))
    top = {}
    if tops:
        every = functools.reduce(DataFrame.unionByName, tops)
        # without a grouping key, which would sort the texts
        top = every.agg(*[F.min(F.when(F.col("column") == c, F.col("text"))).alias(f"top_{i}") for i, c in enumerate(stats)]).first()
        top = {c: top[f"top_{i}"] for i, c in enumerate(stats)}
    out = []
    for c, r in stats.items():
        out += [(c, "count", float(r["count"]), None), (c, "unique", float(r["unique"]), None),
                (c, "top", None, top[c]), (c, "freq", float(r["freq"]), None)]
    return spark.createDataFrame(out, _DESCRIBE_SCHEMA)


def describe_all(df: DataFrame, cols: list[str] | None = None, digits: int = 6,
                 summary: dict[str, dict] | None = None) -> DataFrame:
    """Numeric count/mean/std/min/quartiles/max; text count/unique/top/freq.

    Long form (column, stat, num_value, text_value).  Quartiles are exact
    (linear interpolation, skew-safe ``exact_quantiles``), ``top`` breaks ties
    by the smaller value.  A column without values has no quartiles, a text column without values no row.
    ``summary`` is a ``numeric_summary`` that is already at hand.
    """
    cols = cols or df.columns
    nums = [c for c in cols if c in _numeric(df)]
    texts = [c for c in cols if c not in nums]
    parts = []
    if nums:
        summary = summary or numeric_summary(df, nums)
        rows = [(c, stat, None if summary[c][k] is None else float(summary[c][k]), None)
                for c in nums for stat, k in _DESCRIBED if summary[c]["n"] or "%" not in stat]
        parts.append(df.sparkSession.createDataFrame(rows, _DESCRIBE_SCHEMA)
                     .withColumn("num_value", F.round("num_value", digits)))
    if texts:
        parts.append(describe_texts(df, texts))
    return functools.reduce(DataFrame.unionByName, parts)


def duplicate_rows(df: DataFrame, cols: list[str] | None = None, hashed: Hashed = fingerprint) -> DataFrame:
    """Rows equal to an earlier row (null equals null), as one count; rows are counted by fingerprint."""
    cols = cols or df.columns
    return (group_counts(fingerprinted(df, [], cols, hashed), [], cols)
            .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n_duplicates")))


def head(df: DataFrame, order_by: str = "id", n: int = 5) -> DataFrame:
    """First ``n`` rows by a key (TakeOrderedAndProject)."""
    return df.orderBy(order_by).limit(n)


# ---------------------------------------------------------------------------
# P5-P7 distribution charts
# ---------------------------------------------------------------------------


def _stats_row(df: DataFrame, col: str, with_iqr: bool = True) -> dict:
    x = F.col(col).cast("double")
    r = df.where(x.isNotNull()).agg(
        F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"),
        F.stddev_samp(x).alias("std")).first()
    out = {"n": r["n"], "lo": r["lo"], "hi": r["hi"], "std": r["std"], "iqr": None}
    if with_iqr and r["n"]:
        q = exact_quantiles(df, col, [0.25, 0.75]).first()
        out["iqr"] = q["q_1"] - q["q_0"]
    return out


def auto_bins(n: int, lo: float, hi: float, iqr: float) -> int:
    """More bins of Sturges and Freedman-Diaconis (the smaller width)."""
    if n == 0 or hi == lo:
        return 1
    sturges = math.ceil(math.log2(n)) + 1
    if iqr and iqr > 0:
        fd_width = 2.0 * iqr * n ** (-1.0 / 3.0)
        fd = math.ceil((hi - lo) / fd_width)
        return max(sturges, fd)
    return sturges


def histogram(df: DataFrame, col: str, bins: int | None = None, summary: dict | None = None) -> DataFrame:
    """P5: equal-width bins over [min, max], empty ones too; the last bin is closed.

    ``summary`` is the column's record of ``numeric_summary`` where it is already at hand.
    """
    s = summary | {"iqr": summary["q3"] - summary["q1"] if summary["n"] else None} if summary else _stats_row(df, col)
    if s["n"] == 0:
        return df.sparkSession.createDataFrame([], "bin bigint, lo double, hi double, n bigint")
    nb = bins or auto_bins(s["n"], s["lo"], s["hi"], s["iqr"])
    lo, hi = float(s["lo"]), float(s["hi"])
    width = (hi - lo) / nb if hi > lo else 1.0
    x = F.col(col).cast("double")
    idx = F.least(F.floor((x - F.lit(lo)) / F.lit(width)).cast("bigint"), F.lit(nb - 1).cast("bigint"))
    counts = df.where(x.isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(nb).withColumnRenamed("id", "bin")
    return every.join(counts, "bin", "left").select("bin", F.round(F.lit(lo) + F.col("bin") * F.lit(width), 6).alias("lo"),
                         F.round(F.lit(lo) + (F.col("bin") + 1) * F.lit(width), 6).alias("hi"),
                         F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def kde_curve(df: DataFrame, col: str, points: int = 200, cut: float = 3.0, summary: dict | None = None) -> DataFrame:
    """Gaussian KDE (Scott bandwidth) on an even grid of ``points``.

    Each value contributes to every grid point: the rows are fanned out over
    the fixed grid (``points`` is a parameter, not data) and summed per point
    with map-side partial aggregation, so at most ``points`` rows per
    partition reach the shuffle.  This keeps the aggregate inside whole-stage
    codegen (200 separate ``sum`` columns did not) and was ~10x faster.
    """
    s = summary or _stats_row(df, col, with_iqr=False)
    n, std = s["n"], s["std"]
    if not n or not std or std <= 0:
        return df.sparkSession.createDataFrame([], "point int, x double, density double")
    h = std * n ** (-1.0 / 5.0)
    lo, hi = s["lo"] - cut * h, s["hi"] + cut * h
    step = (hi - lo) / (points - 1)
    v = F.col(col).cast("double")
    norm = 1.0 / (n * h * math.sqrt(2.0 * math.pi))
    grid_x = F.lit(lo) + F.col("point").cast("double") * F.lit(step)
    fanned = df.where(v.isNotNull()).select(
        v.alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    sums = fanned.groupBy("point").agg(
        F.sum(F.exp(F.lit(-0.5) * F.pow((grid_x - F.col("_v")) / F.lit(h), 2))).alias("_s"))
    return sums.select(F.col("point").cast("int").alias("point"), F.round(grid_x, 6).alias("x"),
                       F.round(F.col("_s") * F.lit(norm), 10).alias("density"))


def binned_kde_curve(df: DataFrame, col: str, points: int = 200, cut: float = 3.0, error: float = 1e-6) -> DataFrame:
    """P6 for large n: the curve of ``kde_curve`` from linearly binned values, one row per value up to the aggregate.

    A value's weight is shared between the two nodes of a fine grid that enclose it, in proportion to its nearness; the
    kernel is then summed over occupied nodes, as far as it reaches.  With h the bandwidth, interpolating the
    kernel over a node distance d is off by at most (d / h)^2 / 8 of its peak 1 / (h sqrt(2 pi)), and what lies beyond r
    bandwidths is below exp(-r^2 / 2) of it.  d and r are chosen for ``error`` each,
    so a density is off by at most 2 * error * peak.
    """
    s = _stats_row(df, col, with_iqr=False)
    n, std = s["n"], s["std"]
    if not n or not std or std <= 0:
        return df.sparkSession.createDataFrame([], "point int, x double, density double")
    h = std * n ** (-1.0 / 5.0)
    lo, hi = s["lo"] - cut * h, s["hi"] + cut * h
    step = (hi - lo) / (points - 1)
    reach = h * math.sqrt(-2.0 * math.log(error))
    width = (s["hi"] - s["lo"]) / math.ceil((s["hi"] - s["lo"]) / (h * math.sqrt(8.0 * error)))
    v = F.col(col).cast("double")
    at = (v - F.lit(s["lo"])) / F.lit(width)
    shares = (df.where(v.isNotNull()).select(F.floor(at).alias("_node"), (at - F.floor(at)).alias("_up"))
              .groupBy("_node").agg(F.sum(1.0 - F.col("_up")).alias("_low"), F.sum("_up").alias("_high")))
    nodes = shares.select(F.explode(F.array(F.struct(F.col("_node").alias("node"), F.col("_low").alias("w")),
                                            F.struct((F.col("_node") + 1).alias("node"), F.col("_high").alias("w")))).alias("r")).select("r.*")
    place = F.lit(s["lo"]) + F.col("node") * F.lit(width)
    first = F.greatest(F.lit(0).cast("bigint"), F.ceil((place - F.lit(reach) - F.lit(lo)) / F.lit(step)))
    last = F.least(F.lit(points - 1).cast("bigint"), F.floor((place + F.lit(reach) - F.lit(lo)) / F.lit(step)))
    grid_x = F.lit(lo) + F.col("point").cast("double") * F.lit(step)
    sums = (nodes.select(place.alias("_at"), "w", first.alias("_f"), last.alias("_l")).where("w > 0 AND _f <= _l")
            .withColumn("point", F.explode(F.sequence("_f", "_l"))).groupBy("point")
            .agg(F.sum(F.col("w") * F.exp(F.lit(-0.5) * F.pow((grid_x - F.col("_at")) / F.lit(h), 2))).alias("_s")))
    every = df.sparkSession.range(points).withColumnRenamed("id", "point")
    norm = 1.0 / (n * h * math.sqrt(2.0 * math.pi))
    return every.join(sums, "point", "left").select(
        F.col("point").cast("int").alias("point"), F.round(grid_x, 6).alias("x"),
        F.round(F.coalesce("_s", F.lit(0.0)) * F.lit(norm), 10).alias("density"))


def box_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles, whiskers (farthest points within 1.5 IQR) and outliers per group."""
    x = F.col(value).cast("double")
    base = df.where(x.isNotNull()).select(F.col(by).alias("grp"), x.alias("v"))
    q = exact_quantiles(base, "v", [0.25, 0.5, 0.75], ["grp"])
    q = q.select("grp", "n", F.col("q_0").alias("q1"), F.col("q_1").alias("median"),
                 F.col("q_2").alias("q3"))
    fences = q.select(F.col("grp").alias("_g"), "n", "q1", "median", "q3",
                      (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lo_fence"),
                      (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("hi_fence"))
    # one fence row per group, fixed once (checkpoint) then broadcast behind a row
    # check, so a hot group is not sent to one task by the join
    ensure_checkpoint_dir(df.sparkSession)
    fences = computed_once(fences)
    j = base.join(fences, F.col("grp").eqNullSafe(F.col("_g"))).drop("_g")
    out = j.groupBy("grp", "n", "q1", "median", "q3", "lo_fence", "hi_fence").agg(
        F.min(F.when(F.col("v") >= F.col("lo_fence"), F.col("v"))).alias("whisker_lo"),
        F.max(F.when(F.col("v") <= F.col("hi_fence"), F.col("v"))).alias("whisker_hi"),
        F.count_if((F.col("v") < F.col("lo_fence")) | (F.col("v") > F.col("hi_fence"))).alias("n_outliers"))
    return out.select(F.col("grp").alias(by), F.col("n").cast("bigint").alias("n"),
                      *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")],
                      F.col("n_outliers").cast("bigint").alias("n_outliers"))


# ---------------------------------------------------------------------------
# P8-P11 relationships
# ---------------------------------------------------------------------------


def binned_scatter(df: DataFrame, pairs: list[tuple[str, str]], bins: int = 10,
                   summary: dict[str, dict] | None = None) -> DataFrame:
    """2-D bin counts per column pair (rows where both values are present), in one pass.

    A column paired with itself gives its histogram, the diagonal of a pair plot.
    """
    cols = sorted({c for p in pairs for c in p})
    if summary:
        r = {f"{k}_{c}": summary[c][k] for c in cols for k in ("lo", "hi")}
    else:
        r = df.agg(*[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in cols],
                   *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in cols]).first()

    def idx(c):
        lo, hi = r[f"lo_{c}"], r[f"hi_{c}"]
        if lo is None:
            return F.lit(None).cast("int")
        w = (hi - lo) / bins if hi > lo else 1.0
        return F.least(F.floor((F.col(c).cast("double") - F.lit(lo)) / F.lit(w)).cast("int"), F.lit(bins - 1))

    points = F.array(*[
        F.when(F.col(xc).isNotNull() & F.col(yc).isNotNull(),
               F.struct(F.lit(xc).alias("x"), F.lit(yc).alias("y"), idx(xc).alias("bx"), idx(yc).alias("by")))
        for xc, yc in pairs])
    return (df.select(F.explode(points).alias("p")).where(F.col("p").isNotNull())
            .groupBy("p.x", "p.y", "p.bx", "p.by").agg(F.count(F.lit(1)).cast("bigint").alias("n")))


def bar_of_top_rows(df: DataFrame, value: str, group: str, n: int = 10,
                    order_key: str = "id") -> DataFrame:
    """The ``n`` largest rows by ``value``, then mean, count and std per group."""
    top = df.orderBy(F.desc(value), F.asc(order_key)).limit(n)
    return top.groupBy(group).agg(
        F.round(F.avg(value), 4).alias("mean_value"),
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.round(F.stddev_samp(value), 4).alias("std_value"))


def count_top_categories(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """P10: counts for the ``n`` most common values, with their rank (the rows of A5 already hold them)."""
    return top_categories(df, col, n)


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation for every ordered pair, one pass."""
    aggs, names = [], []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            aggs.append(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}_{j}"))
            names.append((a, b, f"c{i}_{j}"))
    row = df.agg(*aggs)
    entries = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"),
                        F.round(F.col(c), 6).alias("corr")) for a, b, c in names]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
