"""Registered queries of the failure, calibration and density extensions."""

from __future__ import annotations

import hashlib
import os
from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F

from venturelens.operators import model as M
from venturelens.operators import pairs as L
from venturelens.operators import profile as P
from venturelens.operators.guards import split_requests
from venturelens.plans import oracle as O
from venturelens.plans.queries import (
    IDEAS_PREFIX, K, MEMBER_STATS_SQL, PAIRS_SQL, Q1_SQL, QUERY_TRAIN, cleaned_catalog, member_stats_frame, pairs_frame, scratch,
    training_catalog,
)
from venturelens.plans.registry import register
from venturelens.schema import NO_ANALYSIS_REASONING
from venturelens.sources.bindings import binding, table
from venturelens.sources.catalog import scan_checked_requests
from venturelens.streaming.requests import evaluate_stream

# --- P6 ----------------------------------------------------------------------

BIN_ERROR = 1e-6


@register("binned_kde_curve", f"""WITH s AS (
  SELECT count(value) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) AS sd FROM events WHERE value IS NOT NULL),
h AS (SELECT *, sd * pow(n, -1.0 / 5.0) AS bw FROM s),
g AS (SELECT *, lo - 3.0 * bw AS glo, ((hi + 3.0 * bw) - (lo - 3.0 * bw)) / 199 AS step, bw * sqrt(-2.0 * ln({BIN_ERROR})) AS reach,
             (hi - lo) / ceil((hi - lo) / (bw * sqrt(8.0 * {BIN_ERROR}))) AS width FROM h),
v AS (SELECT floor((value - lo) / width) AS node, (value - lo) / width - floor((value - lo) / width) AS up FROM events, g WHERE value IS NOT NULL),
nodes AS (SELECT node, sum(w) AS w FROM (SELECT node, 1.0 - up AS w FROM v UNION ALL SELECT node + 1, up FROM v) GROUP BY node),
grid AS (SELECT r.range AS point, glo + r.range * step AS x FROM g, range(200) r)
SELECT CAST(point AS INTEGER) AS point, round(x, 6) AS x,
       round(coalesce(sum(w * exp(-0.5 * pow((x - (lo + node * width)) / bw, 2))), 0.0) * (1.0 / (any_value(n) * any_value(bw) * sqrt(2.0 * pi()))), 10) AS density
FROM grid CROSS JOIN g LEFT JOIN nodes ON abs(x - (lo + node * width)) <= reach GROUP BY point, x""")
def q_binned_kde_curve(spark, sf):
    return P.binned_kde_curve(table(spark, sf, "events").select("value"), "value", 200, error=BIN_ERROR)


# --- L2 ----------------------------------------------------------------------


def _fragile(prompts: pd.Series) -> list[str]:
    """A stand-in for a model client that fails on some prompts: a verdict from the prompt's digest."""
    digests = [hashlib.md5(p.encode()).hexdigest() for p in prompts]
    if any(d[0] == "0" for d in digests):
        raise RuntimeError("no answer")
    return [f'{{"similarity_score": {len(p) % 101}, "is_copy": {str(d[1] < "8").lower()}, "reasoning": "{d}"}}'
            for p, d in zip(prompts, digests)]


@register("score_pairs_isolated", PAIRS_SQL + f""",
prompts AS (SELECT idea_id, id,
  'Compare two startup descriptions and say whether the first copies the second.' || chr(10) ||
  'Idea: "' || coalesce(user_idea, '') || '"' || chr(10) ||
  'Existing company ' || coalesce(company, '') || ': "' || coalesce(description, '') || '"' || chr(10) ||
  'Answer with JSON: {{"similarity_score": 0-100, "is_copy": true|false, "reasoning": "one or two sentences"}}' AS prompt FROM pairs),
d AS (SELECT *, md5(prompt) AS m FROM prompts)
SELECT idea_id, id, CASE WHEN m LIKE '0%' THEN 0.0 ELSE CAST(length(prompt) % 101 AS DOUBLE) END AS score,
       m NOT LIKE '0%' AND substr(m, 2, 1) < '8' AS is_copy,
       CASE WHEN m LIKE '0%' THEN {O.q(NO_ANALYSIS_REASONING)} ELSE m END AS reasoning,
       CASE WHEN m LIKE '0%' THEN 'RuntimeError: no answer' END AS scorer_error FROM d""")
def q_score_pairs_isolated(spark, sf):
    """A plug-in scorer that fails on some prompts: those alone get the defaults."""
    return L.score_pairs(pairs_frame(spark, sf), scorer=_fragile).select("idea_id", "id", "score", "is_copy", "reasoning", "scorer_error")


# --- A10 ---------------------------------------------------------------------

LEVELS = (0.5, 0.8, 0.9, 0.95, 0.99)
_LEVELS_SQL = ", ".join(f"({level}, {NormalDist().inv_cdf((1 + level) / 2)!r})" for level in LEVELS)


@register("interval_calibration", "WITH " + MEMBER_STATS_SQL + f""",
scored AS (SELECT abs(y - mean_pred) / greatest(std_pred, 1e-9) AS score FROM per_id),
levels(level, z) AS (VALUES {_LEVELS_SQL}),
c AS (SELECT count(*) AS n, list(score ORDER BY score) AS s FROM scored),
p AS (SELECT level, z, n, s, least(1.0, ceil((n + 1) * level) / n) * (n - 1) AS pos FROM levels, c)
SELECT CAST(level AS DOUBLE) AS level, round(CAST(z AS DOUBLE), 6) AS z, n, round((SELECT avg(CAST(score <= z AS DOUBLE)) FROM scored), 6) AS coverage,
       round(s[CAST(floor(pos) AS BIGINT) + 1] + (pos - floor(pos)) * (s[least(n, CAST(floor(pos) AS BIGINT) + 2)] - s[CAST(floor(pos) AS BIGINT) + 1]), 4) AS z_calibrated
FROM p""")
def q_interval_calibration(spark, sf):
    t = M.calibration_table(member_stats_frame(spark, sf), levels=LEVELS)
    return t.select("level", F.round("z", 6).alias("z"), "n", F.round("coverage", 6).alias("coverage"),
                    F.round("z_calibrated", 4).alias("z_calibrated"))


@register("training_error")
def q_training_error(spark, sf):
    """M7's printed result: rows used and the error on the log target."""
    return M.train_funding_model(training_catalog(spark, sf), scratch(spark, "model"), QUERY_TRAIN)


# --- S4 / C15 and T1 ------------------------------------------------------------

@register("rejected_requests", IDEAS_PREFIX + f"""
SELECT CAST(idea_id AS VARCHAR) AS request, 'missing idea' AS reason, CAST(NULL AS VARCHAR) AS text FROM ideas WHERE coalesce(user_idea, '') = ''
UNION ALL SELECT CAST(idea_id AS VARCHAR), CASE WHEN coalesce(user_city, '') = '' THEN 'missing city' ELSE 'missing year' END, NULL FROM ideas
WHERE coalesce(user_idea, '') <> '' AND (coalesce(user_city, '') = '' OR coalesce(founding_year, 0) = 0)
UNION ALL SELECT 'none', 'malformed record', '{{"idea_id": ' || CAST(idea_id AS VARCHAR) || ', "user_idea": broken' FROM ideas""")
def q_rejected_requests(spark, sf):
    """Every request, and a broken line beside each, read back: broken lines are rejected with their text."""
    path = scratch(spark, "requests")
    ideas = binding(spark, sf, "ideas")
    lines = ideas.select(F.to_json(F.struct(*ideas.columns)).alias("value")).unionByName(
        ideas.select(F.concat(F.lit('{"idea_id": '), F.col("idea_id").cast("string"), F.lit(', "user_idea": broken')).alias("value")))
    lines.write.mode("overwrite").text(path)
    _, rejected = split_requests(scan_checked_requests(spark, path))
    return rejected.select(F.coalesce(F.col("idea_id").cast("string"), F.lit("none")).alias("request"), "reason", F.col("_corrupt_record").alias("text"))


@register("evaluate_stream_once", Q1_SQL)
def q_evaluate_stream_once(spark, sf):
    """Every request sent in two files, and again after a restart: each is evaluated once."""
    base = scratch(spark, "stream")
    in_dir, out_dir = os.path.join(base, "in"), os.path.join(base, "out")
    ideas, catalog = binding(spark, sf, "ideas"), cleaned_catalog(spark, sf)
    ideas.write.mode("overwrite").json(in_dir)
    ideas.write.mode("append").json(in_dir)
    for again in (False, True):
        if again:
            ideas.write.mode("append").json(in_dir)
        evaluate_stream(spark, in_dir, out_dir, os.path.join(base, "checkpoint"), catalog, k=K).awaitTermination()
    return spark.read.parquet(os.path.join(out_dir, "evaluated")).drop("epoch")
