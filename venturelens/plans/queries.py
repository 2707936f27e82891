"""The registered queries (keys follow the operator inventory).

Every query reads the driver tables of ``sf_dir`` through the shared bindings
and runs over whole tables.  Queries that train a model use the quick forest
profile ``QUERY_TRAIN`` (documented in the README); the library defaults are
the full ones.
"""

from __future__ import annotations

import os
import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venturelens.functions import cleaning as C
from venturelens.operators import model as M
from venturelens.operators import pairs as L
from venturelens.operators import profile as P
from venturelens.operators.guards import funded_only, min_rows_guard, validate_requests
from venturelens.operators.neighbours import ids_in, lookup_in_rank_order, neighbour_stats
from venturelens.operators.vectors import embed_text, hstack_features, l2_distance, top_k_similar, top_match, with_embedding
from venturelens.plans import oracle as O
from venturelens.plans.evaluate import copycat_report, evaluate_ideas, evaluate_ideas_full
from venturelens.plans.registry import register
from venturelens.schema import (
    CATALOG_HEADERS, COPY_LABEL, DEFAULT_K, FEATURE_MISSING_TOKEN, MISSING_REASONING, NO_ANALYSIS_REASONING,
    TRAINING_DEFAULTS, UNIQUE_LABEL, VALIDATION_PERCENT, YearBounds,
)
from venturelens.session import shared_path, written
from venturelens.sources.bindings import (
    CATALOG_SQL, IDEAS_SQL, MEMBER_PREDICTIONS_SQL, VERDICTS_SQL, binding, table,
)
from venturelens.sources.catalog import (
    assign_row_id, clean_catalog, normalize_nulls, scan_catalog, scan_requests, select_columns,
    write_results,
)
from venturelens.streaming.requests import evaluate_stream

K = DEFAULT_K
q = O.q

# ---------------------------------------------------------------------------
# shared inputs
# ---------------------------------------------------------------------------


def scanned_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_nulls(binding(spark, sf, "catalog"))


def cleaned_catalog(spark: SparkSession, sf: str, **kw) -> DataFrame:
    return clean_catalog(scanned_catalog(spark, sf), **kw)


def training_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return cleaned_catalog(spark, sf, defaults=TRAINING_DEFAULTS)


def embedding_neighbours(spark: SparkSession, sf: str, k: int = K, **kw) -> DataFrame:
    """V3 over the whole embeddings table: every vector against all others."""
    ideas = binding(spark, sf, "idea_vectors")
    cat = binding(spark, sf, "catalog_vectors")
    return top_k_similar(ideas, cat, k=k, exclude_self=True, **kw)


def scratch(spark: SparkSession, *parts: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return shared_path(spark, "venturelens", *parts, uuid.uuid4().hex)


PREFIX = O.catalog_prefix()
PREFIX_IDEAS = O.catalog_prefix("ideas")
TRAIN_PREFIX = O.catalog_prefix(description_default="", industries_default=None)
EMB_KNN = (O.list_vector_cte("ev", "embeddings", "vec_id", "embedding") + ",\n"
           + O.knn_ctes("ev", "ev", K, exclude_self=True))

# ---------------------------------------------------------------------------
# 2.1 sources and sinks
# ---------------------------------------------------------------------------


@register("scan_catalog", PREFIX + "\nSELECT * FROM scanned")
def q_scan_catalog(spark, sf):
    """The catalog as a CSV file with the public headers, in another order, read by the real reader."""
    path = scratch(spark, "catalog-csv")
    header = {raw: h for h, raw in CATALOG_HEADERS.items()}
    raw = binding(spark, sf, "catalog")
    shuffled = sorted(raw.columns, key=lambda c: c[::-1])
    (raw.select(*[F.col(c).alias(header.get(c, c)) for c in shuffled])
     .write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return scan_catalog(spark, path)


MODEL_INPUT_COLS = ["id", "description", "starting_year", "founders_count", "employees_count",
                    "city", "industries"]


@register("select_columns", TRAIN_PREFIX + "\nSELECT " + ", ".join(MODEL_INPUT_COLS) + " FROM clean")
def q_select_columns(spark, sf):
    return select_columns(training_catalog(spark, sf), MODEL_INPUT_COLS)


@register("assign_row_id", PREFIX + """
SELECT id, company, CAST(row_number() OVER (ORDER BY company, id) - 1 AS BIGINT) AS row_id FROM scanned""")
def q_assign_row_id(spark, sf):
    return assign_row_id(scanned_catalog(spark, sf).select("id", "company"), order_by=["company", "id"])


IDEAS_PREFIX = "WITH ideas AS (" + IDEAS_SQL.strip() + ")"


@register("scan_requests", IDEAS_PREFIX + "\nSELECT * FROM ideas")
def q_scan_requests(spark, sf):
    path = scratch(spark, "requests")
    binding(spark, sf, "ideas").write.mode("overwrite").json(path)
    return scan_requests(spark, path)


Q1_SQL = PREFIX_IDEAS + ",\n" + O.evaluate_ideas_ctes(K) + "\nSELECT * FROM q1"


def _duck_words(x: str) -> str:
    return (f"list_filter(list_distinct(regexp_split_to_array(lower(coalesce({x}, '')), "
            f"{q('[^A-Za-z0-9]+')})), lambda t: t <> '')")


IDEA_SCORES_SQL = (PREFIX_IDEAS + ",\n" + O.evaluate_ideas_ctes(K) + """,
pairs AS (SELECT nb.idea_id, nb.id, v.user_idea, c.description, c.company
          FROM nb JOIN valid v ON v.idea_id = nb.idea_id JOIN clean c ON c.id = nb.id WHERE nb.rank = 1),
words AS (SELECT idea_id, id, company, """ + _duck_words("user_idea") + " AS wa, " + _duck_words("description") + """ AS wb FROM pairs),
ju AS (SELECT idea_id, id, company, len(list_intersect(wa, wb)) AS i,
              len(wa) + len(wb) - len(list_intersect(wa, wb)) AS u FROM words),
scored AS (SELECT idea_id, company, CASE WHEN u = 0 THEN 0.0 ELSE round(100.0 * i / u, 0) END AS score,
                  'The texts share ' || CAST(i AS VARCHAR) || ' of ' || CAST(u AS VARCHAR) || ' distinct words.' AS reasoning
           FROM ju)""")


@register("write_results", IDEA_SCORES_SQL + """
SELECT q1.idea_id, predicted_industry, user_city, founding_year, top_match_name, score, score >= 80.0 AS is_copy, reasoning,
       (SELECT string_agg(CAST(r.rank AS VARCHAR) || ':' || CAST(r.id AS VARCHAR) || ':' || coalesce(r.company, ''), '|' ORDER BY r.rank)
        FROM rows r WHERE r.idea_id = q1.idea_id) AS similar_startups,
       rate, avg_funding_str, true AS has_prediction, CAST(0.6 AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS error
FROM q1 LEFT JOIN scored ON scored.idea_id = q1.idea_id""")
def q_write_results(spark, sf):
    """The nested record of five sections, written as JSON and read back; forest amounts only as present or not."""
    full = evaluate_ideas_full(binding(spark, sf, "ideas"), cleaned_catalog(spark, sf), trained_model_dir(spark, sf), k=K)
    path = scratch(spark, "results")
    write_results(full, path, "json")
    back = spark.read.schema(full.schema).json(path)
    similar = F.transform("similar_startups", lambda r: F.concat_ws(
        ":", r["rank"].cast("string"), r["id"].cast("string"), F.coalesce(r["company"], F.lit(""))))
    return back.select("idea_id", "profile.predicted_industry", "profile.user_city", "profile.founding_year",
                       "ai_analysis.top_match_name", "ai_analysis.score", "ai_analysis.is_copy", "ai_analysis.reasoning",
                       F.array_join(similar, "|").alias("similar_startups"),
                       "funding_analysis.rate", "funding_analysis.avg_funding_str",
                       F.col("funding_prediction.predicted_amount").isNotNull().alias("has_prediction"),
                       "funding_prediction.confidence", "funding_prediction.error")


# ---------------------------------------------------------------------------
# 2.2 cleaning and scalar expressions
# ---------------------------------------------------------------------------


@register("fill_text", PREFIX + f"""
SELECT id, coalesce(description_raw, {q('No description provided')}) AS description,
       coalesce(industries_raw, {q('Not specified')}) AS industries,
       coalesce(description_raw, '') AS description_train FROM scanned""")
def q_fill_text(spark, sf):
    s = scanned_catalog(spark, sf)
    return s.select("id", C.fill_text("description_raw", "No description provided").alias("description"),
                    C.fill_text("industries_raw", "Not specified").alias("industries"),
                    C.fill_text("description_raw", "").alias("description_train"))


@register("clean_currency", PREFIX + f"\nSELECT id, funding_raw, {O.clean_currency('funding_raw')} AS funding FROM scanned")
def q_clean_currency(spark, sf):
    return scanned_catalog(spark, sf).select("id", "funding_raw", C.clean_currency("funding_raw").alias("funding"))


@register("coerce_number", PREFIX + f"\nSELECT id, starting_year_raw, {O.coerce_number('starting_year_raw')} AS starting_year FROM scanned")
def q_coerce_number(spark, sf):
    return scanned_catalog(spark, sf).select("id", "starting_year_raw",
                                             C.coerce_number("starting_year_raw").alias("starting_year"))


@register("first_integer", PREFIX + f"\nSELECT id, employees_raw, {O.first_integer('employees_raw')} AS employees_count FROM scanned")
def q_first_integer(spark, sf):
    return scanned_catalog(spark, sf).select("id", "employees_raw",
                                             C.first_integer("employees_raw").alias("employees_count"))


@register("range_midpoint", PREFIX + f"""
SELECT id, employees_raw, {O.range_midpoint("nullif(employees_raw, 'None')")} AS employees_mid FROM scanned""")
def q_range_midpoint(spark, sf):
    return scanned_catalog(spark, sf).select(
        "id", "employees_raw", C.range_midpoint(C.sentinel_to_null("employees_raw")).alias("employees_mid"))


@register("sentinel_to_null", "WITH catalog AS (" + CATALOG_SQL.strip() + ")" + """
SELECT id, employees_raw, nullif(employees_raw, 'None') AS employees_clean FROM catalog""")
def q_sentinel_to_null(spark, sf):
    raw = binding(spark, sf, "catalog")
    return raw.select("id", "employees_raw", C.sentinel_to_null("employees_raw").alias("employees_clean"))


@register("list_count", PREFIX + f"\nSELECT id, founders_raw, {O.list_count('founders_raw')} AS founders FROM scanned")
def q_list_count(spark, sf):
    return scanned_catalog(spark, sf).select("id", "founders_raw", C.list_count("founders_raw").alias("founders"))


@register("short_industry", PREFIX + """
SELECT id, industries, array_to_string(string_split(industries, ',')[1:2], ' ') AS short_industry FROM clean""")
def q_short_industry(spark, sf):
    c = cleaned_catalog(spark, sf)
    return c.select("id", "industries", C.short_industry("industries").alias("short_industry"))


@register("optional_column", PREFIX + "\nSELECT id, founders_count, starting_year FROM clean")
def q_optional_column(spark, sf):
    # the raw catalog has no founders count column: it becomes the constant 0
    return cleaned_catalog(spark, sf).select("id", "founders_count", "starting_year")


@register("log_target", PREFIX + """
SELECT id, funding, round(ln(1 + funding), 6) AS log_funding, round(exp(ln(1 + funding)) - 1, 4) AS restored
FROM clean WHERE funding > 0""")
def q_log_target(spark, sf):
    c = funded_only(cleaned_catalog(spark, sf))
    lg = C.log_target("funding")
    return c.select("id", "funding", F.round(lg, 6).alias("log_funding"),
                    F.round(C.inverse_target(lg, "log1p"), 4).alias("restored"))


@register("inverse_target", PREFIX + """
SELECT id, round(exp(ln(1 + funding)) - 1, 4) AS funding_back, round(ln(1 + funding), 6) AS funding_log
FROM clean WHERE funding > 0""")
def q_inverse_target(spark, sf):
    c = funded_only(cleaned_catalog(spark, sf)).select("id", C.log_target("funding").alias("lg"))
    return c.select("id", F.round(C.inverse_target("lg", "log1p"), 4).alias("funding_back"),
                    F.round(C.inverse_target("lg", None), 6).alias("funding_log"))


MEMBER_STATS_SQL = """member_predictions AS ({mp}),
per_id AS (SELECT id, max(y) AS y, avg(pred) AS mean_pred, stddev_pop(pred) AS std_pred
           FROM member_predictions GROUP BY id)""".format(mp=MEMBER_PREDICTIONS_SQL.strip())


def member_stats_frame(spark, sf):
    mp = binding(spark, sf, "member_predictions")
    return mp.groupBy("id").agg(F.max("y").alias("y"), F.avg("pred").alias("mean_pred"),
                                F.stddev_pop("pred").alias("std_pred"))


@register("prediction_interval", "WITH " + MEMBER_STATS_SQL + """
SELECT id, round(exp(mean_pred) - 1, 4) AS predicted_amount,
       round(exp(mean_pred - 1.96 * std_pred) - 1, 4) AS lower,
       round(exp(mean_pred + 1.96 * std_pred) - 1, 4) AS upper FROM per_id""")
def q_prediction_interval(spark, sf):
    st = member_stats_frame(spark, sf)
    amount, lower, upper = M.prediction_interval("mean_pred", "std_pred", "log1p")
    return st.select("id", F.round(amount, 4).alias("predicted_amount"), F.round(lower, 4).alias("lower"),
                     F.round(upper, 4).alias("upper"))


@register("format_currency", PREFIX + f"""
SELECT id, funding, {O.format_currency('CASE WHEN funding > 0 THEN funding END')} AS funding_str FROM clean""")
def q_format_currency(spark, sf):
    c = cleaned_catalog(spark, sf)
    return c.select("id", "funding",
                    C.format_currency(F.when(F.col("funding") > 0, F.col("funding"))).alias("funding_str"))


@register("funding_rate_label", PREFIX + """
SELECT city, CAST(count(*) FILTER (WHERE funding > 0) AS VARCHAR) || ' out of ' || CAST(count(*) AS VARCHAR) AS rate
FROM clean GROUP BY city""")
def q_funding_rate_label(spark, sf):
    c = cleaned_catalog(spark, sf)
    g = c.groupBy("city").agg(F.count_if(F.col("funding") > 0).alias("n"), F.count(F.lit(1)).alias("k"))
    return g.select("city", C.funding_rate_label("n", "k").alias("rate"))


VERDICTS_PREFIX = "WITH verdicts AS (" + VERDICTS_SQL.strip() + ")"


def _duck_parse(raw: str) -> str:
    has = (f"(CASE WHEN coalesce(json_valid({raw}), false) THEN (CASE WHEN json_type({raw}) = 'OBJECT' "
           f"THEN len(json_keys({raw})) > 0 ELSE false END) ELSE false END)")
    return f"""{has} AS has_record,
  CASE WHEN {has} THEN TRY_CAST(json_extract_string({raw}, '$.similarity_score') AS DOUBLE) END AS similarity_score,
  CASE WHEN {has} THEN TRY_CAST(json_extract_string({raw}, '$.is_copy') AS BOOLEAN) END AS is_copy,
  CASE WHEN {has} THEN json_extract_string({raw}, '$.reasoning') END AS reasoning"""


PARSED_CTE = f"parsed AS (SELECT id, {_duck_parse('raw')} FROM verdicts)"
DEFAULTED_CTE = f"""defaulted AS (SELECT id,
  CASE WHEN has_record THEN coalesce(similarity_score, 0.0) ELSE 0.0 END AS score,
  CASE WHEN has_record THEN coalesce(is_copy, false) ELSE false END AS is_copy,
  CASE WHEN has_record THEN coalesce(reasoning, {q(MISSING_REASONING)}) ELSE {q(NO_ANALYSIS_REASONING)} END AS reasoning
FROM parsed)"""


def defaulted_verdicts(spark, sf):
    v = binding(spark, sf, "verdicts")
    return L.default_verdict(L.parse_verdicts(v, "raw")).drop("raw", "has_record")


@register("verdict_label", VERDICTS_PREFIX + ",\n" + PARSED_CTE + ",\n" + DEFAULTED_CTE + f"""
SELECT id, CASE WHEN is_copy THEN {q(COPY_LABEL)} ELSE {q(UNIQUE_LABEL)} END AS verdict,
       CAST(CAST(round(score / 100 * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS score_pct FROM defaulted""")
def q_verdict_label(spark, sf):
    d = defaulted_verdicts(spark, sf)
    return d.select("id", C.verdict_label("is_copy").alias("verdict"),
                    C.percent_label(F.col("score") / 100).alias("score_pct"))


@register("validate_requests", IDEAS_PREFIX + """
SELECT idea_id,
  CASE WHEN user_idea IS NULL OR user_idea = '' THEN 'missing idea'
       WHEN user_city IS NULL OR user_city = '' THEN 'missing city'
       WHEN founding_year IS NULL OR founding_year = 0 THEN 'missing year' END AS reason,
  NOT (user_idea IS NULL OR user_idea = '' OR user_city IS NULL OR user_city = ''
       OR founding_year IS NULL OR founding_year = 0) AS is_valid
FROM ideas""")
def q_validate_requests(spark, sf):
    return validate_requests(binding(spark, sf, "ideas"), YearBounds()).select("idea_id", "reason", "is_valid")


# ---------------------------------------------------------------------------
# 2.3 filters and guards
# ---------------------------------------------------------------------------


@register("funded_only", PREFIX + "\nSELECT id, funding FROM clean WHERE funding > 0")
def q_funded_only(spark, sf):
    return funded_only(cleaned_catalog(spark, sf)).select("id", "funding")


@register("ids_in", PREFIX + "\nSELECT id, company FROM clean WHERE id IN (SELECT doc_id FROM labels)")
def q_ids_in(spark, sf):
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return ids_in(cleaned_catalog(spark, sf), labels).select("id", "company")


@register("min_rows_guard", PREFIX + "\nSELECT id, funding FROM clean WHERE funding > 0")
def q_min_rows_guard(spark, sf):
    return min_rows_guard(funded_only(cleaned_catalog(spark, sf))).select("id", "funding")


# ---------------------------------------------------------------------------
# 2.4 joins, 2.5 vectors
# ---------------------------------------------------------------------------


@register("lookup_in_rank_order", PREFIX + ",\n" + EMB_KNN + """
SELECT nb.idea_id, nb.rank, nb.id, nb.dist2, c.company, c.funding FROM nb JOIN clean c ON c.id = nb.id""")
def q_lookup_in_rank_order(spark, sf):
    return lookup_in_rank_order(embedding_neighbours(spark, sf), cleaned_catalog(spark, sf),
                                ["company", "funding"])


@register("frequency_encode", TRAIN_PREFIX + f""",
cc AS (SELECT coalesce(city, {q(FEATURE_MISSING_TOKEN)}) AS value, count(*) AS n FROM clean GROUP BY 1),
ic AS (SELECT coalesce(industries, {q(FEATURE_MISSING_TOKEN)}) AS value, count(*) AS n FROM clean GROUP BY 1)
SELECT c.id, CAST(coalesce(cc.n, 0) AS DOUBLE) AS city_count, CAST(coalesce(ic.n, 0) AS DOUBLE) AS industry_count
FROM clean c LEFT JOIN cc ON cc.value = coalesce(c.city, {q(FEATURE_MISSING_TOKEN)})
LEFT JOIN ic ON ic.value = coalesce(c.industries, {q(FEATURE_MISSING_TOKEN)})""")
def q_frequency_encode(spark, sf):
    c = training_catalog(spark, sf)
    x = M.frequency_encode(c, M.frequency_table(c, "city"), "city", "city_count")
    x = M.frequency_encode(x, M.frequency_table(c, "industries"), "industries", "industry_count")
    return x.select("id", "city_count", "industry_count")


KNN_SQL = "WITH " + EMB_KNN + "\nSELECT * FROM nb"


@register("knn_join", KNN_SQL)
def q_knn_join(spark, sf):
    # the block-grid layout (no broadcast): ideas and catalog both hashed into blocks
    return embedding_neighbours(spark, sf, broadcast_budget_bytes=0, idea_block_rows=128,
                                catalog_block_rows=256)


@register("embed_text", "WITH " + O.encoder_ctes("dv", "documents", "doc_id", "text") + """
SELECT vid AS doc_id, CAST(b AS INTEGER) AS bucket, round(v, 6) AS weight FROM dv WHERE v <> 0""")
def q_embed_text(spark, sf):
    docs = table(spark, sf, "documents")
    v = embed_text(docs, "text", "doc_id")
    # posexplode_outer: the vector always has ``dim`` entries, and the plain form
    # makes the optimizer infer size(embedding) > 0 below the projection, which
    # would run the encoder twice.
    return (v.select("doc_id", F.posexplode_outer("embedding").alias("bucket", "w"))
            .where(F.col("w") != 0)
            .select("doc_id", F.col("bucket").cast("int").alias("bucket"),
                    F.round(F.col("w").cast("double"), 6).alias("weight")))


@register("l2_distance", "WITH " + O.list_vector_cte("ev", "embeddings", "vec_id", "embedding") + """
SELECT a.vid AS idea_id, c.vid AS id, round(sum((a.v - c.v) * (a.v - c.v)), 6) AS dist2
FROM ev a JOIN ev c ON c.vid = a.vid + 1 AND a.b = c.b GROUP BY a.vid, c.vid""")
def q_l2_distance(spark, sf):
    e = table(spark, sf, "embeddings")
    a = e.select(F.col("vec_id").alias("idea_id"), F.col("embedding").alias("ea"))
    b = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("eb"))
    j = a.join(b, F.col("id") == F.col("idea_id") + 1)
    return j.select("idea_id", "id", F.round(l2_distance("ea", "eb"), 6).alias("dist2"))


@register("top_k_similar", KNN_SQL)
def q_top_k_similar(spark, sf):
    return embedding_neighbours(spark, sf)


@register("top_match", "WITH " + EMB_KNN + "\nSELECT idea_id, id, dist2 FROM nb WHERE rank = 1")
def q_top_match(spark, sf):
    return top_match(embedding_neighbours(spark, sf)).select("idea_id", "id", "dist2")


STACKED = ["starting_year", "founders_count", "employees_count"]


@register("hstack_features", PREFIX + ",\n" + O.encoder_ctes("cvec", "clean", "id", "description") + f"""
SELECT vid AS id, CAST(b AS INTEGER) AS pos, round(v, 6) AS feature FROM cvec""" + "".join(
    f"\nUNION ALL\nSELECT id, {M.ENCODER_DIM + i}, CAST({c} AS DOUBLE) FROM clean" for i, c in enumerate(STACKED)))
def q_hstack_features(spark, sf):
    x = hstack_features(with_embedding(cleaned_catalog(spark, sf), "description"), "embedding", STACKED)
    return (x.select("id", F.posexplode_outer(vector_to_array("features")).alias("pos", "v"))
            .select("id", F.col("pos").cast("int").alias("pos"), F.round("v", 6).alias("feature")))


# ---------------------------------------------------------------------------
# 2.6 aggregations
# ---------------------------------------------------------------------------

EMB_ROWS = EMB_KNN + """,
rows AS (SELECT nb.idea_id, nb.rank, nb.id, nb.dist2, c.company, c.industries, c.funding
         FROM nb JOIN clean c ON c.id = nb.id),
""" + O.neighbour_stats_ctes(K)


def embedding_stats(spark, sf):
    rows = lookup_in_rank_order(embedding_neighbours(spark, sf), cleaned_catalog(spark, sf),
                                ["company", "industries", "funding"])
    return neighbour_stats(rows, K)


@register("funded_count", PREFIX + ",\n" + EMB_ROWS + "\nSELECT idea_id, funded_count FROM stats")
def q_funded_count(spark, sf):
    return embedding_stats(spark, sf).select("idea_id", "funded_count")


@register("avg_funded", PREFIX + ",\n" + EMB_ROWS + "\nSELECT idea_id, avg_funding FROM stats")
def q_avg_funded(spark, sf):
    return embedding_stats(spark, sf).select("idea_id", "avg_funding")


@register("industry_mode", PREFIX + ",\n" + EMB_ROWS + "\nSELECT idea_id, predicted_industry FROM stats")
def q_industry_mode(spark, sf):
    return embedding_stats(spark, sf).select("idea_id", "predicted_industry")


@register("value_counts", PREFIX + """
SELECT funding_round, CAST(count(*) AS BIGINT) AS n FROM scanned WHERE funding_round IS NOT NULL GROUP BY 1""")
def q_value_counts(spark, sf):
    return P.value_counts(scanned_catalog(spark, sf), "funding_round").select(
        "funding_round", F.col("n").cast("bigint").alias("n"))


def _top_sql(col: str, n: int = 10) -> str:
    return f"""SELECT '{col}' AS column_name, value, n, CAST(rnk AS INTEGER) AS rank FROM (
  SELECT {col} AS value, CAST(count(*) AS BIGINT) AS n,
         row_number() OVER (ORDER BY count(*) DESC, {col}) AS rnk
  FROM scanned WHERE {col} IS NOT NULL GROUP BY {col}) t WHERE rnk <= {n}"""


@register("top10_categories", PREFIX + "\n" + _top_sql("city") + "\nUNION ALL\n" + _top_sql("industries_raw"))
def q_top10_categories(spark, sf):
    s = scanned_catalog(spark, sf)
    out = None
    for col in ("city", "industries_raw"):
        t = P.top_categories(s, col, 10).select(F.lit(col).alias("column_name"), F.col(col).alias("value"),
                                                F.col("n").cast("bigint").alias("n"), "rank")
        out = t if out is None else out.unionByName(t)
    return out


@register("mean_by_group_top10", PREFIX + """
SELECT city, round(avg(funding), 4) AS mean_value FROM clean WHERE city IS NOT NULL
GROUP BY city ORDER BY avg(funding) DESC NULLS LAST, city LIMIT 10""")
def q_mean_by_group_top10(spark, sf):
    return P.mean_by_group_top(cleaned_catalog(spark, sf), "city", "funding", 10)


@register("ensemble_mean_std", "WITH " + MEMBER_STATS_SQL + """
SELECT id, round(mean_pred, 6) AS mean_pred, round(std_pred, 6) AS std_pred FROM per_id""")
def q_ensemble_mean_std(spark, sf):
    return member_stats_frame(spark, sf).select("id", F.round("mean_pred", 6).alias("mean_pred"),
                                                F.round("std_pred", 6).alias("std_pred"))


@register("rmse", "WITH " + MEMBER_STATS_SQL + """
SELECT round(sqrt(avg((y - mean_pred) * (y - mean_pred))), 6) AS rmse FROM per_id""")
def q_rmse(spark, sf):
    return M.rmse(member_stats_frame(spark, sf), "y", "mean_pred").select(F.round("rmse", 6).alias("rmse"))


@register("median_abs_error", "WITH " + MEMBER_STATS_SQL + """
SELECT round(quantile_cont(abs((exp(y) - 1) - (exp(mean_pred) - 1)), 0.5), 4) AS median_abs_error FROM per_id""")
def q_median_abs_error(spark, sf):
    r = M.median_abs_error(member_stats_frame(spark, sf), "y", "mean_pred")
    return r.select(F.round("median_abs_error", 4).alias("median_abs_error"))


@register("interval_coverage", "WITH " + MEMBER_STATS_SQL + """
SELECT round(avg(CAST((exp(y) - 1) BETWEEN (exp(mean_pred - 1.96 * std_pred) - 1)
                                        AND (exp(mean_pred + 1.96 * std_pred) - 1) AS DOUBLE)), 6) AS coverage
FROM per_id""")
def q_interval_coverage(spark, sf):
    st = member_stats_frame(spark, sf)
    _, lower, upper = M.prediction_interval("mean_pred", "std_pred", "log1p")
    x = st.select("y", lower.alias("lower"), upper.alias("upper"))
    return M.interval_coverage(x, "y", "lower", "upper").select(F.round("coverage", 6).alias("coverage"))


# ---------------------------------------------------------------------------
# 2.7 profiling and chart data
# ---------------------------------------------------------------------------

SCANNED_TYPES = [("id", "bigint")] + [(c, "string") for c in O.RAW_COLS]


@register("profile_columns", PREFIX + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, '{t}' AS dtype, CAST(count(*) AS BIGINT) AS rows, "
    f"CAST(count({c}) AS BIGINT) AS non_null, CAST(count(*) - count({c}) AS BIGINT) AS nulls FROM scanned"
    for c, t in SCANNED_TYPES))
def q_profile_columns(spark, sf):
    return P.profile_columns(scanned_catalog(spark, sf))


DESCRIBE_NUM = ["id", "funding", "starting_year", "founders_count", "employees_count", "employees_mid", "founders"]
DESCRIBE_TEXT = ["company", "description", "industries", "city", "funding_round"]


def _describe_sql() -> str:
    parts = []
    for c in DESCRIBE_NUM:
        x = f"CAST({c} AS DOUBLE)"
        stats = [("count", f"CAST(count({x}) AS DOUBLE)"), ("mean", f"avg({x})"), ("std", f"stddev_samp({x})"),
                 ("min", f"min({x})"), ("25%", f"quantile_cont({x}, 0.25)"), ("50%", f"quantile_cont({x}, 0.5)"),
                 ("75%", f"quantile_cont({x}, 0.75)"), ("max", f"max({x})")]
        for s, e in stats:
            parts.append(f"SELECT '{c}' AS column, '{s}' AS stat, round({e}, 4) AS num_value, "
                         f"CAST(NULL AS VARCHAR) AS text_value FROM clean")
    for c in DESCRIBE_TEXT:
        cnt = f"(SELECT {c} AS v, count(*) AS n FROM clean WHERE {c} IS NOT NULL GROUP BY {c})"
        parts.append(f"SELECT '{c}', 'count', CAST(sum(n) AS DOUBLE), CAST(NULL AS VARCHAR) FROM {cnt}")
        parts.append(f"SELECT '{c}', 'unique', CAST(count(*) AS DOUBLE), CAST(NULL AS VARCHAR) FROM {cnt}")
        parts.append(f"SELECT '{c}', 'top', CAST(NULL AS DOUBLE), (SELECT v FROM {cnt} ORDER BY n DESC, v LIMIT 1)")
        parts.append(f"SELECT '{c}', 'freq', CAST(max(n) AS DOUBLE), CAST(NULL AS VARCHAR) FROM {cnt}")
    return "\nUNION ALL\n".join(parts)


@register("describe_all", PREFIX + "\n" + _describe_sql())
def q_describe_all(spark, sf):
    cols = DESCRIBE_NUM + DESCRIBE_TEXT
    return P.describe_all(written(cleaned_catalog(spark, sf).select(*cols), "described"), cols, digits=4)   # joined once


DUP_COLS = list(O.RAW_COLS)


@register("duplicate_rows", PREFIX + f"""
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicates FROM (
  SELECT count(*) AS n FROM scanned GROUP BY {', '.join(DUP_COLS)}) t""")
def q_duplicate_rows(spark, sf):
    return P.duplicate_rows(written(scanned_catalog(spark, sf).select(*DUP_COLS), "scanned"), DUP_COLS)   # joined once


@register("head", PREFIX + "\nSELECT id, company, funding, city FROM clean ORDER BY id LIMIT 5")
def q_head(spark, sf):
    return P.head(cleaned_catalog(spark, sf).select("id", "company", "funding", "city"), "id", 5)


def _events(spark, sf):
    return table(spark, sf, "events").select("event_type", "value")


def _hist_sql(src: str, col: str) -> str:
    return f"""WITH s AS (
  SELECT count({col}) AS n, min({col}) AS lo, max({col}) AS hi,
         quantile_cont({col}, 0.75) - quantile_cont({col}, 0.25) AS iqr FROM {src} WHERE {col} IS NOT NULL),
b AS (SELECT greatest(CAST(ceil(log2(n)) AS BIGINT) + 1,
                      CASE WHEN iqr > 0 THEN CAST(ceil((hi - lo) / (2.0 * iqr * pow(n, -1.0 / 3.0))) AS BIGINT) ELSE 0 END) AS nb,
             lo, hi FROM s),
w AS (SELECT nb, lo, (hi - lo) / nb AS width FROM b)
SELECT every.bin, round(w.lo + every.bin * w.width, 6) AS lo, round(w.lo + (every.bin + 1) * w.width, 6) AS hi,
       CAST(coalesce(n, 0) AS BIGINT) AS n
FROM (SELECT unnest(range((SELECT nb FROM w))) AS bin) every CROSS JOIN w
LEFT JOIN (SELECT least(CAST(floor((e.{col} - w.lo) / w.width) AS BIGINT), w.nb - 1) AS bin, count(*) AS n
           FROM {src} e, w WHERE e.{col} IS NOT NULL GROUP BY 1) t ON t.bin = every.bin"""


@register("histogram", _hist_sql("events", "value"))
def q_histogram(spark, sf):
    return P.histogram(_events(spark, sf), "value")


def _kde_sql(src: str, col: str) -> str:
    return f"""WITH s AS (
  SELECT count({col}) AS n, min({col}) AS lo, max({col}) AS hi, stddev_samp({col}) AS sd FROM {src} WHERE {col} IS NOT NULL),
h AS (SELECT n, sd * pow(n, -1.0 / 5.0) AS bw, lo, hi FROM s),
g AS (SELECT n, bw, (lo - 3.0 * bw) AS glo, ((hi + 3.0 * bw) - (lo - 3.0 * bw)) / 199 AS step FROM h),
grid AS (SELECT r.range AS point, g.glo + r.range * g.step AS x, g.bw, g.n FROM g, range(200) r)
SELECT CAST(point AS INTEGER) AS point, round(x, 6) AS x,
       round(sum(exp(-0.5 * pow((x - e.{col}) / bw, 2))) * (1.0 / (n * bw * sqrt(2.0 * pi()))), 10) AS density
FROM grid, {src} e WHERE e.{col} IS NOT NULL GROUP BY point, x, bw, n"""


@register("kde_curve", _kde_sql("events", "value"))
def q_kde_curve(spark, sf):
    events = table(spark, sf, "events")
    return P.kde_curve(events.select("event_type", "value"), "value", 200)


def _box_sql(src: str, col: str, by: str) -> str:
    return f"""WITH q AS (
  SELECT {by}, count(*) AS n, quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.5) AS median,
         quantile_cont({col}, 0.75) AS q3 FROM {src} WHERE {col} IS NOT NULL GROUP BY {by}),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_fence, q3 + 1.5 * (q3 - q1) AS hi_fence FROM q)
SELECT f.{by}, CAST(f.n AS BIGINT) AS n, round(f.q1, 6) AS q1, round(f.median, 6) AS median, round(f.q3, 6) AS q3,
       round(min(CASE WHEN e.{col} >= f.lo_fence THEN e.{col} END), 6) AS whisker_lo,
       round(max(CASE WHEN e.{col} <= f.hi_fence THEN e.{col} END), 6) AS whisker_hi,
       CAST(count(*) FILTER (WHERE e.{col} < f.lo_fence OR e.{col} > f.hi_fence) AS BIGINT) AS n_outliers
FROM {src} e JOIN f ON e.{by} IS NOT DISTINCT FROM f.{by}
WHERE e.{col} IS NOT NULL GROUP BY f.{by}, f.n, f.q1, f.median, f.q3"""


@register("box_stats", _box_sql("events", "value", "event_type"))
def q_box_stats(spark, sf):
    return P.box_stats(_events(spark, sf), "value", "event_type")


SCATTER_PAIRS = [("founders", "funding"), ("starting_year", "funding"), ("employees_mid", "funding"),
                 ("starting_year", "employees_mid"), ("starting_year", "starting_year"),
                 ("employees_mid", "employees_mid"), ("funding", "funding")]


def _scatter_sql() -> str:
    cols = sorted({c for p in SCATTER_PAIRS for c in p})
    mm = ", ".join(f"min(CAST({c} AS DOUBLE)) AS lo_{c}, max(CAST({c} AS DOUBLE)) AS hi_{c}" for c in cols)

    def idx(c):
        w = f"(CASE WHEN m.hi_{c} > m.lo_{c} THEN (m.hi_{c} - m.lo_{c}) / 10 ELSE 1.0 END)"
        return f"CAST(least(floor((CAST({c} AS DOUBLE) - m.lo_{c}) / {w}), 9) AS INTEGER)"

    parts = [f"""SELECT '{x}' AS x, '{y}' AS y, {idx(x)} AS bx, {idx(y)} AS by, CAST(count(*) AS BIGINT) AS n
FROM clean, m WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1, 2, 3, 4""" for x, y in SCATTER_PAIRS]
    return f",\nm AS (SELECT {mm} FROM clean)\n" + "\nUNION ALL\n".join(parts)


@register("binned_scatter", PREFIX + _scatter_sql())
def q_binned_scatter(spark, sf):
    return P.binned_scatter(cleaned_catalog(spark, sf), SCATTER_PAIRS, 10)


@register("bar_of_top_rows", PREFIX + """
SELECT city, round(avg(funding), 4) AS mean_value, CAST(count(*) AS BIGINT) AS n, round(stddev_samp(funding), 4) AS std_value
FROM (SELECT * FROM clean ORDER BY funding DESC, id LIMIT 10) t GROUP BY city""")
def q_bar_of_top_rows(spark, sf):
    return P.bar_of_top_rows(cleaned_catalog(spark, sf), "funding", "city", 10, "id")


@register("count_top_categories", PREFIX + """
SELECT industries_raw, CAST(n AS BIGINT) AS n, CAST(rnk AS INTEGER) AS rank FROM (
  SELECT industries_raw, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, industries_raw) AS rnk
  FROM scanned WHERE industries_raw IS NOT NULL GROUP BY industries_raw) t WHERE rnk <= 10""")
def q_count_top_categories(spark, sf):
    return P.count_top_categories(scanned_catalog(spark, sf), "industries_raw", 10)


CORR_COLS = ["starting_year", "employees_mid", "funding"]


@register("correlation_matrix", PREFIX + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS x, '{b}' AS y, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr FROM clean"
    for a in CORR_COLS for b in CORR_COLS))
def q_correlation_matrix(spark, sf):
    return P.correlation_matrix(cleaned_catalog(spark, sf), CORR_COLS)


# ---------------------------------------------------------------------------
# 2.8 machine learning
# ---------------------------------------------------------------------------

QUERY_TRAIN = M.TrainParams(n_members=5, num_trees=20, max_depth=8)
_TRAINED: dict[tuple[str, str], str] = {}


def _split_sql() -> str:
    h = "md5('42:' || CAST(id AS VARCHAR))"
    return f"(CAST(('0x' || substr({h}, 1, 8)) AS BIGINT) % 100 < {VALIDATION_PERCENT})"


@register("split_train_validation", PREFIX + f"\nSELECT id, {_split_sql()} AS is_validation FROM clean")
def q_split_train_validation(spark, sf):
    return cleaned_catalog(spark, sf).select("id", M.validation_flag("id").alias("is_validation"))


TRAIN_ROWS = TRAIN_PREFIX + f""",
train AS (SELECT * FROM clean WHERE funding > 0 AND NOT {_split_sql()})"""


@register("fit_features", TRAIN_ROWS + f"""
SELECT 'city' AS feature, coalesce(city, {q(FEATURE_MISSING_TOKEN)}) AS value, CAST(count(*) AS BIGINT) AS n FROM train GROUP BY 2
UNION ALL
SELECT 'industries', coalesce(industries, {q(FEATURE_MISSING_TOKEN)}), CAST(count(*) AS BIGINT) FROM train GROUP BY 2""")
def q_fit_features(spark, sf):
    train, _ = M.split_train_validation(funded_only(training_catalog(spark, sf)))
    fm = M.FundingFeatures().fit(train)
    return (fm.city_counts.select(F.lit("city").alias("feature"), "value", "n")
            .unionByName(fm.industry_counts.select(F.lit("industries").alias("feature"), "value", "n")))


@register("transform_features", TRAIN_ROWS + f""",
funded AS (SELECT * FROM clean WHERE funding > 0),
cc AS (SELECT coalesce(city, {q(FEATURE_MISSING_TOKEN)}) AS value, count(*) AS n FROM train GROUP BY 1),
ic AS (SELECT coalesce(industries, {q(FEATURE_MISSING_TOKEN)}) AS value, count(*) AS n FROM train GROUP BY 1)
SELECT f.id, f.starting_year, f.founders_count, f.employees_count,
       CAST(coalesce(cc.n, 0) AS DOUBLE) AS city_count, CAST(coalesce(ic.n, 0) AS DOUBLE) AS industry_count
FROM funded f LEFT JOIN cc ON cc.value = coalesce(f.city, {q(FEATURE_MISSING_TOKEN)})
LEFT JOIN ic ON ic.value = coalesce(f.industries, {q(FEATURE_MISSING_TOKEN)})""")
def q_transform_features(spark, sf):
    funded = funded_only(training_catalog(spark, sf))
    train, _ = M.split_train_validation(funded)
    x = M.FundingFeatures().fit(train).transform(funded)
    arr = vector_to_array("features")
    names = ["starting_year", "founders_count", "employees_count", "city_count", "industry_count"]
    return x.select("id", *[arr[64 + i].alias(n) for i, n in enumerate(names)])


def trained_model_dir(spark, sf) -> str:
    """Train once per session and scale (quick profile), reuse afterwards."""
    key = (spark.sparkContext.applicationId, sf.rstrip("/"))
    if key not in _TRAINED:
        d = scratch(spark, "models")
        M.train_funding_model(training_catalog(spark, sf), d, QUERY_TRAIN).collect()
        _TRAINED[key] = d
    return _TRAINED[key]


def _validation_features(spark, sf, model_dir):
    loaded = M.load_model(spark, model_dir)
    funded = funded_only(training_catalog(spark, sf))
    _, valid = M.split_train_validation(funded)
    return loaded, loaded.features.transform(valid.withColumn("label", F.log1p("funding")))


@register("fit_ensemble")
def q_fit_ensemble(spark, sf):
    """Every fitted member over the validation rows: (id, member, pred)."""
    loaded, x = _validation_features(spark, sf, trained_model_dir(spark, sf))
    return loaded.ensemble.member_predictions(x, "id")


@register("predict_ensemble")
def q_predict_ensemble(spark, sf):
    loaded, x = _validation_features(spark, sf, trained_model_dir(spark, sf))
    return loaded.ensemble.predict(x).select("id", "mean_log")


@register("predict_with_uncertainty")
def q_predict_with_uncertainty(spark, sf):
    loaded, x = _validation_features(spark, sf, trained_model_dir(spark, sf))
    return loaded.ensemble.predict_with_uncertainty(x).select("id", "label", "mean_log", "std_log")


@register("train_funding_model", TRAIN_PREFIX + f"""
SELECT CAST(count(*) FILTER (WHERE NOT {_split_sql()}) AS BIGINT) AS n_train,
       CAST(count(*) FILTER (WHERE {_split_sql()}) AS BIGINT) AS n_validation, true AS has_rmse
FROM clean WHERE funding > 0""")
def q_train_funding_model(spark, sf):
    """Row counts of the training run; the error of a forest differs between libraries and is only said to exist."""
    got = M.train_funding_model(training_catalog(spark, sf), scratch(spark, "models"), QUERY_TRAIN)
    return got.select("n_train", "n_validation", F.col("rmse_log").isNotNull().alias("has_rmse"))


@register("predict_funding")
def q_predict_funding(spark, sf):
    return M.predict_funding(binding(spark, sf, "ideas"), trained_model_dir(spark, sf))


@register("legacy_predict")
def q_legacy_predict(spark, sf):
    d = scratch(spark, "legacy-models")
    M.train_legacy_model(training_catalog(spark, sf), d)
    return M.predict_funding(binding(spark, sf, "ideas"), d)


@register("build_model_inputs", IDEAS_PREFIX + """
SELECT idea_id, user_idea AS description, coalesce(CAST(founding_year AS DOUBLE), 0.0) AS starting_year,
       0.0 AS founders_count, 0.0 AS employees_count, coalesce(user_city, '') AS city, '' AS industries
FROM ideas""")
def q_build_model_inputs(spark, sf):
    return M.build_model_inputs(binding(spark, sf, "ideas"))


@register("save_model", TRAIN_ROWS + f"""
SELECT 'log1p' AS target_transform, {q(M.ENCODER_NAME)} AS embed_model, CAST({M.ENCODER_DIM} AS BIGINT) AS dim,
       CAST({QUERY_TRAIN.n_members} AS BIGINT) AS n_members, CAST({QUERY_TRAIN.num_trees} AS BIGINT) AS num_trees,
       CAST({QUERY_TRAIN.max_depth} AS BIGINT) AS max_depth, CAST(count(*) AS BIGINT) AS n_train, true AS uncertainty,
       CAST(count(DISTINCT coalesce(city, {q(FEATURE_MISSING_TOKEN)})) AS BIGINT) AS n_cities,
       CAST(count(DISTINCT coalesce(industries, {q(FEATURE_MISSING_TOKEN)})) AS BIGINT) AS n_industries
FROM train""")
def q_save_model(spark, sf):
    """Saved metadata, with the sizes of the saved count tables."""
    d = trained_model_dir(spark, sf)
    feats = M.load_model(spark, d).features
    meta = spark.read.json(os.path.join(d, "pipeline", "meta")).drop(
        "trained_at", "feature_order", "z_calibrated", "data_digest", "code_version")
    n = F.count(F.lit(1))
    return meta.select("*", feats.city_counts.agg(n).scalar().alias("n_cities"),
                       feats.industry_counts.agg(n).scalar().alias("n_industries"))


@register("load_model")
def q_load_model(spark, sf):
    loaded, x = _validation_features(spark, sf, trained_model_dir(spark, sf))
    scored = loaded.ensemble.predict_with_uncertainty(x)
    return scored.select("id", F.lit(loaded.kind).alias("kind"), "mean_log", "std_log")


# ---------------------------------------------------------------------------
# 2.9 pair analysis
# ---------------------------------------------------------------------------


PAIRS_SQL = PREFIX + ",\n" + EMB_KNN + """,
pairs AS (SELECT nb.idea_id, nb.id, i.description AS user_idea, c.description, c.company
          FROM nb JOIN clean i ON i.id = nb.idea_id JOIN clean c ON c.id = nb.id WHERE nb.rank = 1)"""


def pairs_frame(spark, sf):
    c = cleaned_catalog(spark, sf)
    top = top_match(embedding_neighbours(spark, sf)).select("idea_id", "id")
    return (top.join(c.select(F.col("id").alias("idea_id"), F.col("description").alias("user_idea")), "idea_id")
            .join(c.select("id", "description", "company"), "id"))


@register("build_prompts", PAIRS_SQL + """
SELECT idea_id, id,
  'Compare two startup descriptions and say whether the first copies the second.' || chr(10) ||
  'Idea: "' || coalesce(user_idea, '') || '"' || chr(10) ||
  'Existing company ' || coalesce(company, '') || ': "' || coalesce(description, '') || '"' || chr(10) ||
  'Answer with JSON: {"similarity_score": 0-100, "is_copy": true|false, "reasoning": "one or two sentences"}' AS prompt
FROM pairs""")
def q_build_prompts(spark, sf):
    return L.build_prompts(pairs_frame(spark, sf)).select("idea_id", "id", "prompt")


SCORED_SQL = PAIRS_SQL + """,
words AS (SELECT idea_id, id, company, """ + _duck_words("user_idea") + " AS wa, " + _duck_words("description") + """ AS wb FROM pairs),
ju AS (SELECT idea_id, id, company, len(list_intersect(wa, wb)) AS i,
              len(wa) + len(wb) - len(list_intersect(wa, wb)) AS u FROM words),
scored AS (SELECT idea_id, id, company, CASE WHEN u = 0 THEN 0.0 ELSE round(100.0 * i / u, 0) END AS score,
                  'The texts share ' || CAST(i AS VARCHAR) || ' of ' || CAST(u AS VARCHAR) || ' distinct words.' AS reasoning
           FROM ju)"""


@register("score_pairs", SCORED_SQL + """
SELECT idea_id, id, score, score >= 80.0 AS is_copy, reasoning FROM scored""")
def q_score_pairs(spark, sf):
    return L.score_pairs(pairs_frame(spark, sf)).select("idea_id", "id", "score", "is_copy", "reasoning")


@register("parse_verdicts", VERDICTS_PREFIX + ",\n" + PARSED_CTE + "\nSELECT * FROM parsed")
def q_parse_verdicts(spark, sf):
    return L.parse_verdicts(binding(spark, sf, "verdicts"), "raw").drop("raw")


@register("default_verdict", VERDICTS_PREFIX + ",\n" + PARSED_CTE + ",\n" + DEFAULTED_CTE + "\nSELECT * FROM defaulted")
def q_default_verdict(spark, sf):
    return defaulted_verdicts(spark, sf)


BLOB = r"""nullif(regexp_extract(raw, '\{([^{}"]|"([^"\\]|\\.)*")*\}', 0), '')"""


@register("extract_json_blob", VERDICTS_PREFIX + f""",
blobs AS (SELECT id, {BLOB} AS blob FROM verdicts)
SELECT id, blob, {_duck_parse('blob')} FROM blobs""")
def q_extract_json_blob(spark, sf):
    v = binding(spark, sf, "verdicts").withColumn("blob", L.extract_json_blob("raw"))
    return L.parse_verdicts(v, "blob").drop("raw")


# ---------------------------------------------------------------------------
# 2.10 composite queries, 2.11 streaming
# ---------------------------------------------------------------------------


@register("evaluate_ideas", Q1_SQL)
def q_evaluate_ideas(spark, sf):
    return evaluate_ideas(binding(spark, sf, "ideas"), cleaned_catalog(spark, sf), k=K)


@register("evaluate_ideas_full")
def q_evaluate_ideas_full(spark, sf):
    return evaluate_ideas_full(binding(spark, sf, "ideas"), cleaned_catalog(spark, sf),
                               trained_model_dir(spark, sf), k=K)


COPYCAT_SQL = (IDEA_SCORES_SQL + """
SELECT idea_id, company AS top_match_name, score, score >= 80.0 AS is_copy, reasoning,
       CASE WHEN score >= 80.0 THEN """ + q(COPY_LABEL) + " ELSE " + q(UNIQUE_LABEL) + """ END AS verdict
FROM scored""")


@register("copycat_report", COPYCAT_SQL)
def q_copycat_report(spark, sf):
    return copycat_report(binding(spark, sf, "ideas"), cleaned_catalog(spark, sf), k=K)


@register("smoke_predictions")
def q_smoke_predictions(spark, sf):
    # every request of the ideas table, industry unknown (as in the smoke script)
    ideas = binding(spark, sf, "ideas")
    preds = M.predict_funding(ideas, trained_model_dir(spark, sf))
    return ideas.select("idea_id", "user_city", "founding_year").join(preds, "idea_id")


BOX_STATS = ("n", "q1", "median", "q3", "whisker_lo", "whisker_hi", "n_outliers")


def _profile_union_sql() -> str:
    def top(col):
        return (f"SELECT {col} AS name, count(*) AS n FROM scanned WHERE {col} IS NOT NULL GROUP BY {col} "
                f"ORDER BY n DESC, name LIMIT 10")

    p1 = " UNION ALL ".join(
        f"SELECT '{c}' AS name, count({c}) AS non_null, count(*) - count({c}) AS nulls FROM scanned" for c, _ in SCANNED_TYPES)
    corr = " UNION ALL ".join(
        f"SELECT '{a}|{b}' AS name, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr FROM clean"
        for a in CORR_COLS for b in CORR_COLS)
    m, scatter = _scatter_sql().lstrip(",\n").split("\n", 1)
    sections = [
        ("profile", p1, "name", ("non_null", "nulls")),
        ("duplicates", f"SELECT 'rows' AS name, coalesce(sum(n - 1), 0) AS n_duplicates FROM "
                       f"(SELECT count(*) AS n FROM scanned GROUP BY {', '.join(DUP_COLS)}) t", "name", ("n_duplicates",)),
        ("count city", top("city"), "name", ("n",)),
        ("count industries", top("industries_raw"), "name", ("n",)),
        ("count funding_round", "SELECT funding_round AS name, count(*) AS n FROM scanned "
                                "WHERE funding_round IS NOT NULL GROUP BY funding_round", "name", ("n",)),
        ("mean by city", "SELECT city AS name, round(avg(funding), 4) AS mean_value FROM clean WHERE city IS NOT NULL "
                         "GROUP BY city ORDER BY avg(funding) DESC NULLS LAST, city LIMIT 10", "name", ("mean_value",)),
        ("histogram funding", _hist_sql("clean", "funding"), "bin", ("n",)),
        ("kde funding", _kde_sql("clean", "funding"), "point", ("density",)),
        ("box funding", _box_sql("clean", "funding", "funding_round"), "funding_round", BOX_STATS),
        ("bar of top rows", "SELECT city AS name, round(avg(funding), 4) AS mean_value, count(*) AS n, "
                            "round(stddev_samp(funding), 4) AS std_value FROM (SELECT * FROM clean ORDER BY funding DESC, id LIMIT 10) t "
                            "GROUP BY city", "name", ("mean_value", "n", "std_value")),
        ("correlation", corr, "name", ("corr",)),
        ("scatter", f"SELECT concat_ws('|', x, y, bx, \"by\") AS name, n FROM ({scatter}) t", "name", ("n",)),
    ]
    ctes = [m, f"described AS ({_describe_sql()})", "first_rows AS (SELECT * FROM clean ORDER BY id LIMIT 5)"]
    ctes += [f"part_{i} AS ({sql})" for i, (_, sql, _, _) in enumerate(sections)]
    rows = ["SELECT 'describe' AS section, \"column\" AS name, stat, num_value AS value, text_value AS text FROM described",
            "SELECT 'head', CAST(id AS VARCHAR), 'funding', funding, company FROM first_rows"]
    rows += [f"SELECT '{section}', CAST({name} AS VARCHAR), '{stat}', CAST({stat} AS DOUBLE), CAST(NULL AS VARCHAR) FROM part_{i}"
             for i, (section, _, name, stats) in enumerate(sections) for stat in stats]
    return ",\n" + ",\n".join(ctes) + "\n" + "\nUNION ALL\n".join(rows)


@register("catalog_profile", PREFIX + _profile_union_sql())
def q_catalog_profile(spark, sf):
    """Every chart table and statistic of the profile as (section, name, stat, value, text) rows."""
    # the joined and scanned rows are stored once; every table below reads them
    s = written(scanned_catalog(spark, sf), "profiled")
    c = clean_catalog(s)
    nums = sorted({x for pair in SCATTER_PAIRS for x in pair} | set(DESCRIBE_NUM) | {"funding"})
    known = P.numeric_summary(c, nums)

    def part(df, section, name, *stats):
        e = F.array(*[F.struct(F.lit(st).alias("stat"), F.col(st).cast("double").alias("value")) for st in stats])
        return (df.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), F.explode(e).alias("e"))
                .select("section", "name", "e.stat", "e.value", F.lit(None).cast("string").alias("text")))

    parts = [
        P.describe_all(c, DESCRIBE_NUM + DESCRIBE_TEXT, digits=4, summary=known).select(
            F.lit("describe").alias("section"), F.col("column").alias("name"), "stat",
            F.col("num_value").alias("value"), F.col("text_value").alias("text")),
        P.head(c, "id", 5).select(F.lit("head").alias("section"), F.col("id").cast("string").alias("name"),
                                  F.lit("funding").alias("stat"), F.col("funding").alias("value"),
                                  F.col("company").alias("text")),
        part(P.profile_columns(s), "profile", "column", "non_null", "nulls"),
        part(P.duplicate_rows(s, DUP_COLS).withColumn("name", F.lit("rows")), "duplicates", "name", "n_duplicates"),
        part(P.top_categories(s, "city"), "count city", "city", "n"),
        part(P.count_top_categories(s, "industries_raw"), "count industries", "industries_raw", "n"),
        part(P.value_counts(s, "funding_round"), "count funding_round", "funding_round", "n"),
        part(P.mean_by_group_top(c, "city", "funding"), "mean by city", "city", "mean_value"),
        part(P.histogram(c, "funding", summary=known["funding"]), "histogram funding", "bin", "n"),
        part(P.kde_curve(c, "funding", summary=known["funding"]), "kde funding", "point", "density"),
        part(P.box_stats(c, "funding", "funding_round"), "box funding", "funding_round", *BOX_STATS),
        part(P.bar_of_top_rows(c, "funding", "city"), "bar of top rows", "city", "mean_value", "n", "std_value"),
        part(P.correlation_matrix(c, CORR_COLS).withColumn("name", F.concat_ws("|", "x", "y")), "correlation", "name", "corr"),
        part(P.binned_scatter(c, SCATTER_PAIRS, 10, known).withColumn("name", F.concat_ws("|", "x", "y", "bx", "by")),
             "scatter", "name", "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("evaluate_stream", Q1_SQL)
def q_evaluate_stream(spark, sf):
    base = scratch(spark, "stream")
    in_dir, out_dir = os.path.join(base, "in"), os.path.join(base, "out")
    binding(spark, sf, "ideas").write.mode("overwrite").json(in_dir)
    sq = evaluate_stream(spark, in_dir, out_dir, os.path.join(base, "checkpoint"),
                         cleaned_catalog(spark, sf), k=K)
    sq.awaitTermination()
    return spark.read.parquet(os.path.join(out_dir, "evaluated")).drop("epoch")

