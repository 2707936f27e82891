"""Composite plans: Q1 evaluate_ideas (flagship)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venturelens.operators.guards import split_requests
from venturelens.operators.neighbours import lookup_in_rank_order, neighbour_stats
from venturelens.operators.vectors import embed_text, top_k_similar
from venturelens.schema import DEFAULT_K, UNKNOWN_INDUSTRY, YearBounds


def catalog_vectors(catalog: DataFrame, encoder=None) -> DataFrame:
    """(id, embedding) of the cleaned catalog descriptions."""
    return embed_text(catalog, "description", "id", encoder=encoder)


def idea_vectors(ideas: DataFrame, encoder=None) -> DataFrame:
    """(idea_id, embedding) of the request texts."""
    return embed_text(ideas, "user_idea", "idea_id", encoder=encoder)


def find_neighbours(ideas: DataFrame, catalog: DataFrame, k: int = DEFAULT_K,
                    encoder=None, cat_vectors: DataFrame | None = None,
                    cols: tuple[str, ...] = ("company", "industries", "funding")) -> DataFrame:
    """V1 -> V3 -> J1: ranked neighbours with their catalog columns."""
    cv = cat_vectors if cat_vectors is not None else catalog_vectors(catalog, encoder)
    nb = top_k_similar(idea_vectors(ideas, encoder), cv, k=k)
    return lookup_in_rank_order(nb, catalog, list(cols))


def evaluate_ideas(ideas: DataFrame, catalog: DataFrame, k: int = DEFAULT_K,
                   bounds: YearBounds | None = None, encoder=None,
                   cat_vectors: DataFrame | None = None) -> DataFrame:
    """Q1: per valid request, predicted industry, top match and funding stats.

    ``catalog`` is a cleaned catalog (``clean_catalog``).  Invalid requests
    (C15) are not evaluated; ``split_requests`` returns them with a reason.
    """
    valid, _ = split_requests(ideas, bounds)
    rows = find_neighbours(valid, catalog, k, encoder, cat_vectors)
    stats = neighbour_stats(rows, k)
    out = valid.select("idea_id", "user_city", "founding_year").join(stats, "idea_id", "left")
    return out.select(
        "idea_id",
        F.coalesce("predicted_industry", F.lit(UNKNOWN_INDUSTRY)).alias("predicted_industry"),
        "user_city", "founding_year", "top_match_id", "top_match_name", "top_match_dist2",
        F.coalesce("n_neighbours", F.lit(0).cast("bigint")).alias("n_neighbours"),
        F.coalesce("funded_count", F.lit(0).cast("bigint")).alias("funded_count"),
        "avg_funding",
        F.coalesce("rate", F.lit(f"0 out of {k}")).alias("rate"),
        F.coalesce("avg_funding_str", F.lit("N/A")).alias("avg_funding_str"),
    )


def copycat_report(ideas: DataFrame, catalog: DataFrame, k: int = DEFAULT_K, scorer=None,
                   threshold: float = 80.0, bounds: YearBounds | None = None, encoder=None,
                   cat_vectors: DataFrame | None = None) -> DataFrame:
    """Q3: idea, nearest company, score, copy flag, reasoning and verdict label."""
    from venturelens.functions.cleaning import verdict_label
    from venturelens.operators.pairs import score_pairs

    valid, _ = split_requests(ideas, bounds)
    rows = find_neighbours(valid, catalog, k, encoder, cat_vectors, ("company", "description"))
    top = (rows.where(F.col("rank") == 1).select("idea_id", "id", "company", "description")
           .join(valid.select("idea_id", "user_idea"), "idea_id"))
    scored = score_pairs(top, scorer, threshold, "user_idea", "description", "company")
    return scored.select("idea_id", F.col("company").alias("top_match_name"), "score", "is_copy",
                         "reasoning", verdict_label("is_copy").alias("verdict"))


def evaluate_ideas_full(ideas: DataFrame, catalog: DataFrame, model_dir: str, k: int = DEFAULT_K,
                        scorer=None, threshold: float = 80.0, bounds: YearBounds | None = None,
                        encoder=None, cat_vectors: DataFrame | None = None) -> DataFrame:
    """Q2: one nested record per valid request (profile, analysis, neighbours, funding)."""
    from venturelens.functions.cleaning import format_currency, funding_rate_label
    from venturelens.operators.model import predict_funding
    from venturelens.operators.pairs import score_pairs

    valid, _ = split_requests(ideas, bounds)
    cv = cat_vectors if cat_vectors is not None else catalog_vectors(catalog, encoder)
    nb = top_k_similar(idea_vectors(valid, encoder), cv, k=k)
    rows = lookup_in_rank_order(nb, catalog, ["company", "description", "industries", "city",
                                              "funding", "funding_round"])
    neighbour = F.struct("rank", "id", "dist2", "company", "description", "industries", "city",
                         "funding", "funding_round")
    per_idea = rows.groupBy("idea_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_neighbours"),
        F.count_if(F.col("funding") > 0).cast("bigint").alias("funded_count"),
        F.avg(F.when(F.col("funding") > 0, F.col("funding"))).alias("avg_funding"),
        F.mode("industries", deterministic=True).alias("predicted_industry"),
        F.min_by(F.struct("company", "description"), F.col("rank")).alias("top"),
        F.array_sort(F.collect_list(neighbour)).alias("similar_startups"))
    base = valid.join(per_idea, "idea_id", "left").withColumn(
        "predicted_industry", F.coalesce("predicted_industry", F.lit(UNKNOWN_INDUSTRY)))
    pairs = base.select("idea_id", "user_idea", F.col("top.company").alias("company"),
                        F.col("top.description").alias("description"))
    verdicts = score_pairs(pairs, scorer, threshold, "user_idea", "description", "company")
    preds = predict_funding(base.select("idea_id", "user_idea", "user_city", "founding_year",
                                        "predicted_industry"), model_dir,
                            industry_col="predicted_industry", encoder=encoder)
    j = base.join(verdicts.select("idea_id", "score", "is_copy", "reasoning"), "idea_id", "left") \
        .join(preds, "idea_id", "left")
    funded = F.coalesce("funded_count", F.lit(0).cast("bigint"))
    return j.select(
        "idea_id",
        F.struct("predicted_industry", "user_city", "founding_year").alias("profile"),
        F.struct(F.col("top.company").alias("top_match_name"), "score", "is_copy", "reasoning")
        .alias("ai_analysis"),
        F.coalesce("similar_startups", F.array()).alias("similar_startups"),
        F.struct(funding_rate_label(funded, k).alias("rate"),
                 format_currency("avg_funding").alias("avg_funding_str")).alias("funding_analysis"),
        F.struct("predicted_amount", "confidence", "error", "lower", "upper").alias("funding_prediction"),
    )
