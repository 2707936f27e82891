"""Neighbour lookup and summaries: F2, J1, A1-A3, C13/C12 labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venturelens.functions.cleaning import format_currency, funding_rate_label
from venturelens.schema import DEFAULT_K, UNKNOWN_INDUSTRY


def ids_in(df: DataFrame, result: DataFrame, id_col: str = "id") -> DataFrame:
    """rows of ``df`` whose id appears in ``result`` (left semi join)."""
    return df.join(result.select(id_col), id_col, "left_semi")


def lookup_in_rank_order(neighbours: DataFrame, catalog: DataFrame,
                         cols: list[str] | None = None) -> DataFrame:
    """Attach catalog columns to neighbour ids, keeping ``rank``.

    The neighbour side is ideas x k rows; AQE turns this into a broadcast join
    when that side is small and keeps a shuffle join otherwise.
    """
    right = catalog if cols is None else catalog.select("id", *cols)
    return neighbours.join(right, "id", "inner")


def neighbour_stats(rows: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """A1, A2, A3, V4 and the C12/C13 labels, one aggregate per idea.

    ``rows``: (idea_id, rank, id, dist2, company, industries, funding).
    """
    agg = rows.groupBy("idea_id").agg(
        F.count(F.lit(1)).alias("n_neighbours"),
        F.count_if(F.col("funding") > 0).alias("funded_count"),
        F.avg(F.when(F.col("funding") > 0, F.col("funding"))).alias("avg_funding"),
        F.mode("industries", deterministic=True).alias("predicted_industry"),
        F.min_by(F.struct("id", "company", "dist2"), F.col("rank")).alias("_top"),
    )
    return agg.select(
        "idea_id",
        F.coalesce("predicted_industry", F.lit(UNKNOWN_INDUSTRY)).alias("predicted_industry"),
        F.col("_top.id").alias("top_match_id"),
        F.col("_top.company").alias("top_match_name"),
        F.col("_top.dist2").alias("top_match_dist2"),
        F.col("n_neighbours").cast("bigint").alias("n_neighbours"),
        F.col("funded_count").cast("bigint").alias("funded_count"),
        F.round("avg_funding", 4).alias("avg_funding"),
        funding_rate_label("funded_count", k).alias("rate"),
        format_currency("avg_funding").alias("avg_funding_str"),
    )
