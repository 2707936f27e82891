"""Registered queries of the search extensions: approximate, pruned, and from stored vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from venturelens.operators.approx import approx_top_k, recall_at
from venturelens.operators.pruned import pruned_top_k
from venturelens.operators.vector_store import VectorStore
from venturelens.operators.vectors import top_k_similar
from venturelens.plans import oracle as O
from venturelens.plans.evaluate import evaluate_ideas
from venturelens.plans.queries import EMB_KNN, K, KNN_SQL, PREFIX, Q1_SQL, cleaned_catalog, scratch
from venturelens.plans.registry import register
from venturelens.sources.bindings import binding


def _vectors(spark, sf):
    return binding(spark, sf, "idea_vectors"), binding(spark, sf, "catalog_vectors")


@register("approx_top_k")
def q_approx_top_k(spark, sf):
    ideas, catalog = _vectors(spark, sf)
    return approx_top_k(ideas, catalog, k=K, exclude_self=True)


@register("approx_recall", "WITH " + EMB_KNN + """
SELECT count(DISTINCT idea_id) AS ideas, count(*) AS n_rows, TRUE AS recall_reached FROM nb""")
def q_approx_recall(spark, sf):
    """Every idea answered in full, and at least 0.9 of the exact neighbours found."""
    ideas, catalog = _vectors(spark, sf)
    found = approx_top_k(ideas, catalog, k=K, exclude_self=True)
    recall = recall_at(found, top_k_similar(ideas, catalog, k=K, exclude_self=True))
    return (found.agg(F.countDistinct("idea_id").alias("ideas"), F.count(F.lit(1)).alias("n_rows"))
            .join(F.broadcast(recall.select((F.col("recall") >= 0.9).alias("recall_reached")))))      # one row each


@register("pruned_top_k", KNN_SQL)
def q_pruned_top_k(spark, sf):
    ideas, catalog = _vectors(spark, sf)
    return pruned_top_k(ideas, catalog, k=K, exclude_self=True)


EDITED = "CASE WHEN funding > 0 THEN description || ' ' || coalesce(company, '') ELSE description END"


@register("stored_vectors", PREFIX + f""",
edited AS (SELECT id, {EDITED} AS description, funding > 0 AS fresh FROM clean),
""" + O.encoder_ctes("dv", "edited", "id", "description") + """
SELECT vid AS id, fresh, CAST(b AS INTEGER) AS bucket, round(v, 6) AS weight FROM dv JOIN edited ON edited.id = dv.vid""")
def q_stored_vectors(spark, sf):
    """The whole catalog stored, then refreshed after the funded companies' texts were edited: only those are fresh."""
    store = VectorStore(spark, scratch(spark, "vectors"))
    catalog = cleaned_catalog(spark, sf)
    store.refresh(catalog)
    store.refresh(catalog.withColumn("description", F.expr(EDITED)))
    return (store.rows().select("id", "fresh", F.posexplode_outer("embedding").alias("bucket", "w"))
            .select("id", "fresh", F.col("bucket").cast("int").alias("bucket"), F.round(F.col("w").cast("double"), 6).alias("weight")))


@register("evaluate_ideas_stored", Q1_SQL)
def q_evaluate_ideas_stored(spark, sf):
    store = VectorStore(spark, scratch(spark, "vectors"))
    catalog = cleaned_catalog(spark, sf)
    store.refresh(catalog)
    return evaluate_ideas(binding(spark, sf, "ideas"), catalog, k=K, cat_vectors=store.vectors())
