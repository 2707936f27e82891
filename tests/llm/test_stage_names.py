"""Stages and samples on tables with clashing column names, repeated rows and conflicting labels."""
from common import edge_docs
from pyspark.sql import functions as F
from venturelens.llm import mixing, parity_join, ppm, stream_dedup, toxicity
from venturelens.session import written


def test_stages_keep_clashing_columns(spark):
    clash = ["_metadata", "_dedup_file", "_dedup_row", "_mix_plan", "_mix_copy", "component_id", "digest"]
    docs = edge_docs(spark).drop("ids", "score", "label", "file").select("*", *(F.lit(f"own {c}").alias(c) for c in clash))
    for frame in (docs, written(docs, "clash")):
        plain = sorted(str(r.doc_id) for r in stream_dedup.keep_one(frame.drop(*clash)).collect())
        for stage in (stream_dedup.keep_one, mixing.mixed, parity_join.keep_one):
            got = stage(frame)
            rows = got.collect()
            assert got.columns == docs.columns and rows
            assert all(r[c] == f"own {c}" for r in rows for c in clash)
            if stage is stream_dedup.keep_one:
                assert sorted(str(r.doc_id) for r in rows) == plain


def test_conflicting_labels_and_repeated_rows_are_learned_from_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y, counts: seen.append((texts.to_pylist(), y.tolist())))
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "c"), (3, "d"), (None, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0), (3, None), (None, 1)], "doc_id long, label int")
    for n in (1, 7):
        toxicity.fit(docs.repartition(n), labels.repartition(n))
    assert seen == [(["a", "c"], [1.0, 0.0])] * 2


def test_language_sample_is_joined_without_a_shuffle_of_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ppm, "fit_trees", lambda texts: seen.append(texts))
    rows = [(i % 7, f"text {i % 7}", "ab"[i % 2]) for i in range(40)] + [(None, "x", "a"), (50, None, "b"), (51, "y", None)]
    for n in (1, 5):
        ppm.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(n))
    assert seen[0] == seen[1] and sorted(seen[0]["b"]) == sorted(["", *(f"text {i}" for i in range(7))])
