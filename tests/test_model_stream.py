"""Model invariants (R keys) and batch = stream for T1."""
import os
import tempfile

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import functions as F

from conftest import SMOKE
from venturelens.operators import model as M
from venturelens.plans.evaluate import evaluate_ideas
from venturelens.plans.queries import cleaned_catalog, training_catalog
from venturelens.sources.bindings import binding
from venturelens.streaming.requests import evaluate_stream

QUICK = M.TrainParams(n_members=3, num_trees=5, max_depth=4)


@pytest.fixture(scope="module")
def trained(spark):
    d = tempfile.mkdtemp(prefix="vl-model-")
    metrics = M.train_funding_model(training_catalog(spark, SMOKE), d, QUICK).first()
    return d, metrics


def test_training_metrics(trained):
    _, m = trained
    assert m.n_train > 0 and m.n_validation > 0 and m.rmse_log >= 0


def test_interval_invariants_and_reload(spark, trained):
    d, _ = trained
    ideas = binding(spark, SMOKE, "ideas")
    p1 = {r.idea_id: r for r in M.predict_funding(ideas, d).collect()}
    assert len(p1) == ideas.count()
    for r in p1.values():
        if r.predicted_amount is None:
            continue
        assert r.lower <= r.predicted_amount <= r.upper
        assert r.confidence == 0.6 and r.error is None
    p2 = {r.idea_id: r.predicted_amount for r in M.predict_funding(ideas, d).collect()}
    assert {k: v.predicted_amount for k, v in p1.items()} == p2


def test_member_frame_equals_uncertainty(spark, trained):
    d, _ = trained
    loaded = M.load_model(spark, d)
    x = loaded.features.transform(training_catalog(spark, SMOKE).where("funding > 0"))
    wide = {r.id: (r.mean_log, r.std_log) for r in loaded.ensemble.predict_with_uncertainty(x).collect()}
    long = loaded.ensemble.member_predictions(x, "id").groupBy("id").agg(
        F.avg("pred").alias("m"), F.stddev_pop("pred").alias("s"))
    for r in long.collect():
        assert abs(wide[r.id][0] - r.m) < 1e-9 and abs(wide[r.id][1] - r.s) < 1e-9


def test_unseen_city_counts_zero(spark):
    train = spark.createDataFrame([("a",), ("a",), (None,)], "city string")
    t = M.frequency_table(train, "city")
    q = spark.createDataFrame([("a",), ("zzz",), (None,)], "city string")
    got = sorted((r.city or "", r.c) for r in M.frequency_encode(q, t, "city", "c").collect())
    assert got == [("", 1.0), ("a", 2.0), ("zzz", 0.0)]


def test_missing_model_gives_error_record(spark):
    ideas = binding(spark, SMOKE, "ideas")
    r = M.predict_funding(ideas, tempfile.mkdtemp(prefix="vl-empty-")).first()
    assert r.predicted_amount is None and r.confidence == 0.0 and "No funding model" in r.error


def test_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="vl-stream-")
    ideas = binding(spark, SMOKE, "ideas")
    ideas.where("idea_id % 2 = 0").write.json(os.path.join(base, "in", "a"))
    catalog = cleaned_catalog(spark, SMOKE)
    q = evaluate_stream(spark, os.path.join(base, "in", "*"), os.path.join(base, "out"),
                        os.path.join(base, "ckpt"), catalog)
    q.awaitTermination()
    ideas.where("idea_id % 2 = 1").write.json(os.path.join(base, "in", "b"))
    q = evaluate_stream(spark, os.path.join(base, "in", "*"), os.path.join(base, "out"),
                        os.path.join(base, "ckpt"), catalog)
    q.awaitTermination()
    streamed = spark.read.parquet(os.path.join(base, "out", "evaluated")).drop("epoch")
    batch = evaluate_ideas(ideas, catalog)
    assert sorted(map(tuple, streamed.select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def test_parallel_member_fits_equal_sequential(spark):
    c = M.funded_only(training_catalog(spark, SMOKE))
    x = VectorAssembler(inputCols=["starting_year", "employees_count"], outputCol="features", handleInvalid="keep").transform(
        c.select("id", "starting_year", "employees_count", F.log1p("funding").alias("label"))).persist()
    seq = M.ForestEnsemble(3, 4, 4, parallelism=1).fit(x).predict_with_uncertainty(x)
    par = M.ForestEnsemble(3, 4, 4, parallelism=3).fit(x).predict_with_uncertainty(x)
    a = sorted((r.id, round(r.mean_log, 9), round(r.std_log, 9)) for r in seq.collect())
    b = sorted((r.id, round(r.mean_log, 9), round(r.std_log, 9)) for r in par.collect())
    x.unpersist()
    assert a == b and len(a) > 0


def test_model_refuses_another_encoder(spark):
    from venturelens.operators.model import encoder_id

    def mine(texts):
        return texts

    mine.name = "my-encoder-2"
    assert encoder_id(None).startswith("hashed-words") and encoder_id(mine) == "my-encoder-2"


def _labelled(spark):
    return M.funded_only(training_catalog(spark, SMOKE)).withColumn("label", F.log1p("funding"))


def test_stages_fit_in_a_pipeline_with_a_base_estimator(spark):
    rows = _labelled(spark)
    base = DecisionTreeRegressor(maxDepth=3)
    fitted = Pipeline(stages=[M.FundingFeatures(), M.ForestEnsemble(n_members=2, base=base)]).fit(rows)
    got = fitted.transform(rows).select("mean_log", "std_log").collect()
    assert len(got) == rows.count() and all(r.std_log == 0 for r in got)      # a tree without sampling: equal members
    assert {type(m).__name__ for m in fitted.stages[1].members} == {"DecisionTreeRegressionModel"}


def test_pipeline_without_uncertainty_has_no_bounds(spark):
    rows, d = _labelled(spark), tempfile.mkdtemp(prefix="vl-plain-")
    feats = M.FundingFeatures().fit(rows)
    plain = LinearRegression(maxIter=5, regParam=0.1).fit(feats.transform(rows))
    M.save_model(d, feats, plain, M._meta_frame(spark, QUICK, rows.count()))
    ideas = binding(spark, SMOKE, "ideas")
    got = M.predict_funding(ideas, d).collect()
    assert len(got) == ideas.count()
    for r in got:
        assert r.predicted_amount is not None and r.lower is None and r.upper is None
        assert r.confidence == 0.6 and r.error is None


def test_broken_pipeline_falls_back_to_the_legacy_model_with_the_reason(spark):
    d = tempfile.mkdtemp(prefix="vl-broken-")
    M.train_legacy_model(training_catalog(spark, SMOKE), d, num_trees=3, max_depth=3)
    spark.createDataFrame([("log1p", 5)], "target_transform string, n_members int").write.json(os.path.join(d, "pipeline", "meta"))
    r = M.predict_funding(binding(spark, SMOKE, "ideas"), d).first()
    assert r.predicted_amount is not None and r.lower is None and "pipeline unusable" in r.error
