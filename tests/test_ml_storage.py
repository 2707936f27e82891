"""The model parts as stages that Spark ML stores, loads, copies and tunes."""
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from conftest import SMOKE
from venturelens import __version__
from venturelens.operators import model as M
from venturelens.plans.queries import training_catalog


@pytest.fixture(scope="module")
def rows(spark):
    return M.funded_only(training_catalog(spark, SMOKE)).withColumn("label", F.log1p("funding")).persist()


def predictions(model, rows):
    return sorted((r.id, r.mean_log, r.std_log) for r in model.transform(rows).select("id", "mean_log", "std_log").collect())


def test_fitted_pipeline_reloads_with_equal_predictions(spark, rows, tmp_path):
    fitted = Pipeline(stages=[M.FundingFeatures(dim=16), M.ForestEnsemble(3, 4, 4)]).fit(rows)
    fitted.write().overwrite().save(str(tmp_path / "model"))
    fitted.write().overwrite().save(str(tmp_path / "model"))          # again, over itself
    again = PipelineModel.load(str(tmp_path / "model"))
    assert [type(s).__name__ for s in again.stages] == ["FundingFeaturesModel", "ForestEnsembleModel"]
    assert [s.uid for s in again.stages] == [s.uid for s in fitted.stages]
    assert again.stages[0].getDim() == 16 and len(again.stages[1].members) == 3
    assert predictions(again, rows) == predictions(fitted, rows)


def test_unfitted_pipeline_keeps_params_and_base(spark, rows, tmp_path):
    plain = Pipeline(stages=[M.FundingFeatures(dim=8), M.ForestEnsemble(2, 3, 5, seed_base=7, features="features")])
    based = Pipeline(stages=[M.FundingFeatures(dim=8), M.ForestEnsemble(2, base=DecisionTreeRegressor(maxDepth=3))])
    for i, p in enumerate((plain, based)):
        p.write().save(str(tmp_path / f"p{i}"))
        again = Pipeline.load(str(tmp_path / f"p{i}")).getStages()[1]
        first = p.getStages()[1]
        assert {k.name: v for k, v in again.extractParamMap().items()} == {k.name: v for k, v in first.extractParamMap().items()}
        assert (again.base is None) == (first.base is None)
    assert Pipeline.load(str(tmp_path / "p1")).getStages()[1].base.getMaxDepth() == 3
    assert predictions(Pipeline.load(str(tmp_path / "p0")).fit(rows), rows) == predictions(plain.fit(rows), rows)


def test_cross_validation_varies_the_ensemble(rows):
    ens = M.ForestEnsemble(2, 2, 2)
    grid = ParamGridBuilder().addGrid(ens.maxDepth, [1, 4]).addGrid(ens.numMembers, [1]).build()
    cv = CrossValidator(estimator=Pipeline(stages=[M.FundingFeatures(dim=8), ens]), estimatorParamMaps=grid, numFolds=2, seed=1,
                        evaluator=RegressionEvaluator(predictionCol="mean_log", labelCol="label"))
    best = cv.fit(rows)
    assert len(set(best.avgMetrics)) == 2 and len(best.bestModel.stages[1].members) == 1


def test_a_stored_model_wants_its_own_encoder(spark, rows, tmp_path):
    def mine(texts):
        return [[float(len(t or "")), 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0] for t in texts]

    mine.name = "mine-1"
    feats = M.FundingFeatures(dim=8, encoder=mine).fit(rows)
    expected = feats.transform(rows).select("id", "features").collect()
    feats.write().save(str(tmp_path / "f"))
    again = M.FundingFeaturesModel.load(str(tmp_path / "f"))
    with pytest.raises(ValueError, match="mine-1"):
        again.transform(rows)
    with pytest.raises(ValueError, match="mine-1"):
        again.with_encoder(None)
    assert again.with_encoder(mine).transform(rows).select("id", "features").collect() == expected


def test_metadata_names_data_and_code(spark, rows, tmp_path):
    catalog = training_catalog(spark, SMOKE)

    def digest(c, name):
        M.train_funding_model(c, str(tmp_path / name), M.TrainParams(n_members=1, num_trees=1, max_depth=2))
        meta = M.load_model(spark, str(tmp_path / name)).meta
        assert meta["code_version"] == __version__
        return meta["data_digest"]

    same = digest(catalog.repartition(7), "a"), digest(catalog.orderBy("id"), "b")
    assert same[0] == same[1] != digest(catalog.where("id % 2 = 0 OR funding > 0 AND id % 3 > 0"), "c")
