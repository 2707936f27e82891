"""Funding model: J2, M1-M10, A7-A10, S6, S7.

* Features (M1/M2): text embedding + year, founders, employees and the training
  frequency of city and industry (J2, a left join on a small count table).
* Ensemble (M4-M6): ``n_members`` MLlib random forests that differ only by
  seed; the spread of their predictions gives the interval (C11).
* Members are applied one after the other in a single projection, so scoring
  is one pass over the rows with no shuffle; mean and population std are
  array expressions over the member columns.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasOutputCol, HasParallelism
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from venturelens import __version__
from venturelens.functions.cleaning import inverse_target
from venturelens.operators.guards import funded_only, min_rows_guard
from venturelens.operators.joins import computed_once
from venturelens.operators.ml_io import StoredStage
from venturelens.operators.quantiles import exact_quantiles
from venturelens.operators.vectors import with_embedding
from venturelens.session import discard, written
from venturelens.schema import (
    BASELINE_CONFIDENCE, ENCODER_DIM, ENSEMBLE_MEMBERS, ERROR_CONFIDENCE, FEATURE_MISSING_TOKEN,
    FEATURE_ORDER, INTERVAL_LEVEL, MEMBER_SEED_BASE, MIN_FUNDED_ROWS, NO_MODEL_ERROR, SPLIT_SEED,
    TARGET_TRANSFORM, TREES_PER_MEMBER, VALIDATION_PERCENT, Z_95,
)

ENCODER_NAME = f"hashed-words-md5-{ENCODER_DIM}"

# ---------------------------------------------------------------------------
# J2 frequency encoding, M3 split
# ---------------------------------------------------------------------------


def frequency_table(df: DataFrame, col: str, missing: str = FEATURE_MISSING_TOKEN) -> DataFrame:
    """Count per value, missing values under one token (training split only)."""
    return (df.groupBy(F.coalesce(F.col(col), F.lit(missing)).alias("value"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


def frequency_encode(df: DataFrame, table: DataFrame, col: str, out_col: str,
                     missing: str = FEATURE_MISSING_TOKEN) -> DataFrame:
    """Map a category to its training count; unseen -> 0.

    A left join; the count table is broadcast when its row count is within a
    checked bound (so a hot category is not sent to one task), else a
    shuffle join with AQE skew handling.
    """
    key = F.coalesce(F.col(col), F.lit(missing))
    t = computed_once(table.select(F.col("value").alias(f"_{out_col}_v"),
                                        F.col("n").alias(f"_{out_col}_n")))
    j = df.join(t, key == F.col(f"_{out_col}_v"), "left")
    return j.withColumn(out_col, F.coalesce(F.col(f"_{out_col}_n"), F.lit(0)).cast("double")) \
        .drop(f"_{out_col}_v", f"_{out_col}_n")


def validation_flag(id_col: Column | str, percent: int = VALIDATION_PERCENT,
                    seed: int = SPLIT_SEED) -> Column:
    """M3: stable bucket of md5(seed:id) in 0..99; below ``percent`` is validation.

    Independent of partitioning and row order, unlike ``randomSplit``.
    """
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    h = F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))
    bucket = F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.lit(100))
    return bucket < percent


def split_train_validation(df: DataFrame, id_col: str = "id", percent: int = VALIDATION_PERCENT,
                           seed: int = SPLIT_SEED) -> tuple[DataFrame, DataFrame]:
    flag = validation_flag(id_col, percent, seed)
    return df.where(~flag), df.where(flag)


# ---------------------------------------------------------------------------
# M1/M2 features, M10 model inputs
# ---------------------------------------------------------------------------


def encoder_id(encoder) -> str:
    """Identity of a text encoder: its ``name``, else its place in the code; the built-in one by default."""
    if encoder is None:
        return ENCODER_NAME
    return getattr(encoder, "name", None) or f"{encoder.__module__}.{encoder.__qualname__}"


class _EncoderParams(HasOutputCol):
    """Params of both feature stages.  The encoder itself is code: its name is stored, and it is handed over again."""

    dim = Param(Params._dummy(), "dim", "length of the text vector", TypeConverters.toInt)
    encoderName = Param(Params._dummy(), "encoderName", "identity of the text encoder", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self.encoder = None
        self._setDefault(dim=ENCODER_DIM, encoderName=ENCODER_NAME, outputCol="features")

    def getDim(self) -> int:
        return self.getOrDefault(self.dim)

    def getEncoderName(self) -> str:
        return self.getOrDefault(self.encoderName)


class FundingFeaturesModel(_EncoderParams, Model, StoredStage):
    """M2: fitted feature builder (two count tables), a ``pyspark.ml`` model."""

    def __init__(self, city_counts: DataFrame | None = None, industry_counts: DataFrame | None = None):
        super().__init__()
        self.city_counts, self.industry_counts = city_counts, industry_counts

    def with_encoder(self, encoder) -> FundingFeaturesModel:
        """This model with the encoder it was fitted with, which a stored one lacks; refuses another."""
        if encoder_id(encoder) != self.getEncoderName():
            raise ValueError(f"model was trained with encoder {self.getEncoderName()}, not {encoder_id(encoder)}")
        out = self.copy()
        out.encoder = encoder
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        if encoder_id(self.encoder) != self.getEncoderName():
            raise ValueError(f"hand over the encoder {self.getEncoderName()} by with_encoder()")
        dim = self.getDim()
        x = with_embedding(df, "description", "embedding", dim, self.encoder)
        x = frequency_encode(x, self.city_counts, "city", "city_count")
        x = frequency_encode(x, self.industry_counts, "industries", "industry_count")
        zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
        nums = [F.coalesce(F.col(c).cast("double"), F.lit(0.0))
                for c in ("starting_year", "founders_count", "employees_count",
                          "city_count", "industry_count")]
        arr = F.concat(F.coalesce(F.col("embedding"), zeros).cast("array<double>"), F.array(*nums))
        return x.withColumn(self.getOutputCol(), array_to_vector(arr))

    def _write_data(self, path: str) -> None:
        self.city_counts.write.parquet(os.path.join(path, "city_counts"))
        self.industry_counts.write.parquet(os.path.join(path, "industry_counts"))

    @classmethod
    def _read_data(cls, spark: SparkSession, path: str, extra: dict) -> FundingFeaturesModel:
        return cls(spark.read.parquet(os.path.join(path, "city_counts")),
                   spark.read.parquet(os.path.join(path, "industry_counts")))


class FundingFeatures(_EncoderParams, Estimator, StoredStage):
    """M1: learn city and industry counts on the training rows, a ``pyspark.ml`` estimator."""

    def __init__(self, dim: int = ENCODER_DIM, encoder=None):
        super().__init__()
        self.encoder = encoder
        self._set(dim=dim, encoderName=encoder_id(encoder))

    def _fit(self, train: DataFrame) -> FundingFeaturesModel:
        model = FundingFeaturesModel(frequency_table(train, "city"), frequency_table(train, "industries"))
        model.encoder = self.encoder
        return self._copyValues(model)


def build_model_inputs(ideas: DataFrame, industry_col: str | None = None) -> DataFrame:
    """Model input rows from requests; founders and employees are 0."""
    industry = F.coalesce(F.col(industry_col), F.lit("")) if industry_col else F.lit("")
    return ideas.select(
        F.col("idea_id"),
        F.col("user_idea").alias("description"),
        F.coalesce(F.col("founding_year").cast("double"), F.lit(0.0)).alias("starting_year"),
        F.lit(0.0).alias("founders_count"),
        F.lit(0.0).alias("employees_count"),
        F.coalesce(F.col("user_city"), F.lit("")).alias("city"),
        industry.alias("industries"),
    )


# ---------------------------------------------------------------------------
# M4-M6 ensemble, A7
# ---------------------------------------------------------------------------


def member_stats(cols: list[str]) -> tuple[Column, Column]:
    """A7 over member columns: mean and population std (divides by n)."""
    arr = F.array(*[F.col(c) for c in cols])
    n = float(len(cols))
    mean = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(arr, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    return mean, F.sqrt(var)


class ForestEnsembleModel(HasFeaturesCol, Model, StoredStage):
    """M5, M6: the fitted members; ``transform`` adds ``mean_log`` and ``std_log``."""

    def __init__(self, members: list | None = None):
        super().__init__()
        self.members = members or []

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.predict_with_uncertainty(df, self.getFeaturesCol())

    def _member_columns(self, df: DataFrame, features: str) -> tuple[DataFrame, list[str]]:
        out, cols = df, []
        for i, m in enumerate(self.members):
            col = f"_member_{i}"
            out = m.transform(out, {m.featuresCol: features, m.predictionCol: col})
            cols.append(col)
        return out, cols

    def predict_with_uncertainty(self, df: DataFrame, features: str = "features") -> DataFrame:
        """M6: mean and std of the member predictions (log scale)."""
        out, cols = self._member_columns(df, features)
        mean, std = member_stats(cols)
        return out.withColumn("mean_log", mean).withColumn("std_log", std).drop(*cols)

    def predict(self, df: DataFrame, features: str = "features") -> DataFrame:
        """M5: mean of the members."""
        return self.predict_with_uncertainty(df, features).drop("std_log")

    def member_predictions(self, df: DataFrame, id_col: str, features: str = "features") -> DataFrame:
        """Long (id, member, pred) frame; A7 over it equals M6."""
        out, cols = self._member_columns(df, features)
        entries = F.array(*[F.struct(F.lit(i).alias("member"), F.col(c).alias("pred"))
                            for i, c in enumerate(cols)])
        return out.select(F.col(id_col).alias("id"), F.explode(entries).alias("e")) \
            .select("id", "e.member", "e.pred")

    def _extra(self) -> dict:
        return {"members": len(self.members)}

    def _write_data(self, path: str) -> None:
        for i, m in enumerate(self.members):
            m.write().save(os.path.join(path, f"member_{i}"))

    @classmethod
    def _read_data(cls, spark: SparkSession, path: str, extra: dict) -> ForestEnsembleModel:
        return cls([load_fitted(os.path.join(path, f"member_{i}")) for i in range(extra["members"])])


def load_fitted(path: str) -> Params:
    """A stored ``pyspark.ml`` stage of whatever class its metadata names."""
    return DefaultParamsReader.loadParamsInstance(path, SparkSession.active())


class ForestEnsemble(HasFeaturesCol, HasLabelCol, HasParallelism, Estimator, StoredStage):
    """M4: ``numMembers`` copies of ``base`` with seeds ``seedBase + i``.

    ``base`` is any ``pyspark.ml`` regressor; by default a random forest with
    all features per split, made from the params when it is fitted.
    """

    numMembers = Param(Params._dummy(), "numMembers", "members of the ensemble", TypeConverters.toInt)
    numTrees = Param(Params._dummy(), "numTrees", "trees of the default base", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of the default base's trees", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of the default base", TypeConverters.toInt)
    seedBase = Param(Params._dummy(), "seedBase", "seed of the first member", TypeConverters.toInt)

    def __init__(self, n_members: int = ENSEMBLE_MEMBERS, num_trees: int = TREES_PER_MEMBER, max_depth: int = 30,
                 max_bins: int = 32, seed_base: int = MEMBER_SEED_BASE, parallelism: int = ENSEMBLE_MEMBERS,
                 base: Estimator | None = None, features: str = "features", label: str = "label"):
        super().__init__()
        self.base = base
        self._set(numMembers=n_members, numTrees=num_trees, maxDepth=max_depth, maxBins=max_bins, seedBase=seed_base,
                  parallelism=parallelism, featuresCol=features, labelCol=label)

    def _member_estimator(self) -> Estimator:
        if self.base is not None:
            return self.base
        return RandomForestRegressor(
            numTrees=self.getOrDefault(self.numTrees), maxDepth=self.getOrDefault(self.maxDepth),
            maxBins=self.getOrDefault(self.maxBins), featureSubsetStrategy="all", subsamplingRate=1.0, bootstrap=True)

    def _fit(self, df: DataFrame) -> ForestEnsembleModel:
        """Fit the members, up to ``parallelism`` at a time.

        Each member is its own distributed job with its own seed, so fitting
        them from a thread pool (as ``CrossValidator(parallelism=)`` does)
        changes no result; it keeps the cluster busy between the small jobs of
        one forest.  ``df`` should be persisted by the caller.
        """
        from concurrent.futures import ThreadPoolExecutor

        from pyspark.util import inheritable_thread_target

        base, n = self._member_estimator(), self.getOrDefault(self.numMembers)

        def member(i: int) -> Model:
            over = {base.featuresCol: self.getFeaturesCol(), base.labelCol: self.getLabelCol()}
            if base.hasParam("seed"):
                over[base.seed] = self.getOrDefault(self.seedBase) + i
            return base.fit(df, over)

        workers = max(1, min(self.getParallelism(), n))
        if workers == 1:
            members = [member(i) for i in range(n)]
        else:
            with ThreadPoolExecutor(max_workers=workers) as pool:
                members = list(pool.map(inheritable_thread_target(df.sparkSession)(member), range(n)))
        return self._copyValues(ForestEnsembleModel(members))

    def _extra(self) -> dict:
        return {"base": self.base is not None}

    def _write_data(self, path: str) -> None:
        if self.base is not None:
            self.base.write().save(os.path.join(path, "base"))

    @classmethod
    def _read_data(cls, spark: SparkSession, path: str, extra: dict) -> ForestEnsemble:
        return cls(base=load_fitted(os.path.join(path, "base")) if extra["base"] else None)


# ---------------------------------------------------------------------------
# A8-A10 evaluation over a (y, mean, std) frame
# ---------------------------------------------------------------------------


def rmse(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Root mean squared error."""
    return df.agg(F.sqrt(F.avg(F.pow(F.col(y) - F.col(pred), 2))).alias("rmse"))


def median_abs_error(df: DataFrame, y: str = "y", pred: str = "pred", log_scale: bool = True) -> DataFrame:
    """Median absolute error in dollars (exact median)."""
    back = (lambda c: F.expm1(F.col(c))) if log_scale else (lambda c: F.col(c))
    err = df.select(F.abs(back(y) - back(pred)).alias("_e"))
    return exact_quantiles(err, "_e", [0.5]).select(F.col("q_0").alias("median_abs_error"))


def interval_coverage(df: DataFrame, y: str, lower: str, upper: str, log_scale: bool = True) -> DataFrame:
    """A10: share of truths inside [lower, upper]."""
    truth = F.expm1(F.col(y)) if log_scale else F.col(y)
    inside = truth.between(F.col(lower), F.col(upper)).cast("double")
    return df.agg(F.avg(inside).alias("coverage"))


def prediction_interval(mean: Column | str, std: Column | str, transform: str | None = TARGET_TRANSFORM,
                        z: float = Z_95) -> tuple[Column, Column, Column]:
    """C11: (amount, lower, upper), back-transformed per the metadata."""
    m = F.col(mean) if isinstance(mean, str) else mean
    s = F.col(std) if isinstance(std, str) else std
    return (inverse_target(m, transform), inverse_target(m - z * s, transform),
            inverse_target(m + z * s, transform))


def interval_scores(df: DataFrame, y: str, mean: str, std: str) -> DataFrame:
    """``df`` with ``_score``: how many standard deviations the truth lies from the mean (a zero one counts as 1e-9)."""
    return df.withColumn("_score", F.abs(F.col(y) - F.col(mean)) / F.greatest(F.col(std), F.lit(1e-9)))


def conformal_share(n: int, level: float) -> float:
    """Share of the sorted scores of n calibration rows below the conformal bound: ceil((n + 1) level) / n, at most 1."""
    return min(1.0, math.ceil((n + 1) * level) / n)


def calibration_table(df: DataFrame, y: str = "y", mean: str = "mean_pred", std: str = "std_pred",
                      levels: tuple[float, ...] = (0.5, 0.8, 0.9, 0.95, 0.99)) -> DataFrame:
    """A10 by nominal level: coverage of mean +/- z std, and the z that covers the level on exchangeable rows.

    level, z (normal), n, coverage, z_calibrated (conformal: an exact quantile of the scores).  No rows: an empty table.
    """
    scored = interval_scores(df.where(F.col(y).isNotNull() & F.col(mean).isNotNull() & F.col(std).isNotNull()), y, mean, std)
    z = [NormalDist().inv_cdf((1 + level) / 2) for level in levels]
    r = scored.agg(F.count(F.lit(1)).alias("n"), *(F.avg((F.col("_score") <= F.lit(b)).cast("double")).alias(f"c{i}")
                                                   for i, b in enumerate(z))).first()
    fields = "level double, z double, n bigint, coverage double, z_calibrated double"
    if not r["n"]:
        return df.sparkSession.createDataFrame([], fields)
    q = exact_quantiles(scored.select("_score"), "_score", [conformal_share(r["n"], level) for level in levels]).first()
    return df.sparkSession.createDataFrame(
        [(level, z[i], r["n"], r[f"c{i}"], q[f"q_{i}"]) for i, level in enumerate(levels)], fields)


# ---------------------------------------------------------------------------
# M7 training, S6/S7 persistence, M8/M9 prediction
# ---------------------------------------------------------------------------


@dataclass
class TrainParams:
    n_members: int = ENSEMBLE_MEMBERS
    num_trees: int = TREES_PER_MEMBER
    max_depth: int = 30
    min_rows: int = MIN_FUNDED_ROWS
    validation_percent: int = VALIDATION_PERCENT
    seed: int = SPLIT_SEED


#: Training rows of one task beyond which there are more tasks than cores.
TRAIN_TASK_ROWS = 1_000_000


def training_tasks(rows: int, cores: int) -> int:
    """Most tasks of the training rows.

    At each level of its trees a forest shuffles, from every task, the statistics of every open node (features x
    bins), whatever the task's rows.  So the bytes follow the number of tasks, not that of rows.
    """
    return max(1, cores, math.ceil(rows / TRAIN_TASK_ROWS))


def data_digest(df: DataFrame) -> Column:
    """Aggregate that names the rows of ``df`` whatever their order: the sum of their 64-bit hashes, as text."""
    return F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string")


def _meta_frame(spark: SparkSession, params: TrainParams, n_train: int, encoder=None,
                dim: int = ENCODER_DIM, digest: str | None = None) -> DataFrame:
    return spark.createDataFrame(
        [(TARGET_TRANSFORM, encoder_id(encoder), dim, list(FEATURE_ORDER), params.n_members, params.num_trees,
          params.max_depth, n_train, digest, __version__)],
        "target_transform string, embed_model string, dim int, feature_order array<string>, "
        "n_members int, num_trees int, max_depth int, n_train bigint, data_digest string, code_version string",
    ).withColumn("trained_at", F.current_timestamp())


def save_model(model_dir: str, features: FundingFeaturesModel, model: Model, meta: DataFrame) -> None:
    """A ``PipelineModel`` under ``model_dir/pipeline/model`` and one-row metadata (JSON) beside it.

    ``model`` is an ensemble or any fitted ``pyspark.ml`` regressor, which has no uncertainty.
    """
    base = os.path.join(model_dir, "pipeline")
    PipelineModel([features, model]).write().overwrite().save(os.path.join(base, "model"))
    meta.withColumn("uncertainty", F.lit(isinstance(model, ForestEnsembleModel))) \
        .coalesce(1).write.mode("overwrite").json(os.path.join(base, "meta"))


@dataclass
class LoadedModel:
    kind: str                      # "pipeline", "legacy" or "none"
    meta: dict
    features: FundingFeaturesModel | None = None
    ensemble: ForestEnsembleModel | None = None
    plain: Model | None = None     # a pipeline whose model has no uncertainty
    legacy: Model | None = None
    error: str | None = None


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def load_model(spark: SparkSession, model_dir: str) -> LoadedModel:
    """Pipeline + metadata, else the legacy model, else an error record."""
    base = os.path.join(model_dir, "pipeline")
    if not _exists(spark, os.path.join(base, "meta")):
        return _load_legacy(spark, model_dir, None)
    try:
        meta = spark.read.json(os.path.join(base, "meta")).first().asDict()
        features, model = PipelineModel.load(os.path.join(base, "model")).stages
        if isinstance(model, ForestEnsembleModel):
            return LoadedModel("pipeline", meta, features, ensemble=model)
        return LoadedModel("pipeline", meta, features, plain=model)
    except Exception as exc:  # noqa: BLE001 - the reason is kept, not swallowed
        return _load_legacy(spark, model_dir, f"pipeline unusable: {exc}")


def _load_legacy(spark: SparkSession, model_dir: str, reason: str | None) -> LoadedModel:
    """The older model with the reason why the pipeline is not used, else an error record."""
    legacy = os.path.join(model_dir, "legacy")
    if not _exists(spark, os.path.join(legacy, "model")):
        return LoadedModel("none", {}, error=reason or f"{NO_MODEL_ERROR} in {model_dir}")
    meta = {}
    if _exists(spark, os.path.join(legacy, "meta")):
        meta = spark.read.json(os.path.join(legacy, "meta")).first().asDict()
    return LoadedModel("legacy", meta, legacy=load_fitted(os.path.join(legacy, "model")), error=reason)


def train_funding_model(catalog: DataFrame, model_dir: str, params: TrainParams = TrainParams(),
                        encoder=None) -> DataFrame:
    """M7: F1 -> F3 -> C10 -> M3 -> M1/M2 -> M4 -> A8 -> S6; returns a metrics row.

    ``catalog`` is cleaned with the training defaults (empty description).
    """
    spark = catalog.sparkSession
    funded = min_rows_guard(funded_only(catalog), params.min_rows)
    # stored: the training reads it six times
    data = written(funded.select("id", "description", "starting_year", "founders_count", "employees_count",
                                 "city", "industries", F.log1p("funding").alias("label")), "training")
    train, valid = split_train_validation(data, "id", params.validation_percent, params.seed)
    feats = FundingFeatures(encoder=encoder).fit(train)
    named = train.agg(F.count(F.lit(1)).alias("n"), data_digest(train).alias("digest")).first()
    n_train = named["n"]
    train_x = feats.transform(train).select("id", "features", "label").coalesce(
        training_tasks(n_train, spark.sparkContext.defaultParallelism)).persist()
    ens = ForestEnsemble(params.n_members, params.num_trees, params.max_depth).fit(train_x)
    valid_p = ens.predict_with_uncertainty(feats.transform(valid).select("id", "features", "label")).select(
        "label", "mean_log", "std_log").persist()
    metrics = valid_p.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_validation"),
        F.sqrt(F.avg(F.pow(F.col("label") - F.col("mean_log"), 2))).alias("rmse_log"))
    level = calibration_table(valid_p, "label", "mean_log", "std_log", (INTERVAL_LEVEL,)).first()
    meta = _meta_frame(spark, params, n_train, encoder, feats.getDim(), named["digest"]).withColumn(
        "z_calibrated", F.lit(level["z_calibrated"] if level else None).cast("double"))
    save_model(model_dir, feats, ens, meta)
    result = metrics.select(F.lit(n_train).cast("bigint").alias("n_train"), "n_validation",
                            F.round("rmse_log", 6).alias("rmse_log")).first()
    train_x.unpersist()
    valid_p.unpersist()
    discard(data)
    return spark.createDataFrame([tuple(result)], "n_train bigint, n_validation bigint, rmse_log double")


def train_legacy_model(catalog: DataFrame, model_dir: str, num_trees: int = 20, max_depth: int = 8,
                       seed: int = MEMBER_SEED_BASE) -> None:
    """Fallback model on embedding + year only (the older two-part feature vector)."""
    x = with_embedding(funded_only(catalog), "description").select(
        F.log1p("funding").alias("label"),
        array_to_vector(F.concat(F.col("embedding").cast("array<double>"),
                                 F.array(F.col("starting_year").cast("double")))).alias("features"))
    # stored: the rows are encoded once, and the forest's tasks are as many as the session's cores need
    x = written(x, "legacy-training")
    x = x.coalesce(training_tasks(x.count(), x.sparkSession.sparkContext.defaultParallelism))
    rf = RandomForestRegressor(numTrees=num_trees, maxDepth=max_depth, seed=seed,
                               featureSubsetStrategy="all")
    rf.fit(x).write().overwrite().save(os.path.join(model_dir, "legacy", "model"))
    catalog.sparkSession.createDataFrame([(TARGET_TRANSFORM,)], "target_transform string") \
        .coalesce(1).write.mode("overwrite").json(os.path.join(model_dir, "legacy", "meta"))


PREDICTION_COLUMNS = ("predicted_amount", "confidence", "error", "lower", "upper")


def _pipeline_predictions(inputs: DataFrame, loaded: LoadedModel, encoder, calibrated: bool = False) -> DataFrame:
    transform = loaded.meta.get("target_transform")
    feats = loaded.features.with_encoder(encoder)
    x = feats.transform(inputs)
    if loaded.plain is not None:                       # no spread, hence no bounds
        m = loaded.plain
        scored = m.transform(x, {m.featuresCol: feats.getOutputCol(), m.predictionCol: "_pred"})
        amount, lower, upper = inverse_target("_pred", transform), F.lit(None).cast("double"), F.lit(None).cast("double")
    else:
        scored = loaded.ensemble.predict_with_uncertainty(x)
        z = loaded.meta.get("z_calibrated") if calibrated else None
        amount, lower, upper = prediction_interval("mean_log", "std_log", transform, Z_95 if z is None else float(z))
    return scored.select("idea_id", amount.alias("predicted_amount"), F.lit(BASELINE_CONFIDENCE).alias("confidence"),
                         F.lit(None).cast("string").alias("error"), lower.alias("lower"), upper.alias("upper"))


def predict_funding(ideas: DataFrame, model_dir: str, industry_col: str | None = None,
                    encoder=None, calibrated: bool = False) -> DataFrame:
    """M8 (with the M9 fallback): amount, confidence, error, lower, upper per idea.

    ``ideas``: (idea_id, user_idea, user_city, founding_year[, industry]).
    The model is loaded once per job; a failure reason is kept in ``error``.  With ``calibrated`` the interval
    is the one that covered 95 % of the validation rows (conformal, kept in the metadata).
    """
    spark = ideas.sparkSession
    loaded = load_model(spark, model_dir)
    inputs = build_model_inputs(ideas, industry_col)
    if loaded.kind == "pipeline" and loaded.meta.get("embed_model") != encoder_id(encoder):
        loaded = LoadedModel("none", {}, error=f"model was trained with encoder {loaded.meta.get('embed_model')}, "
                                               f"not {encoder_id(encoder)}")
    if loaded.kind == "pipeline":
        try:
            return _pipeline_predictions(inputs, loaded, encoder, calibrated)
        except Exception as exc:  # noqa: BLE001 - the reason is kept, not swallowed
            loaded = _load_legacy(spark, model_dir, f"pipeline unusable: {exc}")
    if loaded.kind == "legacy":
        transform = loaded.meta.get("target_transform")
        x = with_embedding(inputs, "description", "embedding", encoder=encoder).withColumn(
            "features", array_to_vector(F.concat(
                F.coalesce(F.col("embedding"), F.array_repeat(F.lit(0.0).cast("float"), ENCODER_DIM))
                .cast("array<double>"), F.array(F.col("starting_year")))))
        m = loaded.legacy
        scored = m.transform(x, {m.predictionCol: "_pred"})
        return scored.select("idea_id", inverse_target("_pred", transform).alias("predicted_amount"),
                             F.lit(BASELINE_CONFIDENCE).alias("confidence"),
                             F.lit(loaded.error).cast("string").alias("error"),   # why the pipeline was not used
                             F.lit(None).cast("double").alias("lower"),
                             F.lit(None).cast("double").alias("upper"))
    return inputs.select("idea_id", F.lit(None).cast("double").alias("predicted_amount"),
                         F.lit(ERROR_CONFIDENCE).alias("confidence"),
                         F.lit(loaded.error).cast("string").alias("error"),
                         F.lit(None).cast("double").alias("lower"),
                         F.lit(None).cast("double").alias("upper"))
