"""One gradient-boosted regression over all series, with its preprocessing and importance."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, functions as F

from panelry.operators.tree_growing import Settings, grow_trees
from panelry.sources.contracts import present
from panelry.sources.io import read_table, shared_path, write_table

# Predictors that do not use holdout sales, and the model settings.
PREDICTORS = [
    "cat_id", "lag_28", "calendar_month", "calendar_week", "calendar_quarter", "day_of_month",
    "day_of_year", "weekday_number", "month_sin", "month_cos", "weekday_sin", "weekday_cos",
    "is_month_start", "is_month_end", "is_quarter_start", "is_quarter_end", "is_weekend", "is_event",
    "within_3_days_of_event", "within_7_days_of_event", "snap_ca", "average_price", "price_missing",
    "price_relative_to_28_day_mean",
]
SETTINGS = {
    "maxIter": 800, "maxDepth": 6, "minInstancesPerNode": 10, "stepSize": 0.03, "minInfoGain": 0.0,
    "subsamplingRate": 0.8, "seed": 2026,
}
UNKNOWN = "unknown"
FILLED = "_filled"
#: Training rows of one task, as long as that needs no more tasks than can run at once.
TASK_ROWS = 100_000


def gbt_predictors(features: DataFrame, candidates: Sequence[str] = tuple(PREDICTORS)) -> list[str]:
    """The candidate predictors the feature table has."""
    return present(features, candidates)


def _split_types(df: DataFrame, predictors: Sequence[str]) -> tuple[list[str], list[str]]:
    types = dict(df.dtypes)
    nominal = [name for name in predictors if types[name] == "string"]
    return nominal, [name for name in predictors if name not in nominal]


def _model_frame(df: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """Null categories as their own level, and numbers as doubles."""
    nominal, numeric = _split_types(df, predictors)
    columns = {name: F.coalesce(F.col(name), F.lit(UNKNOWN)) for name in nominal}
    columns |= {name: F.col(name).cast("double") for name in numeric}
    return df.withColumns(columns)


def training_medians(train: DataFrame, predictors: Sequence[str]) -> dict[str, float]:
    """The exact median of each numeric predictor, from one aggregate; a predictor that is always null has none."""
    _, numeric = _split_types(train, predictors)
    row = train.agg(*[F.median(F.col(name).cast("double")).alias(name) for name in numeric]).first()
    return {name: row[name] for name in numeric if row[name] is not None}


def median_imputed_features(train: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """Numeric predictors with nulls replaced by the training median, as the model sees them; always-null ones are gone."""
    medians, (_, numeric) = training_medians(train, predictors), _split_types(train, predictors)
    frame = _model_frame(train, predictors).drop(*[name for name in numeric if name not in medians])
    return frame.withColumns({name: F.coalesce(F.col(name), F.lit(value)) for name, value in medians.items()})


def zero_variance_columns(train: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """Whether each numeric predictor never changes in training once imputed, from one aggregate over the table."""
    medians = training_medians(train, predictors)
    imputed = median_imputed_features(train, predictors)
    fixed = imputed.agg(*[(F.min(name) == F.max(name)).alias(name) for name in medians])
    return fixed.unpivot([], list(medians), "feature", "is_constant")


def _preparation(train: DataFrame, predictors: Sequence[str]) -> list:
    """Stages before the trees: index, one-hot with all levels, impute, assemble, drop constants."""
    nominal, _ = _split_types(train, predictors)
    medians = training_medians(train, predictors)
    filled = {name: f"{name}{FILLED}" for name in medians}
    indexed = [f"{name}_index" for name in nominal]
    encoded = [f"{name}_level" for name in nominal]
    stages = []
    if nominal:
        stages.append(StringIndexer(inputCols=nominal, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=False, handleInvalid="keep"))
    imputed = ", ".join(f"coalesce(`{name}`, cast('{value!r}' as double)) as `{filled[name]}`" for name, value in medians.items())
    stages += [
        SQLTransformer(statement=f"select *{', ' if imputed else ''}{imputed} from __THIS__"),
        VectorAssembler(inputCols=encoded + list(filled.values()), outputCol="all_features"),
        VarianceThresholdSelector(varianceThreshold=0.0, featuresCol="all_features", outputCol="features"),
    ]
    return stages


def encoded_features(train: DataFrame, predictors: Sequence[str], keys: Sequence[str] = ("date", "cat_id")) -> DataFrame:
    """What the trees see, as one row per training row and input: the keys, feature and value.

    Inputs are category levels as 0 and 1 and imputed numbers, without those that never change in training.
    """
    frame = _model_frame(train, predictors)
    model = Pipeline(stages=_preparation(train, predictors)).fit(frame)
    names = F.array(*[F.lit(name) for name in _feature_names(model, frame)])
    inputs = model.transform(frame).select(*keys, F.posexplode(vector_to_array("features")).alias("_at", "value"))
    return inputs.select(*keys, F.element_at(names, F.col("_at") + 1).alias("feature"), "value")


def fit_gbt(
    train: DataFrame,
    predictors: Sequence[str],
    target: str = "units_sold",
    trees: int | None = None,
) -> PipelineModel:
    """Fit the whole pipeline: index, one-hot with all levels, impute, assemble, drop constants, boost.

    Numeric predictors that are always null are left out, and so are rows without a target.

    An unseen category at prediction time gets the extra index the indexer keeps for it. All trees grow in one
    Spark job, by tasks that run at the same time (``tree_growing``), so the cluster must not allocate executors
    dynamically when there is more than one task. The result is an ordinary Spark ML model, whose first
    tree counts whole and every later one by the step.
    """
    settings = {**SETTINGS, **({"maxIter": trees} if trees else {})}
    frame = _model_frame(train, predictors).select(*predictors, F.col(target).cast("double").alias(target))
    frame = frame.where(F.col(target).isNotNull()).cache()
    try:
        tasks = min(frame.count() // TASK_ROWS + 1, train.sparkSession.sparkContext.defaultParallelism)
        prepared = Pipeline(stages=_preparation(train, predictors)).fit(frame)
        inputs = prepared.transform(frame)
        rows = inputs.select(
            F.col(target).alias("y"), F.xxhash64(*predictors, target).alias("key"), vector_to_array("features").alias("x")
        )
        kinds = _inputs(prepared, frame)
        binary = [i for i, (_, levels) in enumerate(kinds) if levels]
        nodes = grow_trees(rows, len(kinds), binary, Settings(
            settings["maxIter"], settings["maxDepth"], settings["minInstancesPerNode"], settings["stepSize"],
            settings["minInfoGain"], settings["subsamplingRate"], settings["seed"],
        ), tasks)
        return PipelineModel(stages=[*prepared.stages, _spark_model(nodes, len(kinds), target, settings)])
    finally:
        frame.unpersist()


def _spark_model(nodes: DataFrame, features: int, target: str, settings: dict) -> GBTRegressionModel:
    """A Spark ML model of the grown nodes: a model of one leaf is saved, gets the nodes, and is loaded again."""
    spark = nodes.sparkSession
    seed, grown = shared_path(spark, "leaf"), shared_path(spark, "trees")
    leaf = GBTRegressor(featuresCol="features", labelCol=target, predictionCol="_prediction", maxIter=1, maxDepth=0)
    leaf.fit(spark.createDataFrame([(Vectors.sparse(features, []), 0.0)] * 2, ["features", target])).save(seed)
    about = json.loads(spark.read.text(f"{seed}/metadata").first()[0])
    about["numTrees"] = settings["maxIter"]
    about["paramMap"] |= settings
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{grown}/metadata")
    number = F.explode(F.sequence(F.lit(0), F.lit(settings["maxIter"] - 1)))
    trees = read_table(spark, f"{seed}/treesMetadata", "parquet")
    listed = trees.withColumn("treeID", number).withColumn("weights", F.when(F.col("treeID") == 0, 1.0).otherwise(settings["stepSize"]))
    write_table(listed.select(*trees.columns), f"{grown}/treesMetadata")
    saved = read_table(spark, f"{seed}/data", "parquet")
    total = F.col("rows").cast("double")
    split = F.struct(F.col("feature").alias("featureIndex"), F.array("threshold").alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    data = nodes.select(F.col("tree").alias("treeID"), F.struct(
        "id", "prediction", "impurity",
        F.array(total, total * F.col("prediction"), total * (F.col("impurity") + F.col("prediction") * F.col("prediction"))).alias("impurityStats"),
        F.col("rows").alias("rawCount"), "gain", F.col("left").alias("leftChild"), F.col("right").alias("rightChild"),
        split.alias("split"),
    ).alias("nodeData"))
    write_table(data.to(saved.schema), f"{grown}/data")
    return GBTRegressionModel.load(grown)


def gbt_forecast(
    model: PipelineModel, test: DataFrame, predictors: Sequence[str], label: str = "Gradient Boosting"
) -> DataFrame:
    """Predictions of the holdout rows, not below zero; the rows keep their keys through the model."""
    return model.transform(_model_frame(test, predictors)).select(
        "date",
        F.col("cat_id"),
        F.lit(label).alias("model"),
        F.greatest("_prediction", F.lit(0.0)).alias("predicted"),
    )


def _inputs(model: PipelineModel, frame: DataFrame) -> list[tuple[str, bool]]:
    """Name of each of the model's inputs and whether it is a level's 0 and 1, read from the assembled vector's attributes."""
    schema = model.transform(frame.limit(0)).schema["all_features"].metadata["ml_attr"]["attrs"]
    attributes = sorted(((a["idx"], a["name"], kind == "binary") for kind, group in schema.items() for a in group))
    selector = next(stage for stage in model.stages if hasattr(stage, "selectedFeatures"))
    chosen = [attributes[i] for i in selector.selectedFeatures]
    return [(name.removesuffix(FILLED).replace("_level_", "_"), level) for _, name, level in chosen]


def _feature_names(model: PipelineModel, frame: DataFrame) -> list[str]:
    return [name for name, _ in _inputs(model, frame)]


def gbt_importance(model: PipelineModel, train: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """Gain, cover and frequency of every used feature, each as a share of 1, by falling gain.

    Read from the saved trees as a table: the gain of a split is its variance reduction times the rows
    that reach it, the cover those rows, the frequency the number of splits.
    """
    spark = train.sparkSession
    path = shared_path(spark, "trees")
    model.stages[-1].save(path)
    names = _feature_names(model, _model_frame(train, predictors))
    nodes = read_table(spark, f"{path}/data", "parquet").select("nodeData.*").where("leftChild >= 0")
    feature = F.element_at(F.array(*[F.lit(name) for name in names]), F.col("split.featureIndex") + 1)
    sums = nodes.groupBy(feature.alias("feature")).agg(
        F.sum(F.col("gain") * F.col("rawCount")).alias("gain"),
        F.sum("rawCount").cast("double").alias("cover"),
        F.count(F.lit(1)).cast("double").alias("frequency"),
    )
    totals = sums.agg(F.struct(F.sum("gain"), F.sum("cover"), F.sum("frequency")).alias("t")).scalar()
    return sums.withColumn("_t", totals).select(
        "feature",
        (F.col("gain") / F.col("_t")["col1"]).alias("gain"),
        (F.col("cover") / F.col("_t")["col2"]).alias("cover"),
        (F.col("frequency") / F.col("_t")["col3"]).alias("frequency"),
    ).orderBy(F.desc("gain"))
